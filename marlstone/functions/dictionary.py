"""Mining of word pairs: Han words beside English identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import detect_language, split_identifier

#: A Han word with an identifier in round or square brackets; a Han word in a comment.
ROUND = r"(\p{IsHan}+)\s*[（(]([a-zA-Z][a-zA-Z0-9_]*)[)）]"
SQUARE = r"(\p{IsHan}+)\s*\[([a-zA-Z][a-zA-Z0-9_]*)\]"
COMMENT = r"(?://|#)\s*(\p{IsHan}+)"
#: How sure each kind of pair is.
WHOLE_SURE, PART_SURE, SQUARE_SURE, COMMENT_SURE = 1.0, 0.8, 0.9, 0.6


def _pairs(c: Column, pattern: str) -> Column:
    return F.arrays_zip(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)).alias("han"), F.regexp_extract_all(c, F.lit(pattern), F.lit(2)).alias("word"))


def mined(texts: DataFrame, document: str, text: str) -> DataFrame:
    """``document, source_word, target_word, confidence``: pairs in brackets.

    Of each document a pair is found once by its spelling, with parts of an
    identifier in round brackets as further pairs. A spelling that differs from
    its lower case comes as both, as the whole and as a part.
    """
    hits = texts.select(F.col(document).alias("document"), F.explode(F.concat(
        F.transform(_pairs(F.col(text), ROUND), lambda p: F.struct(F.lit(0).alias("kind"), p["han"].alias("han"), p["word"].alias("word"))),
        F.transform(_pairs(F.col(text), SQUARE), lambda p: F.struct(F.lit(1).alias("kind"), p["han"].alias("han"), p["word"].alias("word"))),
    )).alias("p")).select("document", "p.*").groupBy("document", "han", "word").agg(F.min("kind").alias("kind"))
    whole = hits.select(
        "document", F.col("han").alias("source_word"), F.col("word").alias("spelling"), F.lower("word").alias("target_word"),
        F.when(F.col("kind") == 0, WHOLE_SURE).otherwise(SQUARE_SURE).alias("confidence"),
    )
    parts = hits.where(F.col("kind") == 0).select(
        "document", F.col("han").alias("source_word"), F.col("word"), F.explode(F.array_distinct(split_identifier(F.col("word")))).alias("spelling")
    ).where(F.col("spelling") != F.col("word")).select(
        "document", "source_word", "spelling", F.col("spelling").alias("target_word"), F.lit(PART_SURE).alias("confidence")
    )
    # a part spelt like a whole word found before it is that word
    return whole.unionByName(parts).groupBy("document", "source_word", "spelling").agg(
        F.first("target_word").alias("target_word"), F.max("confidence").alias("confidence")
    ).drop("spelling")


def mined_from_comments(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """Pairs from a comment on the line before one that names a symbol.

    ``lines`` has document, line_no, line; ``symbols`` has document, symbol.
    """
    before = F.lag("line").over(Window.partitionBy("document").orderBy("line_no"))
    han = F.explode(F.regexp_extract_all("before", F.lit(COMMENT), F.lit(1))).alias("source_word")
    # few lines follow a comment with such words; they alone meet their document's symbols, also inside longer identifiers
    near = lines.withColumn("before", before).where(F.col("before").rlike(COMMENT))
    found = near.join(symbols, "document").where(F.contains("line", "symbol")).select("document", "symbol", han)
    part = F.explode(split_identifier(F.col("symbol"))).alias("target_word")
    return (
        found.where(F.length("source_word") > 1).select("document", "source_word", part).where(F.octet_length("target_word") > 1)
        .distinct().withColumn("confidence", F.lit(COMMENT_SURE))
    )


def gated(texts: DataFrame, text: str, lang: str) -> DataFrame:
    """Texts that are mixed or in the wanted language."""
    return texts.where(detect_language(F.col(text)).isin("mixed", lang))


KEY = ["source_word", "target_word", "source_lang"]


def merged(known: DataFrame, new: DataFrame) -> DataFrame:
    """The dictionary with new pairs: the greater confidence, the later writer's document.

    Both have KEY, confidence, source_document; ``new`` counts as later.
    """
    both = known.select(*KEY, "confidence", "source_document", F.lit(0).alias("seq")).unionByName(
        new.select(*KEY, "confidence", "source_document", F.lit(1).alias("seq"))
    )
    return both.groupBy(*KEY).agg(F.max("confidence").alias("confidence"), F.max_by("source_document", F.struct("seq", "source_document")).alias("source_document"))


def looked_up(dictionary: DataFrame, word: str, lang: str | None = None) -> DataFrame:
    """Targets of ``word``, the surest first, ties by word."""
    rows = dictionary.where(F.col("source_word") == word)
    if lang is not None:
        rows = rows.where(F.col("source_lang") == lang)
    return rows.orderBy(F.desc("confidence"), "target_word")
