"""Texts made of code symbols: signatures and what is embedded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.text import trimmed


def _one_line(c: Column) -> Column:
    return trimmed(F.regexp_replace(c, r"(?U)\s+", " "))


def _first_line(c: Column) -> Column:
    return F.regexp_extract(c, r"^([^\r\n]*)", 1)


def signature(content: Column, language: Column) -> Column:
    """The declaration's head: up to a brace, to ``):`` in Python, to ``=>`` in JavaScript and TypeScript."""
    c = trimmed(content)
    upto = lambda sign, keep: _one_line(F.substr(c, F.lit(1), F.instr(c, sign) - 1 + keep))
    first = trimmed(_first_line(c))
    brace = F.when(F.contains(c, F.lit("{")), upto("{", 0)).otherwise(_first_line(c))
    python = (
        F.when(first.endswith(":"), F.regexp_replace(first, ":$", ""))
        .when(F.contains(c, F.lit("):")), upto("):", 1)).otherwise(first)
    )
    script = F.when(F.contains(c, F.lit("=>")), upto("=>", 2)).otherwise(brace)
    return F.when(language == "python", python).when(language.isin("typescript", "javascript"), script).otherwise(brace)


def embedding_text(language: Column, symbol: Column, content: Column) -> Column:
    return F.concat(language, F.lit(" "), symbol, F.lit(": "), content)
