"""Text as Column expressions: trimming, globs, languages, identifiers, sizes, chunks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it; Python's own strip also takes U+001C to U+001F.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
#: An escape for patterns that must have none: no text of ours holds it.
NO_ESCAPE = "﷐"


def trimmed(c: Column) -> Column:
    """``c`` without white space of any script at its ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def glob_to_like(glob: str) -> str:
    """A LIKE pattern, with ``\\`` as its escape, for a glob of ``*`` and ``?``."""
    signs = {"\\": "\\\\", "%": "\\%", "_": "\\_", "*": "%", "?": "_"}
    return "".join(signs.get(c, c) for c in glob)


def like(c: Column, pattern: str, escape: str = NO_ESCAPE) -> Column:
    """LIKE without regard to case; by default nothing escapes a sign."""
    return F.ilike(c, F.lit(pattern), F.lit(escape))


def in_directory(name: Column, directory: str) -> Column:
    """Below ``directory``, whichever slash its path is spelt with; wildcards in it count as such."""
    base = directory.rstrip("/")
    return like(name, f"{base}/%") | like(name, f"{base}\\%")


def matches_glob(name: Column, glob: str) -> Column:
    """The whole name, or its part after some slash, fits ``glob``; ``*`` crosses slashes."""
    p = glob_to_like(glob)
    return like(name, f"%/{p}", "\\") | like(name, p, "\\")


def glob_regex(glob: str) -> str:
    """A regular expression for a path glob with ``**``, ``*``, ``?`` and ``{a,b}``."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]*/)*", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "{":
            depth, c = depth + 1, "(?:"
        elif c == "}" and depth:
            depth, c = depth - 1, ")"
        elif c == "," and depth:
            c = "|"
        else:
            c = {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
        out, i = out + c, i + 1
    return f"^{out}$"


def normal_path(c: Column) -> Column:
    """Forward slashes, without the ``\\\\?\\`` prefix and without a ``file:`` scheme."""
    slashes = F.replace(c, F.lit("\\"), F.lit("/"))
    return F.regexp_replace(F.regexp_replace(slashes, r"^/+\?/+", ""), r"^file:/+", "/")


def extension(c: Column) -> Column:
    """What follows the last dot of the last part; empty where there is none."""
    return F.regexp_extract(c, r"\.([^./\\]+)$", 1)


#: File endings by kind of reader.
MARKDOWN = ["md"]
CODE = ["rs", "go", "py", "js", "mjs", "cjs", "jsx", "ts", "mts", "cts", "tsx"]
PLAIN = ["txt", "json", "yaml", "yml", "toml", "csv", "log", "html", "htm", "pdf", "docx", "xls", "xlsx", "xlsb", "ods"]
EXTENSIONS = [*MARKDOWN, *CODE, *PLAIN]


def file_kind(name: Column) -> Column:
    """markdown, code or text by extension (case counts); null for others."""
    e = extension(name)
    return F.when(e.isin(MARKDOWN), "markdown").when(e.isin(CODE), "code").when(e.isin(PLAIN), "text")


def code_language(name: Column) -> Column:
    e = extension(name)
    return (
        F.when(e == "rs", "rust").when(e == "go", "go").when(e == "py", "python")
        .when(e.isin("js", "mjs", "cjs", "jsx"), "javascript").when(e.isin("ts", "mts", "cts", "tsx"), "typescript")
    )


def count_of(c: Column, inside: str) -> Column:
    """Characters of ``c`` in a class."""
    return F.length(F.regexp_replace(c, f"[^{inside}]+", ""))


def has_han(c: Column) -> Column:
    return c.rlike("[\\u4e00-\\u9fff]")


def detect_language(c: Column) -> Column:
    """zh, ja, ko, en, mixed or unknown, by shares of letters per script."""
    counts = F.struct(
        count_of(c, r"\p{L}\p{Nl}").alias("total"), count_of(c, "\\u3400-\\u4dbf\\u4e00-\\u9fff").alias("han"),
        count_of(c, "\\u3041-\\u3096\\u309d-\\u309f\\u30a1-\\u30fa\\u30fc-\\u30ff").alias("kana"), count_of(c, "\\uac00-\\ud7a3").alias("hangul"),
        count_of(c, "A-Za-z").alias("latin"),
    )

    def label(n: Column) -> Column:
        east = F.try_divide(n["han"] + n["kana"] + n["hangul"], n["total"])
        return (
            F.when(n["total"].isNull(), F.lit(None)).when(n["total"] == 0, "unknown")
            .when((n["kana"] > n["han"]) & (n["kana"] > n["hangul"]) & (east > 0.1), "ja").when((n["hangul"] > 0) & (east > 0.1), "ko")
            .when(east > 0.3, "zh").when(F.try_divide(n["latin"], n["total"]) > 0.8, "en").otherwise("mixed")
        )

    return F.get(F.transform(F.array(counts), label), F.lit(0))  # each count is taken once


def split_identifier(c: Column) -> Column:
    """Lower-case parts at underscores, or else at upper-case letters."""
    humps = F.split(F.regexp_replace(c, r"(\p{Lu})", " $1"), " ")
    parts = F.when(F.contains(c, F.lit("_")), F.split(c, "_")).otherwise(humps)
    return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.lower(x))


def estimated_tokens(c: Column) -> Column:
    """A third of the bytes, rounded up."""
    return F.ceil(F.octet_length(c) / F.lit(3)).cast("int")


def preview(c: Column, n: int = 120) -> Column:
    return F.translate(F.substring(c, 1, n), "\n", " ")


def version_key(c: Column) -> Column:
    """Major, minor and patch of ``v1.2.3`` as numbers, to be compared; null for other texts."""
    part = lambda i: F.coalesce(F.regexp_extract(c, r"^\s*[vV]?(\d+)(?:\.(\d+))?(?:\.(\d+))?", i).try_cast("int"), F.lit(0))
    return F.when(c.rlike(r"^\s*[vV]?\d+"), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


_STOPS = frozenset(".!?\n。")


def _pieces(paragraph: str, size: int) -> list[str]:
    """A long paragraph cut after the last sentence end between half of ``size`` and ``size``."""
    out = []
    while len(paragraph) > size:
        end = next((i + 1 for i in range(size, size // 2 - 1, -1) if paragraph[i] in _STOPS), size)
        head, paragraph = paragraph[:end].strip(WHITE), paragraph[end:].strip(WHITE)
        if head:
            out.append(head)
    return [*out, paragraph] if paragraph else out


def chunked(text: str, size: int) -> list[str]:
    """Chunks of about ``size`` characters: whole paragraphs while they fit together."""
    if len(text) <= size:
        return [t] if (t := text.strip(WHITE)) else []
    out: list[str] = []
    held = ""
    for paragraph in (p for p in (x.strip(WHITE) for x in text.split("\n\n")) if p):
        if held and len(held) + len(paragraph) + 2 > size:
            out.append(held)
            held = ""
        if len(paragraph) > size:
            out += _pieces(paragraph, size)
        else:
            held = f"{held}\n\n{paragraph}" if held else paragraph
    return [*out, held] if held else out


def chunks(c: Column, size: int = 500) -> Column:
    """Array of chunks of each text, Arrow-batched; null gives null."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else chunked(t, size))

    return cut(c)
