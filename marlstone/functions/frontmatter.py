"""Frontmatter of a document: a header of ``key: value`` lines between two ``---`` lines."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.text import trimmed

#: The keys that are kept, in the order they are written.
KEYS = ("domain", "docType", "language", "tags", "project")


def _lines(text: Column) -> Column:
    """Lines as ``\\n`` or ``\\r\\n`` end them; an end at the very end starts no further line."""
    return F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n")


def _close(lines: Column) -> Column:
    """Place of the closing line, from 1; 0 where there is none."""
    marks = F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: trimmed(x) == "---")
    at = F.array_position(marks, True)
    return F.when(at > 0, at + 1).otherwise(0)


def status(text: Column) -> Column:
    """none, ok or unclosed."""
    lines = _lines(text)
    opened = (F.size(lines) >= 3) & (trimmed(F.get(lines, F.lit(0))) == "---")
    return F.when(~opened, "none").when(_close(lines) == 0, "unclosed").otherwise("ok")


def parsed(text: Column) -> Column:
    """``struct(domain, docType, language, tags, project)``; null without a closed header.

    Of a key that comes twice the last counts; keys that are missing are empty;
    values aren't unquoted; lines that begin with ``#`` are left out.
    """
    lines = _lines(text)
    head = F.transform(F.slice(lines, 2, F.greatest(_close(lines) - 2, F.lit(0)).cast("int")), lambda x: trimmed(x))

    def value(key: str) -> Column:
        own = F.filter(head, lambda x: ~x.startswith("#") & (trimmed(F.substring_index(x, ":", 1)) == key) & F.contains(x, F.lit(":")))
        last = F.try_element_at(own, F.lit(-1))
        return F.coalesce(trimmed(F.substr(last, F.instr(last, ":") + 1)), F.lit(""))

    tags = F.filter(F.transform(F.split(F.regexp_replace(value("tags"), r"^[\[\]]+|[\[\]]+$", ""), ","), lambda x: trimmed(x)), lambda x: x != "")
    parts = [(tags if k == "tags" else value(k)).alias(k) for k in KEYS]
    return F.when(status(text) == "ok", F.struct(*parts))


def body(text: Column) -> Column:
    """The text after the header; all of it without one."""
    lines = _lines(text)
    at = _close(lines).cast("int")
    rest = F.array_join(F.slice(lines, at + 1, F.size(lines)), "\n")
    return F.when(status(text) == "ok", rest).otherwise(text)


def quoted(c: Column) -> Column:
    """In double quotes where YAML would read it otherwise."""
    return F.when(c.rlike(r"""^$|[:#\[\]{}"']|^ | $"""), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(c)


def generated(meta: Column) -> Column:
    """The header for a struct as ``parsed`` gives it; empty fields are left out."""
    def line(k: str) -> Column:
        if k == "tags":
            return F.when(F.size(meta[k]) > 0, F.concat(F.lit("tags: ["), F.array_join(F.transform(meta[k], quoted), ", "), F.lit("]\n"))).otherwise("")
        return F.when(F.coalesce(meta[k], F.lit("")) != "", F.concat(F.lit(f"{k}: "), quoted(meta[k]), F.lit("\n"))).otherwise("")

    return F.concat(F.lit("---\n"), *[line(k) for k in KEYS], F.lit("---\n"))


def tag_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: trimmed(x)), lambda x: x != "")


def of(values: Mapping[str, object]) -> Column:
    """A struct from plain values: strings, and a list for tags."""
    tags = values.get("tags") or []
    return F.struct(*[
        (F.array(*[F.lit(t) for t in tags]).cast("array<string>") if k == "tags" else F.lit(str(values.get(k) or ""))).alias(k) for k in KEYS
    ])


def added(text: Column, meta: Column) -> Column:
    """``text`` with a header; null where it has one or an unclosed one."""
    return F.when(status(text) == "none", F.concat(generated(meta), F.lit("\n"), text))


def updated(text: Column, meta: Column) -> Column:
    """Fields of ``meta`` that aren't empty take the place of those in the header; without one it is added.

    Null where a header isn't closed.
    """
    old = parsed(text)
    both = F.struct(*[
        (F.when(F.size(meta[k]) > 0, meta[k]).otherwise(old[k]) if k == "tags" else F.coalesce(F.nullif(meta[k], F.lit("")), old[k])).alias(k) for k in KEYS
    ])
    again = F.concat(generated(both), F.lit("\n"), F.regexp_replace(body(text), r"^\n+", ""))
    return F.when(status(text) == "ok", again).otherwise(added(text, meta))
