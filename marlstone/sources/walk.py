"""Files of directories and patterns: listing, ignoring, routing."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as T

#: What is left out unless the configuration says otherwise.
EXCLUDES = ("**/node_modules/**", "**/target/**", "**/.git/**")


def excluded(path: Column, patterns: Sequence[str] = EXCLUDES) -> Column:
    """True for paths that fit a pattern; a pattern that is none is passed over."""
    hit = F.lit(False)
    for p in patterns:
        try:
            rx = T.glob_regex(p if p.startswith(("/", "**")) else f"**/{p}")
            re.compile(rx)
        except re.error:
            continue
        hit = hit | path.rlike(rx)
    return hit


def gitignored(root: str) -> list[tuple[str, bool]]:
    """``(regular expression, ignored)`` of the lines in the ``.gitignore`` files below ``root``,
    each under its own directory, outer files first: of the lines that fit, the last one counts."""
    out: list[tuple[str, bool]] = []
    for at, dirs, names in os.walk(root):
        dirs.sort()
        if ".gitignore" in names:
            base = at.replace(os.sep, "/").rstrip("/")
            with open(os.path.join(at, ".gitignore"), encoding="utf-8", errors="replace") as file:
                for line in map(str.strip, file):
                    again = line.startswith("!")
                    body = line[again:]
                    if body.strip("/") and body[0] != "#":
                        inner = body.strip("/")
                        where = f"{base}/{inner}" if "/" in body.rstrip("/") else f"{base}/**/{inner}"
                        # a trailing slash means a directory: its path ends with one below
                        rx = T.glob_regex(where).removesuffix("$")
                        out.append((rx + ("/$" if body.endswith("/") else "/?$"), not again))
    return out


def git_excluded(path: Column, rules: Sequence[tuple[str, bool]], root: str) -> Column:
    """Whether a file, or a directory that it lies in below ``root``, is ignored; a file in an
    ignored directory can't be taken back by a line of its own."""
    base = root.replace(os.sep, "/").rstrip("/")

    @F.pandas_udf("boolean")
    def ignored(paths: pd.Series) -> pd.Series:
        found = [(re.compile(rx), on) for rx, on in rules]
        known: dict[str, bool] = {}

        def own(p: str) -> bool:
            return next((on for rx, on in reversed(found) if rx.match(p)), False)

        def folder(p: str) -> bool:
            if len(p) <= len(base):
                return False
            if p not in known:
                known[p] = folder(p.rpartition("/")[0]) or own(p + "/")
            return known[p]

        return paths.map(lambda p: folder(p.rpartition("/")[0]) or own(p))

    return ignored(path) if rules else F.lit(False)


def _hidden(root: str) -> list[str]:
    """Directories and files that Spark's own listing passes over, the topmost of each."""
    out = []
    for at, dirs, names in os.walk(root):
        hide = [d for d in dirs if d[0] in "._"]
        out += [os.path.join(at, x) for x in [*hide, *(n for n in names if n[0] in "._")] if x != ".git"]
        dirs[:] = [d for d in dirs if d not in hide]
    # below a hidden directory there may be hidden ones again
    return [*out, *[x for d in out if os.path.isdir(d) for x in _hidden(d)]]


def _opened(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Single files by path, where their file system is mounted."""
    for paths in parts:
        for p in paths["path"]:
            with open(p, "rb") as file:
                data = file.read()
            at = pd.Timestamp(os.stat(p).st_mtime_ns // 1_000_000, unit="ms")
            yield pd.DataFrame({"path": [p], "modificationTime": [at], "length": [len(data)], "content": [data]})


def scan(spark: SparkSession, directory: str, excludes: Sequence[str] = EXCLUDES, extensions: Sequence[str] = T.EXTENSIONS, content: bool = True, gitignore: bool = True) -> DataFrame:
    """``filename, modified_at, length, content`` of the files below a directory, hidden ones too.

    Without ``content`` only the listing is read. An extension counts as it is spelt.
    """
    ignore = gitignored(directory) if gitignore and os.path.isdir(directory) else []
    more = _hidden(directory) if os.path.isdir(directory) else []
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([directory, *(p for p in more if os.path.isdir(p))])
    single = [(p,) for p in more if os.path.isfile(p) and p.rpartition(".")[2] in extensions]
    if single:
        rows = rows.unionByName(spark.createDataFrame(single, "path string").mapInPandas(_opened, rows.schema))
    name = T.normal_path(F.regexp_replace("path", "^file:/+", "/"))
    known = T.extension(F.col("filename")).isin(list(extensions)) & ~excluded(F.col("filename"), excludes)
    listed = rows.select(name.alias("filename"), F.col("modificationTime").alias("modified_at"), "length", *(["content"] if content else [])).where(known)
    return listed.where(~git_excluded(F.col("filename"), ignore, directory)) if ignore else listed


def base_directory(pattern: str) -> str:
    """The directory before the first wildcard; ``.`` where nothing is."""
    at = min([i for i in (pattern.find("*"), pattern.find("?")) if i >= 0], default=-1)
    if at < 0:
        return pattern
    head = pattern[:at]
    if head and not head.endswith(("/", "\\")):
        head = os.path.dirname(head)
    return head.rstrip("/\\") or ("/" if head.startswith("/") else ".")


def base_directories(patterns: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(base_directory(os.path.expanduser(p)) for p in patterns))


def suffix_filter(filename: Column, pattern: str) -> Column:
    """Files of a pattern beyond its base directory; a plain directory takes all."""
    if "*" not in pattern and "?" not in pattern:
        return F.lit(True)
    return T.normal_path(filename).rlike(T.glob_regex(os.path.expanduser(pattern).replace("\\", "/")).replace("^", "", 1) if not pattern.startswith("/") else T.glob_regex(pattern))


def expand(patterns: Iterable[str], extensions: Sequence[str] = T.EXTENSIONS) -> list[str]:
    """Paths of the files that patterns name, each once; hidden directories are passed over."""
    found: dict[str, None] = {}
    for p in patterns:
        p = os.path.expanduser(p)
        wild = re.compile(T.glob_regex(p.replace("\\", "/"))) if "*" in p or "?" in p else None
        if wild is None and os.path.isfile(p):
            found[p] = None
            continue
        for at, dirs, names in os.walk(base_directory(p)):
            dirs[:] = sorted(d for d in dirs if not d.startswith("."))
            for n in sorted(names):
                path = os.path.join(at, n).replace(os.sep, "/")
                if n.rpartition(".")[2] in extensions and (wild is None or wild.match(path) or wild.match(path.removeprefix("./"))):
                    found[path] = None
    return list(found)
