"""Vectors as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def query_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def cosine_distance(a: Column, b: Column) -> Column:
    """1 minus the cosine; null for a zero vector or unlike lengths."""
    cos = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.when(F.size(a) == F.size(b), 1 - cos)


def similarity(distance: Column) -> Column:
    """0 for opposite, 1 for the same direction."""
    return 1 - distance / 2


def hash_embedding(text: Column, dim: int = 1024) -> Column:
    """A unit vector from the text's MD5, for tests and for running without a service.

    The digest's first eight bytes are repeated to ``dim`` and scaled to length 1.
    """
    let = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # noqa: E731  (x is evaluated once)
    byte = lambda h, i: F.conv(F.substr(h, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255
    eight = let(F.md5(F.encode(text, "UTF-8")), lambda h: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: byte(h, i)))
    raw = let(eight, lambda e: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.get(e, F.pmod(i, F.lit(8)))))
    norm = lambda r: F.sqrt(F.aggregate(r, F.lit(0.0), lambda s, x: s + x * x))
    return let(raw, lambda r: let(norm(r), lambda n: F.transform(r, lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0)).cast("float"))))
