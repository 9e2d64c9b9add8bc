"""Small helpers for Arrow-batched Python stages."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows of an output batch: bounds a worker's memory when a batch fans out.
OUT_ROWS = 50_000


def map_columns(df: DataFrame, f: Callable[[dict[str, pa.Array]], dict[str, object]], schema: str) -> DataFrame:
    """``mapInArrow`` over columns: ``f`` gets a batch as name -> Arrow array and
    gives name -> array or list for ``schema``. Empty batches give no rows."""
    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            out = f(dict(zip(b.schema.names, b.columns, strict=True)))
            made = pa.RecordBatch.from_arrays([_array(out[x.name], x.type) for x in arrow], schema=arrow)
            for at in range(0, made.num_rows, OUT_ROWS):
                yield made.slice(at, OUT_ROWS)

    return df.mapInArrow(run, kind)


def _array(x: object, kind: pa.DataType) -> pa.Array:
    if isinstance(x, pa.ChunkedArray):
        x = x.combine_chunks()
    if isinstance(x, pa.Array):
        return x.cast(kind)
    return pa.array(x, type=kind)


def parsed(schema: str):
    return _parse_datatype_string(schema)
