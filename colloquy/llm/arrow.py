"""Small helpers for Arrow-batched operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from colloquy.llm.bpe import claim

#: Rows of one Arrow batch are handled in slices of about this many bytes, so that a batch of very
#: long texts needs no more Python memory than a batch of short ones.
SLICE_BYTES = 16 << 20


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut each batch into runs of rows of about `limit` bytes (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, int(n * limit / max(batch.nbytes, 1)))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string; call it on the driver."""
    return to_arrow_schema(StructType.fromDDL(ddl))


def rows_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def map_columns(df: DataFrame, columns: dict[str, str], fn: Callable, schema: str, limit: int = SLICE_BYTES) -> DataFrame:
    """Run `fn(list, list, ...) -> dict of lists or Arrow arrays` over the columns `{name: source column}`.

    Only these columns reach Python, so further columns of `df`, whatever their names, don't matter.
    """
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(fn.__module__)
        for part in slices(batches, limit):
            made = fn(*(part.column(i).to_pylist() for i in range(part.num_columns)))
            yield pa.RecordBatch.from_arrays([x if isinstance(x := made[f.name], pa.Array) else pa.array(x, f.type) for f in out], schema=out)

    return df.select(*(F.col(f"`{src}`").alias(name) for name, src in columns.items())).mapInArrow(run, schema)
