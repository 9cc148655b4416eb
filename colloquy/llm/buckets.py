"""How many buckets windows are dealt to, and which minimisers are too frequent for one."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.arrow import slices
from colloquy.llm.bpe import claim

#: Bytes of packed strings that one bucket is meant to hold, and the least number of buckets.
BUCKET_BYTES, LEAST = 24 << 20, 256
#: Bytes of texts in the sample that hot minimisers are looked for in, and the share of all windows that makes one hot, in buckets'
#: mean shares. What is hot decides only where windows meet, never what is found.
SAMPLE_BYTES, HOT = 32 << 20, 4.0


def text_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")))).first()[0] or 0


def bucket_count(size: int, travel: float) -> int:
    """Buckets for texts of that many bytes, of which each sends `travel` bytes."""
    return max(LEAST, math.ceil(size * travel / BUCKET_BYTES))


def hot_keys(docs: DataFrame, keys_of: Callable[[list], np.ndarray], *, id_col: str, text_col: str, size: int, buckets: int, hot: float = HOT) -> np.ndarray:
    """The keys (sorted) that have over `hot / buckets` of all windows in a sample of about `SAMPLE_BYTES` of the texts.

    `keys_of(texts)`: a key per window. There are fewer than 4/3 `buckets / hot` such keys, whatever the size of the input.
    """
    share = hot / buckets
    every = max(1, math.ceil(size / SAMPLE_BYTES))
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def count(batches):
        claim(__name__)
        for part in slices(batches, 4 << 20):
            keys, n = np.unique(keys_of(part.column(0).to_pylist()), return_counts=True)
            # what has that share of all has three quarters of its windows in parts where it has a quarter of the share
            some = n >= max(2, share / 4 * n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.append(keys[some].view(np.int64), 0)), pa.array(np.append(n[some], -n.sum()))], schema=schema)

    key = F.xxhash64(F.col(f"`{id_col}`"), F.lit(every))
    rows = docs.where(F.pmod(key, F.lit(every)) == 0) if every > 1 else docs
    found = rows.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(count, "key long, n long")
    sums = found.groupBy("key", (F.col("n") < 0).alias("all")).agg(F.sum("n").alias("n"))
    total = sums.where("all").agg(F.sum("n").alias("total"))  # one row
    hot_rows = sums.where("not all and n >= 20").join(F.broadcast(total)).where(F.col("n") >= -0.75 * share * F.col("total")).select("key")
    return np.sort(np.array([r.key for r in hot_rows.collect()], np.int64).view(np.uint64))
