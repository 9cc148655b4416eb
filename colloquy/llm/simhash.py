"""Near-duplicates by SimHash fingerprints and multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.arrow import map_columns
from colloquy.llm.components import components
from colloquy.llm.shared import written

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: A table entry with more fingerprints than this is split by bytes of the other segment.
CROWD = 4096


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> list[int]:
    """XXH64 of each shingle, or of the whole text if it has no more words than one; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII blanks
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist())]


def fingerprint_of(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of unsigned 64-bit hashes: a bit is set if it is in over half of them."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8")
        total += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big", signed=True)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash: a bit is set if it is in over half of the shingles' XXH64; 0 without words."""
    hashes = shingle_hashes(text, shingle)
    if not hashes:
        return 0
    return fingerprint_of(np.array(hashes, dtype=np.uint64))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (signed 64 bits) of whole texts; null and blank texts have 0. Each row gives a row; an empty table gives none."""
    kind = docs.schema[id_col].dataType.simpleString()
    return map_columns(docs, {"doc_id": id_col, "text": text_col}, lambda ids, texts: {"doc_id": ids, "fp": [fingerprint(t) for t in texts]}, f"doc_id {kind}, fp long")


def probes(distinct: DataFrame) -> DataFrame:
    """(key, fp): where each fingerprint stands in the tables and where it looks.

    Of two fingerprints that differ in 3 bits or fewer, one 32-bit segment differs in 1 or none. The ball of
    radius 1 around a segment is enumerated by clearing one set bit: of two segments that differ in one bit,
    the one that has it meets the other at the other's own value.
    """
    segments = "array(shiftrightunsigned(fp, 32), fp & 4294967295L)"
    ball = f"""explode(flatten(transform({segments}, (s, i) -> transform(
        concat(array(s), transform(filter(sequence(0, 31), b -> getbit(s, b) = 1), b -> s & ~shiftleft(1L, b))),
        v -> v | shiftleft(cast(i + 1 as bigint), 40)))))"""
    return distinct.select(F.expr(ball).alias("key"), "fp")


def stars(fps: np.ndarray, distance: int) -> Iterator[tuple[int, np.ndarray]]:
    """(least, others) of each component of fingerprints within the distance; whole distances are compared."""
    bits = fps.view(np.uint64)
    left = np.arange(len(fps))
    while left.size:
        queue, left, found = [left[0]], left[1:], [left[0]]
        while queue and left.size:
            near = np.bitwise_count(bits[left] ^ bits[queue.pop()]) <= distance
            if near.any():
                queue += (more := left[near]).tolist()
                found += more.tolist()
                left = left[~near]
        if len(found) > 1:
            own = np.sort(fps[found])
            yield own[0], own[1:]


def _matches(distance: int, crowd: int | None):
    """Rows (key, a, b) of partitions that are sorted by key: key null and a link, or a crowded key and its member a."""
    schema = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def batch(key, a, b):
        return pa.RecordBatch.from_arrays([key, pa.array(a, pa.int64()), b], schema=schema)

    def links(keys: np.ndarray, fps: np.ndarray):
        cut = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(keys)]))
        size = ends - starts
        two = starts[size == 2]
        x, y = fps[two], fps[two + 1]
        near = np.bitwise_count((x ^ y).view(np.uint64)) <= distance
        a, b = [np.minimum(x, y)[near]], [np.maximum(x, y)[near]]
        for s, e in zip(starts[size > 2].tolist(), ends[size > 2].tolist()):
            for least, others in stars(fps[s:e], distance):
                a.append(np.full(len(others), least))
                b.append(others)
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            yield batch(pa.nulls(len(a), pa.int64()), a, pa.array(b, pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = [], []  # the rows of the last key so far
        crowded = None
        for part in batches:
            k, f = part.column(0).to_numpy(), part.column(1).to_numpy()
            if not len(k):
                continue
            if crowded is not None:
                n = int(np.searchsorted(k, crowded, "right"))
                if n:
                    yield batch(pa.array(k[:n], pa.int64()), f[:n], pa.nulls(n, pa.int64()))
                if n == len(k):
                    continue
                k, f, crowded = k[n:], f[n:], None
            last = int(np.searchsorted(k, k[-1], "left"))
            if not keys or last or keys[0][-1] != k[-1]:
                head_k, head_f = np.concatenate([*keys, k[:last]]), np.concatenate([*fps, f[:last]])
                if len(head_k):
                    yield from links(head_k, head_f)
                keys, fps = [], []
            keys.append(k[last:])
            fps.append(f[last:])
            if crowd and (n := sum(map(len, keys))) > crowd:
                yield batch(pa.array(np.concatenate(keys), pa.int64()), np.concatenate(fps), pa.nulls(n, pa.int64()))
                crowded, keys, fps = int(k[-1]), [], []
        if keys:
            yield from links(np.concatenate(keys), np.concatenate(fps))

    return run


def links(distinct: DataFrame, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all that are within the distance (3 at most).

    Each table entry gives a star per component in it, never all its pairs. Crowded entries are dealt out again
    by each byte of the other segment: with 3 differing bits or fewer, one of its 4 bytes is equal.
    """
    def matched(rows: DataFrame, most: int | None) -> DataFrame:
        return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_matches(distance, most), "key long, a long, b long")

    first = written(matched(probes(distinct), crowd), "matches")
    other = "if(shiftright(key, 40) = 1, a & 4294967295L, shiftrightunsigned(a, 32))"
    dealt = first.where("key is not null").select(
        F.expr(f"explode(transform(sequence(0, 3), i -> xxhash64(key, i, shiftrightunsigned({other}, 8 * i) & 255)))").alias("key"), F.col("a").alias("fp")
    )
    return first.where("key is null").select("a", "b").unionByName(matched(dealt, None).select("a", "b"))


def simhash_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id: the smallest doc_id that links of 3 bits or fewer reach.

    Null, empty and blank texts have fingerprint zero and are linked like any other; repeated rows stay; an empty
    table gives an empty result. Equal fingerprints are one node from the start, however many documents have them.
    """
    own = written(fingerprints(docs, id_col=id_col, text_col=text_col), "fingerprints")
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("fp")))
    nodes = written(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "nodes")
    ids = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    of = nodes.join(ids, "root").select("fp", "component_id")
    return own.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
