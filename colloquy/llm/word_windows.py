"""Exact removal of repeated word windows, by super-k-mers.

Each window of 20 words has a minimiser: the least hash among its 5-word runs. Consecutive windows with one
minimiser form a super-k-mer, which travels as one packed string to the bucket of its minimiser; equal
windows meet there, whatever documents they come from, and sorting finds them. Tasks first do the same for their own
documents, so that of a window that a task has seen only the first occurrence travels. Windows of a minimiser that is too frequent for
one bucket go by the hash of all their words instead.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.arrow import arrow_schema, map_columns, rows_batch, slices
from colloquy.llm.bpe import claim
from colloquy.llm.buckets import HOT, bucket_count, hot_keys, text_bytes
from colloquy.llm.rolling import among, joined, least, piece_hashes

#: Words in a window and in a minimiser; bytes of text that a task takes at a time.
WINDOW, MINIMISER, SLICE = 20, 5, 5 << 20
#: Bytes that travel for each byte of text.
TRAVEL = 3.2
HEAD = struct.Struct("<IIQ")


class Words:
    """Words of several lines; each line holds words with one space between them."""

    def __init__(self, lines: list[bytes]):
        self.buffer = b"\n".join(lines)
        raw = np.frombuffer(self.buffer, np.uint8)
        breaks = np.flatnonzero((raw == 32) | (raw == 10))
        self.starts = np.concatenate(([0], breaks + 1))
        self.ends = np.concatenate((breaks, [len(raw)]))
        self.line = np.concatenate(([0], np.cumsum(raw[breaks] == 10)))
        self.first = np.concatenate(([0], np.flatnonzero(np.diff(self.line)) + 1))  # first word of each line
        self.hashes = piece_hashes(raw, self.starts, self.ends)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of the windows that lie in one line."""
        n = len(self.line) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.line[:n] == self.line[size - 1 :])
        return at, joined(self.hashes, size)[at]

    def text(self, first: int, size: int) -> bytes:
        return self.buffer[self.starts[first] : self.ends[first + size - 1]]


def later(words: Words, at: np.ndarray, hashes: np.ndarray, docs: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """Which windows have an equal one that starts earlier (smaller document, or same document and earlier).

    Windows are sorted by hash, document and place; of equal hashes the words themselves are compared.
    """
    order = np.lexsort((places, docs, hashes))
    same = hashes[order][1:] == hashes[order][:-1]
    out = np.zeros(len(at), bool)
    if not same.any():
        return out
    cuts = np.flatnonzero(~same) + 1
    starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(order)]))
    many = ends - starts > 1
    for s, e in zip(starts[many].tolist(), ends[many].tolist()):
        firsts: dict[bytes, tuple[int, int]] = {}
        for i in order[s:e].tolist():
            place = (int(docs[i]), int(places[i]))
            out[i] = firsts.setdefault(words.text(int(at[i]), size), place) != place
    return out


def ranges(docs: np.ndarray, places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, from, to) of the words that these windows cover; consecutive windows are one range."""
    if not len(docs):
        return docs, places, places
    order = np.lexsort((places, docs))
    d, p = docs[order], places[order]
    new = np.concatenate(([True], (d[1:] != d[:-1]) | (p[1:] > p[:-1] + size)))
    at = np.flatnonzero(new)
    return d[at], p[at], p[np.concatenate((at[1:] - 1, [len(p) - 1]))] + size


def pack(strings: list[bytes], docs: np.ndarray, places: np.ndarray) -> bytes:
    body = b"\n".join(strings)
    raw = HEAD.pack(len(strings), 0, len(body)) + docs.astype("<i8").tobytes() + places.astype("<i4").tobytes() + body
    return zstandard.compress(raw, 3)


def unpack(block: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    raw = zstandard.decompress(block)
    n, _, size = HEAD.unpack_from(raw)
    at = HEAD.size
    docs = np.frombuffer(raw, "<i8", n, at)
    places = np.frombuffer(raw, "<i4", n, at + 8 * n)
    body = raw[at + 12 * n : at + 12 * n + size]
    return body.split(b"\n"), docs, places


def cut(ids: list[int], texts: list[str], window: int, minimiser: int, buckets: int, hot: np.ndarray | None = None):
    """Yields (bucket, block, None, ...) of the super-k-mers of these documents, and ranges that are already known."""
    lines, owners = [], []
    for i, t in sorted((i, t) for i, t in zip(ids, texts) if i is not None and t):
        ws = t.encode("utf-8", "surrogatepass").split()
        if len(ws) >= window:
            lines.append(b" ".join(ws))
            owners.append(i)
    if not lines:
        return
    words, owners = Words(lines), np.array(owners, np.int64)
    at, hashes = words.windows(window)
    docs, places = owners[words.line[at]], at - words.first[words.line[at]]
    known = later(words, at, hashes, docs, places, window)
    for d, a, b in zip(*(x.tolist() for x in ranges(docs[known], places[known], window))):
        yield None, None, d, a, b
    keep = np.flatnonzero(~known)
    keys = least(joined(words.hashes, minimiser), window - minimiser + 1)[at[keep]]
    keys = np.where(among(keys, hot), hashes[keep], keys)
    at, docs, places = at[keep], docs[keep], places[keep]
    new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (np.diff(at) != 1) | (docs[1:] != docs[:-1])))
    heads = np.flatnonzero(new)
    tails = np.concatenate((heads[1:] - 1, [len(at) - 1]))
    bucket = (keys[heads] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    starts, ends = words.starts[at[heads]][order].tolist(), words.ends[at[tails] + window - 1][order].tolist()
    bucket, docs, places = bucket[order], docs[heads][order], places[heads][order]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)])).tolist()
    for s, e in zip(cuts, cuts[1:]):
        strings = [words.buffer[a:b] for a, b in zip(starts[s:e], ends[s:e])]
        yield int(bucket[s]), pack(strings, docs[s:e], places[s:e]), None, None, None


def count_bucket(blocks: list[bytes], window: int):
    """Ranges (document, from, to) of the windows of one bucket that have an earlier equal one."""
    parts = [unpack(b) for b in blocks]
    words = Words([s for strings, _, _ in parts for s in strings])
    docs, places = np.concatenate([d for _, d, _ in parts]), np.concatenate([p for _, _, p in parts]).astype(np.int64)
    at, hashes = words.windows(window)
    line = words.line[at]
    own_docs, own_places = docs[line], places[line] + at - words.first[line]
    hit = later(words, at, hashes, own_docs, own_places, window)
    return ranges(own_docs[hit], own_places[hit], window)


def window_keys(texts: list[str | None], window: int, minimiser: int) -> np.ndarray:
    """Minimisers of the windows of texts."""
    lines = [b" ".join(ws) for t in texts if t and len(ws := t.encode("utf-8", "surrogatepass").split()) >= window]
    if not lines:
        return np.zeros(0, np.uint64)
    words = Words(lines)
    return least(joined(words.hashes, minimiser), window - minimiser + 1)[words.windows(window)[0]]


def repeated_ranges(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, minimiser: int = MINIMISER, buckets: int | None = None, hot: float = HOT) -> DataFrame:
    """(doc_id, begin, stop): ranges of words that windows with an earlier equal window cover; they may overlap.

    The number of buckets follows the bytes of the texts. A minimiser that has more than `hot` times a bucket's mean share of the
    windows doesn't meet in one bucket.
    """
    size = text_bytes(docs, text_col)
    buckets = buckets or bucket_count(size, TRAVEL)
    frequent = hot_keys(docs, lambda texts: window_keys(texts, window, minimiser), id_col=id_col, text_col=text_col, size=size, buckets=buckets, hot=hot)
    ddl = "bucket int, block binary, doc_id long, begin int, stop int"
    schema = arrow_schema(ddl)

    def split(batches):
        claim(__name__)
        for part in slices(batches, SLICE):
            rows, size = [], 0
            for row in cut(part.column(0).to_pylist(), part.column(1).to_pylist(), window, minimiser, buckets, frequent):
                rows.append(row)
                size += len(row[1] or b"") + 40
                if size > SLICE:
                    yield rows_batch(rows, schema)
                    rows, size = [], 0
            yield rows_batch(rows, schema)

    out = arrow_schema("doc_id long, begin int, stop int")

    def count(table: pa.Table) -> pa.Table:
        blocks = [b for b in table.column("block").to_pylist() if b is not None]
        found = [(table.column(n).drop_null()) for n in ("doc_id", "begin", "stop")]
        made = [pa.chunked_array([pa.array(x, f.type)]) for x, f in zip(count_bucket(blocks, window), out)] if blocks else [pa.chunked_array([pa.array([], f.type)]) for f in out]
        return pa.Table.from_arrays([pa.chunked_array(a.chunks + b.chunks, f.type) for a, b, f in zip(found, made, out)], schema=out)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(split, ddl)
    # what tasks know already needs no bucket; it rides along, dealt evenly
    dealt = rows.withColumn("bucket", F.coalesce("bucket", F.pmod(F.xxhash64("doc_id", "begin"), F.lit(buckets)).cast("int")))
    return dealt.groupBy("bucket").applyInArrow(count, "doc_id long, begin int, stop int")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_windows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The same rows and columns; texts that lose words are the words left, one space between them, others are unchanged."""
    key, found = (next(n for n in (f"{name}{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns) for name in ("key", "found"))
    spans = repeated_ranges(docs, id_col=id_col, text_col=text_col, window=window)
    spans = spans.groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(F.struct("begin", "stop")).alias(found))

    @F.pandas_udf("string")
    def left(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([t if f is None or not len(f) else kept_words(t, f)[0] for t, f in zip(texts, found)], dtype=object)

    rows = docs.withColumn(key, F.col(f"`{id_col}`").cast("long")).join(spans, key, "left")
    return rows.withColumn(text_col, left(F.col(f"`{text_col}`"), F.col(found))).select(*(F.col(f"`{c}`") for c in docs.columns))


def kept_words(text: str | None, found) -> tuple[str, int, list[tuple[int, int]]]:
    """(words left, words in all, removed ranges) of a text."""
    ws = (text or "").encode("utf-8", "surrogatepass").split()
    own = merged([(x["begin"], x["stop"]) for x in found if x is not None] if found is not None else [])
    n = len(ws)
    for a, b in reversed(own):
        del ws[a:b]
    return b" ".join(ws).decode("utf-8", "surrogatepass"), n, own


def dedup_windows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, minimiser: int = MINIMISER, buckets: int | None = None, hot: float = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, one space between them) and spans (removed ranges of words).

    A word goes if a window of `window` words of its document covers it whose words also start earlier: in a document with a
    smaller id, or further up in the same one. Windows are judged on the input. Words are runs of anything but ASCII
    blanks. Null and short texts lose nothing. Rows that repeat a row are the same document and lose the same words; ids of
    different texts must differ, and are numbers or numerals. Rows with a null id lose nothing and count as no copy. An empty table gives an
    empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{id_col}`").cast("long").alias("key"))
    found = repeated_ranges(docs, id_col=id_col, text_col=text_col, window=window, minimiser=minimiser, buckets=buckets, hot=hot)
    found = found.groupBy(F.col("doc_id").alias("key")).agg(F.collect_list(F.struct("begin", "stop")).alias("found"))

    def keep(ids, texts, found):
        made = [kept_words(t, f) for t, f in zip(texts, found)]
        return {
            "doc_id": ids, "n_words": [n for _, n, _ in made], "n_removed": [sum(b - a for a, b in own) for _, _, own in made], "kept": [k for k, _, _ in made],
            "spans": [[{"begin": a, "stop": b} for a, b in own] for _, _, own in made],
        }

    return map_columns(rows.join(found, "key", "left"), {"doc_id": "doc_id", "text": "text", "found": "found"}, keep,
                       f"doc_id {kind}, n_words long, n_removed long, kept string, spans array<struct<begin:int,stop:int>>")
