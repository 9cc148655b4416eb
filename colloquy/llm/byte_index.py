"""Exact removal of repeated byte strings, by run-compressed indexes.

Documents are cut where their minimisers change: every 400-byte window lies in one piece, and equal windows lie in pieces
with the same minimiser, so pieces meet in the bucket of their minimiser; a piece that a task has seen before doesn't travel again,
and of one that stands in several places it is enough to know that. Pieces whose minimiser nothing shares hold no repeated window.
What different pieces have in common is found by an index: the Burrows-Wheeler transform of their text in runs of equal letters, with a
sampled position and match length at both ends of each run. Match lengths with the neighbours in suffix order fall by one from a
byte to the next except where a run begins or ends, so streaming over the samples gives them for every byte.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.arrow import arrow_schema, map_columns, rows_batch, slices
from colloquy.llm.bpe import claim
from colloquy.llm.buckets import HOT, bucket_count, hot_keys, text_bytes
from colloquy.llm.rolling import LETTERS, POWERS, among, least, mixed
from colloquy.llm.word_windows import merged, ranges

#: Bytes in a window, in a minimiser and in the longer one that pieces of a hot minimiser are cut by; bytes that a task takes at a
#: time; bytes of a line (longer texts are cut, with overlaps of a window); bytes in one index.
WINDOW, GRAM, WIDE, SLICE, LINE, INDEX = 400, 24, 200, 4 << 20, 1 << 20, 2 << 20
#: Bytes that travel for each byte of text.
TRAVEL = 2.5
#: A byte that UTF-8 never has.
GAP = b"\xff"
HEAD = struct.Struct("<II")
#: Flags of a piece: it stands in several places; its minimiser stands in it more than once.
MANY, TWICE = 1, 2


def gram_hashes(raw: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hash of the `size` bytes from each position on."""
    up, down = POWERS.get(len(raw) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(LETTERS[raw] * up[: len(raw)])))
    return mixed((sums[size:] - sums[:-size]) * down[: len(raw) - size + 1] + np.uint64(seed))


def pieces(line: bytes, window: int, gram: int, hot: np.ndarray | None = None, wide: int = 0):
    """(start, stop, minimiser, is it there twice) of the pieces of a line of `window` bytes or more.

    Windows whose minimiser is one of `hot` (sorted) go by their least hash of `wide` bytes instead.
    """
    raw = np.frombuffer(line, np.uint8)
    hashes = gram_hashes(raw, gram, gram)
    keys = least(hashes, window - gram + 1)
    mask = among(keys, hot)
    if mask.any():
        others = gram_hashes(raw, wide, wide)
        keys = np.where(mask, least(others, window - wide + 1), keys)
    heads = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]) | (mask[1:] != mask[:-1])) + 1))
    tails = np.concatenate((heads[1:], [len(keys)]))
    for a, b, key, m in zip(heads.tolist(), tails.tolist(), keys[heads], mask[heads].tolist()):
        own = others[a : b + window - wide] if m else hashes[a : b + window - gram]
        yield a, b - 1 + window, int(key), int(np.count_nonzero(own == key)) > 1


class Order:
    """Suffixes of a text in order. Sorted by 8 bytes at first, then by twice as many each time; only suffixes that
    aren't told apart yet are sorted again. A rank is the place in the order where a group of equal prefixes begins."""

    def __init__(self, text: np.ndarray, window: int):
        n = len(text)
        self.text, self.window = text, window
        padded = np.concatenate((text, np.zeros(8, np.uint8))).astype(np.uint64)
        key = np.zeros(n, np.uint64)
        for i in range(8):
            key = (key << np.uint64(8)) | padded[i : i + n]
        self.first = key
        at = np.argsort(key)
        self.rank = np.zeros(n, np.int64)
        self.level, self.ranks = 8, self.rank  # ranks by as many bytes as fit in a window
        at = self.ranked(at, key[at][1:] != key[at][:-1], np.zeros(n, np.int64))
        size = 8
        while len(at):
            if size <= window:
                self.level, self.ranks = size, self.rank.copy()
            after = np.where(at + size < n, self.rank[np.minimum(at + size, n - 1)] + 1, 0)
            own = self.rank[at]
            pair = (own << 32) | after
            order = np.argsort(pair)
            at, own, pair = at[order], own[order], pair[order]
            at = self.ranked(at, pair[1:] != pair[:-1], own)
            size *= 2
        if size <= window:
            self.level, self.ranks = size, self.rank

    def ranked(self, at: np.ndarray, differs: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Ranks of sorted suffixes of which neighbours differ there; those that are still in groups come back."""
        heads = np.concatenate(([0], np.flatnonzero(differs) + 1))
        sizes = np.diff(np.concatenate((heads, [len(at)])))
        groups = own[heads]
        begins = np.concatenate(([0], np.flatnonzero(groups[1:] != groups[:-1]) + 1))  # where the former groups begin
        base = np.repeat(heads[begins], np.diff(np.concatenate((begins, [len(heads)]))))
        self.rank[at] = np.repeat(groups + heads - base, sizes)
        return at[np.repeat(sizes > 1, sizes)]

    def order(self) -> np.ndarray:
        out = np.empty(len(self.text), np.int64)
        out[self.rank] = np.arange(len(self.text))
        return out

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of pairs of different suffixes; 0 where they are shorter than a window."""
        n, window, level = len(self.text), self.window, self.level
        out = np.zeros(len(a), np.int64)
        some = np.flatnonzero(np.maximum(a, b) + window <= n)
        if window < 8:
            keep = np.ones(len(some), bool)
            for i in range(window):
                keep &= self.text[a[some] + i] == self.text[b[some] + i]
        else:
            keep = np.ones(len(some), bool)
            for i in {*range(0, window - level, level), window - level}:
                keep &= self.ranks[a[some] + i] == self.ranks[b[some] + i]
        some = some[keep]
        x, y = a[some] + window, b[some] + window
        for size, values in ((level, self.ranks), (8, self.first), (1, self.text)):
            on = np.flatnonzero(np.maximum(x, y) + size <= n)
            while len(on):
                on = on[values[x[on]] == values[y[on]]]
                x[on] += size
                y[on] += size
                on = on[np.maximum(x[on], y[on]) + size <= n]
        out[some] = x - a[some]
        return out


class RunIndex:
    """A run-compressed transform of a text: the letters of its runs, and samples (position, match length) at both ends of each."""

    def __init__(self, text: np.ndarray, window: int):
        made = Order(text, window)
        order = made.order()
        before = np.where(order > 0, text[order - 1].astype(np.int16), 256)
        change = before[1:] != before[:-1]
        heads = np.flatnonzero(np.concatenate(([True], change)))
        ends = np.flatnonzero(np.concatenate((change, [True])))
        self.size, self.runs = len(text), before[heads]
        self.heads, self.ends = order[heads], order[ends]
        # a run's first suffix with the one before it in order, its last with the one after it
        self.up = np.concatenate(([0], made.common(order[heads[1:] - 1], order[heads[1:]])))
        self.down = np.concatenate((made.common(order[ends[:-1]], order[ends[:-1] + 1]), [0]))

    def matches(self) -> np.ndarray:
        """Matching statistics of the text against itself: for each byte, the longest string from it on that starts elsewhere too,
        where that is a window or more; only the samples are read."""
        places = np.arange(self.size)
        out = np.zeros(self.size, np.int64)
        for at, length in ((self.heads, self.up), (self.ends, self.down)):
            reach = np.zeros(self.size, np.int64)
            reach[at] = length + at
            out = np.maximum(out, np.maximum.accumulate(reach) - places)
        return out


def repeated_starts(strings: list[bytes], many: list[bool], window: int) -> list[np.ndarray]:
    """For each of these different strings: where windows start in it that also start elsewhere. `many`: it stands in several places,
    so all its windows do."""
    text = np.frombuffer(GAP.join(strings) + GAP, np.uint8)
    gaps = np.flatnonzero(text == GAP[0])
    rest = np.repeat(gaps, np.diff(np.concatenate(([-1], gaps)))) - np.arange(len(text))
    hit = np.flatnonzero(np.minimum(RunIndex(text, window).matches(), rest) >= window)
    starts = np.concatenate(([0], gaps[:-1] + 1))
    cuts = np.searchsorted(hit, np.concatenate((starts, [len(text)])))
    return [np.arange(len(s) - window + 1) if m else hit[a:b] - at for s, m, a, b, at in zip(strings, many, cuts, cuts[1:], starts)]


def starts_of_group(strings: list[bytes], many: list[bool], window: int, gram: int, limit: int) -> list[np.ndarray]:
    """`repeated_starts` of one minimiser's strings; where they are more than an index holds, they are cut again by longer
    minimisers, at last by whole windows, and equal parts are counted once."""
    if sum(map(len, strings)) <= limit or gram >= window:
        return repeated_starts(strings, many, window)
    gram = min(3 * gram, window)
    groups: dict[int, dict[bytes, list[tuple[int, int, bool]]]] = {}
    for i, s in enumerate(strings):
        for a, b, key, twice in pieces(s, window, gram):
            groups.setdefault(key, {}).setdefault(s[a:b], []).append((i, a, twice))
    found: list[list[np.ndarray]] = [[] for _ in strings]
    for group in groups.values():
        parts = list(group)
        several = [len(group[p]) > 1 or many[group[p][0][0]] for p in parts]
        if len(parts) > 1 or several[0] or group[parts[0]][0][2]:
            for part, hits in zip(parts, starts_of_group(parts, several, window, gram, limit)):
                for i, a, _ in group[part]:
                    found[i].append(a + hits)
    return [np.unique(np.concatenate(f)) if f else np.zeros(0, np.int64) for f in found]


def pack(rows: list[tuple[int, int, int, int, bytes]]) -> bytes:
    """Rows (minimiser, flags, document, start, string)."""
    body = GAP.join(r[4] for r in rows)
    head = b"".join(np.array([r[i] for r in rows], kind).tobytes() for i, kind in ((0, "<u8"), (1, "<u1"), (2, "<i8"), (3, "<i4")))
    return zstandard.compress(HEAD.pack(len(rows), len(body)) + head + body, 3)


def unpack(block: bytes) -> list[tuple[int, int, int, int, bytes]]:
    raw = zstandard.decompress(block)
    n, size = HEAD.unpack_from(raw)
    at, columns = HEAD.size, []
    for kind, width in (("<u8", 8), ("<u1", 1), ("<i8", 8), ("<i4", 4)):
        columns.append(np.frombuffer(raw, kind, n, at).tolist())
        at += n * width
    return list(zip(*columns, raw[at : at + size].split(GAP)))


def cut(ids: list[int], texts: list[str], window: int, gram: int, buckets: int, hot: np.ndarray | None = None, wide: int = 0):
    """Rows (bucket, block, document, begin, stop): blocks of pieces, and ranges of pieces that this task saw twice."""
    seen: dict[bytes, list] = {}
    again_docs, again_at, again_size = [], [], []
    for doc, t in zip(ids, texts):
        raw = (t or "").encode("utf-8", "surrogatepass") if doc is not None else b""
        for at in range(0, max(0, len(raw) - window + 1), LINE):
            line = raw[at : at + LINE + window - 1]
            for a, b, key, twice in pieces(line, window, gram, hot, wide):
                s, place = line[a:b], (doc, at + a)
                old = seen.get(s)
                if old is None:
                    seen[s] = [key, TWICE * twice, place]
                elif old[2] != place:
                    if not old[1] & MANY:
                        old[1] |= MANY
                        again_docs.append(old[2][0])
                        again_at.append(old[2][1])
                        again_size.append(len(s))
                    again_docs.append(doc)
                    again_at.append(at + a)
                    again_size.append(len(s))
    for d, a, n in zip(again_docs, again_at, again_size):
        yield None, None, d, a, a + n
    dealt: dict[int, list] = {}
    for s, (key, flags, (doc, at)) in seen.items():
        dealt.setdefault(key % buckets, []).append((key, flags, doc, at, s))
    for bucket, rows in dealt.items():
        yield bucket, pack(rows), None, None, None


def count_bucket(blocks: list[bytes], window: int, gram: int, limit: int):
    """Ranges (document, begin, stop) of the repeated windows of one bucket."""
    groups: dict[int, dict[bytes, list]] = {}  # by minimiser: of each piece its flags and the places that no task has told of
    for block in blocks:
        for key, flags, doc, at, s in unpack(block):
            own = groups.setdefault(key, {}).setdefault(s, [0, {}])
            if flags & MANY:
                own[1].pop((doc, at), None)
            else:
                own[1][doc, at] = None
            own[0] |= flags | (MANY if len(own[1]) > 1 else 0)
    out = []
    waiting: list[dict[bytes, list]] = []

    def report(group: dict[bytes, list], starts: list[np.ndarray]) -> None:
        for (s, (flags, places)), hits in zip(group.items(), starts):
            if len(hits):
                a, b = ranges(np.zeros(len(hits), np.int64), hits, window)[1:]
                out.extend((doc, at + x, at + y) for doc, at in places for x, y in zip(a.tolist(), b.tolist()))

    def work() -> None:
        if waiting:
            whole = {s: v for g in waiting for s, v in g.items()}
            report(whole, repeated_starts(list(whole), [bool(v[0] & MANY) for v in whole.values()], window))
        waiting.clear()

    held = 0
    for group in groups.values():
        if len(group) < 2:
            s, (flags, _) = next(iter(group.items()))
            if not flags & (TWICE | MANY):
                continue
            if not flags & TWICE:  # nothing to compare it with
                report(group, [np.arange(len(s) - window + 1)])
                continue
        size = sum(map(len, group)) + len(group)
        if size > limit:
            report(group, starts_of_group(list(group), [bool(v[0] & MANY) for v in group.values()], window, gram, limit))
            continue
        if held + size > limit:
            work()
            held = 0
        waiting.append(group)
        held += size
    work()
    return out


def window_keys(texts: list[str | None], window: int, gram: int) -> np.ndarray:
    """Minimisers of the windows of texts."""
    found = [np.zeros(0, np.uint64)]
    for t in texts:
        raw = (t or "").encode("utf-8", "surrogatepass")
        for at in range(0, max(0, len(raw) - window + 1), LINE):
            found.append(least(gram_hashes(np.frombuffer(raw[at : at + LINE + window - 1], np.uint8), gram, gram), window - gram + 1))
    return np.concatenate(found)


def repeated_ranges(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, wide: int = WIDE, buckets: int | None = None,
                    index_bytes: int = INDEX, hot: float = HOT) -> DataFrame:
    """(doc_id, begin, stop): ranges of bytes that repeated windows cover; they may overlap.

    The number of buckets follows the bytes of the texts. A minimiser that has more than `hot` times a bucket's mean share of the
    windows doesn't meet in one bucket: its windows are dealt by their least hash of `wide` bytes.
    """
    size = text_bytes(docs, text_col)
    buckets = buckets or bucket_count(size, TRAVEL)
    gram = min(gram, window)
    wide = min(max(wide, gram), window)
    frequent = hot_keys(docs, lambda texts: window_keys(texts, window, gram), id_col=id_col, text_col=text_col, size=size, buckets=buckets, hot=hot)
    ddl = "bucket int, block binary, doc_id long, begin int, stop int"
    schema, out = arrow_schema(ddl), arrow_schema("doc_id long, begin int, stop int")

    def split(batches):
        claim(__name__)
        for part in slices(batches, SLICE):
            rows, size = [], 0
            for row in cut(part.column(0).to_pylist(), part.column(1).to_pylist(), window, gram, buckets, frequent, wide):
                rows.append(row)
                size += len(row[1] or b"") + 40
                if size > SLICE:
                    yield rows_batch(rows, schema)
                    rows, size = [], 0
            yield rows_batch(rows, schema)

    def count(table: pa.Table) -> pa.Table:
        rows = count_bucket([b for b in table.column("block").to_pylist() if b is not None], window, gram, index_bytes)
        found = table.select(["doc_id", "begin", "stop"]).drop_null()
        return pa.concat_tables([found.cast(out), pa.Table.from_batches([rows_batch(rows, out)])])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(split, ddl)
    dealt = rows.withColumn("bucket", F.coalesce("bucket", F.pmod(F.xxhash64("doc_id", "begin"), F.lit(buckets)).cast("int")))
    return dealt.groupBy("bucket").applyInArrow(count, "doc_id long, begin int, stop int")


def dedup_bytes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, wide: int = WIDE, buckets: int | None = None,
                index_bytes: int = INDEX, hot: float = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes left) and spans (maximal removed ranges of bytes).

    A byte goes if a string of `window` bytes covers it that also starts elsewhere, in its own document or another; all
    such strings go, the first included. Strings are judged on the input and lie in one document. Null and short texts lose
    nothing. Rows that repeat a row are the same document; ids of different texts must differ, and are numbers or numerals. Rows
    with a null id lose nothing and count as no copy. An empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{id_col}`").cast("long").alias("key"))
    found = repeated_ranges(docs, id_col=id_col, text_col=text_col, window=window, gram=gram, wide=wide, buckets=buckets, index_bytes=index_bytes, hot=hot)
    found = found.groupBy(F.col("doc_id").alias("key")).agg(F.collect_list(F.struct("begin", "stop")).alias("found"))

    def keep(ids, texts, found):
        made = {"doc_id": ids, "n_bytes": [], "n_removed": [], "n_spans": [], "kept": [], "spans": []}
        for t, f in zip(texts, found):
            raw = (t or "").encode("utf-8", "surrogatepass")
            own = merged([(x["begin"], x["stop"]) for x in f or ()])
            made["n_bytes"].append(len(raw))
            made["n_removed"].append(sum(b - a for a, b in own))
            made["n_spans"].append(len(own))
            made["spans"].append([{"begin": a, "stop": b} for a, b in own])
            edges = [0, *(x for span in own for x in span), len(raw)]
            made["kept"].append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
        return made

    return map_columns(rows.join(found, "key", "left"), {"doc_id": "doc_id", "text": "text", "found": "found"}, keep,
                       f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<begin:int,stop:int>>")
