"""How the sources of a language differ in their words: exact divergences between all pairs, and the words that mark each source.

A divergence adds up a price over all words, and the price hangs only on how often the word occurs in the two sources. So words with the
same two counts are one entry of a joint table. With a column of zeros and ones for each (source, count), the product of the words'
matrix with its own transpose holds the joint tables of all pairs of sources at once. It is worked out in blocks of words and tiles of
columns whose entries stay small enough for floating point to be exact; blocks are summed by Spark, and the tables are priced at last.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.arrow import arrow_schema, slices
from colloquy.llm.bpe import claim
from colloquy.llm.shared import written

#: Letters and all bytes beyond ASCII stand for themselves, capitals for small letters; everything else parts words.
LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256)).lower()
MIN_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
#: Bytes of a text that are split at a time, and words that a task counts before it sends them on.
PIECE, HELD = 1 << 20, 400_000
#: Counts above zero in a block of words (one word at least), columns of a tile, and entries of joint tables that a task holds.
BLOCK, TILE, ENTRIES = 4096, 1024, 400_000


def words_of(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, as lists of those of a piece of it."""
    raw = raw.translate(LETTERS)
    at = 0
    while at < len(raw):
        to = raw.find(b" ", at + PIECE)
        to = len(raw) if to < 0 else to
        yield raw[at:to].split()
        at = to


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents) of (lang, source, text), counted within a task as far as memory goes."""
    out = arrow_schema("lang string, source string, term string, n long, d long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        held: dict[tuple, tuple[Counter, Counter]] = {}

        def made() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in held.items():
                terms = pa.array(list(n), pa.binary()).cast(pa.string())
                size = len(terms)
                columns = [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), terms, pa.array(list(n.values()), pa.int64()), pa.array([d[t] for t in n], pa.int64())]
                for at in range(0, size, 1 << 16):
                    yield pa.RecordBatch.from_arrays([c.slice(at, 1 << 16) for c in columns], schema=out)
            held.clear()

        for part in slices(batches, 4 << 20):
            for lang, source, text in zip(*(part.column(i).to_pylist() for i in range(3))):
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                own: set = set()
                for words in words_of(text):
                    n.update(words)
                    own.update(words)
                d.update(own)
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from made()
        yield from made()

    return docs.mapInArrow(run, "lang string, source string, term string, n long, d long")


def kept_terms(docs: DataFrame, min_docs: int) -> DataFrame:
    """lang, term, total, own (source and n of each source that has it) of terms in so many documents of the language.

    Counts go by language and term once; both groupings below are within what that deals together.
    """
    counts = word_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    both = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("d").alias("d"), F.collect_list(F.struct("source", "n")).alias("own"))
    return both.where(F.col("d") >= min_docs).select("lang", "term", "total", "own")


def joint(sources: np.ndarray, levels: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(g, a, h, b, n) of one block of words: their columns of zeros and ones, times their transpose, tile by tile; each pair of columns once."""
    values, level = np.unique(levels, return_inverse=True)
    columns, at = np.unique(sources * len(values) + level, return_inverse=True)
    source, level = columns // len(values), values[columns % len(values)]
    tiles = []
    for lo in range(0, len(columns), TILE):
        some = (at >= lo) & (at < lo + TILE)
        tile = np.zeros((int(rows[-1]) + 1, min(TILE, len(columns) - lo)), np.float32)
        tile[rows[some], at[some] - lo] = 1
        tiles.append(tile)
    for i, left in enumerate(tiles):
        for j in range(i, len(tiles)):
            table = left.T @ tiles[j]  # sums of ones, as many as there are words at most, which are exact
            x, y = np.nonzero(np.triu(table) if i == j else table)
            n = table[x, y].astype(np.int64)
            x, y = x + i * TILE, y + j * TILE
            yield source[x], level[x], source[y], level[y], n


def joint_tables(terms: DataFrame) -> DataFrame:
    """lang, g, a, h, b, n: how many terms occur a times in source g and b times in h, for g < h; and for g = h and a = b, how many occur a
    times in g. Counts of zero have no entries.
    """
    schema = "lang string, g string, a long, h string, b long, n long"
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        known: dict[str, int] = {}  # sources of this task
        found: dict[str, list[tuple]] = {}
        held = 0

        def summed(lang: str) -> pa.Table:
            columns = [np.concatenate(c) for c in zip(*found[lang])]
            return pa.table(columns, names=["g", "a", "h", "b", "n"]).group_by(["g", "a", "h", "b"]).aggregate([("n", "sum")])

        def made(lang: str, table: pa.Table) -> Iterator[pa.RecordBatch]:
            names = pa.array(list(known), pa.string())
            places = np.argsort(np.argsort(np.array(list(known), object)))
            g, a, h, b = (table.column(c).to_numpy() for c in "gahb")
            turn = places[g] > places[h]
            g, a, h, b = np.where(turn, h, g), np.where(turn, b, a), np.where(turn, g, h), np.where(turn, a, b)
            columns = [pa.array([lang] * len(g), pa.string()), names.take(pa.array(g)), pa.array(a), names.take(pa.array(h)), pa.array(b), table.column("n_sum").combine_chunks()]
            for at in range(0, len(g), 1 << 16):
                yield pa.RecordBatch.from_arrays([c.slice(at, 1 << 16) for c in columns], schema=out)

        for part in slices(batches, 4 << 20):
            langs, own = part.column(0).to_pylist(), part.column(1)
            ends = own.offsets.to_numpy()
            sources, levels = own.values.slice(ends[0], ends[-1] - ends[0]).flatten()
            ends = ends - ends[0]
            coded = sources.dictionary_encode()
            ids = np.array([known.setdefault(x, len(known)) for x in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
            levels = levels.to_numpy()
            at = 0
            while at < len(langs):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK, "right")) - 1)
                to = next((i for i in range(at + 1, min(to, len(langs))) if langs[i] != langs[at]), min(to, len(langs)))
                rows = np.repeat(np.arange(to - at), np.diff(ends[at : to + 1]))
                for entries in joint(ids[ends[at] : ends[to]], levels[ends[at] : ends[to]], rows):
                    found.setdefault(langs[at], []).append(entries)
                    held += len(entries[0])
                at = to
                if held > ENTRIES:
                    tables, held = {lang: summed(lang) for lang in found}, 0
                    for lang, table in tables.items():
                        found[lang] = [tuple(table.column(c).to_numpy() for c in ("g", "a", "h", "b", "n_sum"))]
                        held += table.num_rows
                    if held > ENTRIES // 2:
                        for lang, table in tables.items():
                            yield from made(lang, table)
                        found, held = {}, 0
        for lang in found:
            yield from made(lang, summed(lang))

    # words of like frequency stand together: rare ones share few columns
    each = terms.sortWithinPartitions("lang", "total").select("lang", "own").mapInArrow(run, schema)
    return each.groupBy("lang", "g", "a", "h", "b").agg(F.sum("n").alias("n"))


def chance(n: str, total: str, size: str, scale: int) -> str:
    """One more than the scaled share of a term with n of `total` occurrences, each of the `size` terms having one more; all exact."""
    return f"(1 + (cast({n} + 1 as decimal(19, 0)) * cast({scale} as decimal(12, 0))) div cast({total} + {size} as decimal(19, 0)))"


def price(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def divergences(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, scale: int = SCALE) -> DataFrame:
    """lang, source, part, item, value, rank: for each (lang, source) of the documents, the divergence from each other source of the language
    (part `pair`), and the `top` terms that it has more often than the language (part `term`).

    Nulls are read as empty; a row is a document, so repeated rows count each; a group without terms has pairs all the same (value 0 if the
    language keeps no term); ties in value stand by item; further columns don't matter; an empty table gives no rows.
    """
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    own = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).cast("binary").alias("text"))
    terms = written(kept_terms(own, min_docs), "terms")
    langs = terms.groupBy("lang").agg(F.count("*").alias("size"), F.sum("total").alias("all"))
    sums = terms.select("lang", F.explode("own").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("total"))
    groups = own.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "size", "all"])
    groups = written(groups, "groups")
    joint = written(joint_tables(terms), "joint")

    left = groups.select("lang", F.col("source").alias("g"), F.col("total").alias("g_total"), "size")
    right = groups.select("lang", F.col("source").alias("h"), F.col("total").alias("h_total"))
    p, q, p0, q0 = chance("a", "g_total", "size", scale), chance("b", "h_total", "size", scale), chance("0", "g_total", "size", scale), chance("0", "h_total", "size", scale)
    chances = lambda df, **x: df.selectExpr("*", *(f"{v} AS {k}" for k, v in x.items()))
    exact = lambda n, e: F.expr(f"cast({n} as decimal(19, 0)) * cast({e} as decimal(19, 0))").alias("value")
    # what a joint entry adds to words that occur in neither, in g alone and in h alone
    met = joint.where("g <> h")
    met = met.unionByName(met.selectExpr("lang", "h AS g", "b AS a", "g AS h", "a AS b", "n"))
    met = chances(met.join(left, ["lang", "g"]).join(right, ["lang", "h"]), p=p, q=q, p0=p0, q0=q0)
    both = met.select("lang", "g", "h", exact("n", f"({price('p', 'q')}) - ({price('p', 'q0')}) - ({price('p0', 'q')}) + ({price('p0', 'q0')})"))
    some = joint.where("g = h").select("lang", "g", "a", "n")
    here = chances(some.join(left, ["lang", "g"]).join(right, "lang").where("g <> h"), p=p, p0=p0, q0=q0).select("lang", "g", "h", exact("n", f"({price('p', 'q0')}) - ({price('p0', 'q0')})"))
    there = some.selectExpr("lang", "g AS h", "a AS b", "n").join(right, ["lang", "h"]).join(left, "lang").where("g <> h")
    there = chances(there, q=q, p0=p0, q0=q0).select("lang", "g", "h", exact("n", f"({price('p0', 'q')}) - ({price('p0', 'q0')})"))
    pairs = left.join(right, "lang").where("g <> h")
    filled = chances(pairs.where("size > 0"), p0=p0, q0=q0).select("lang", "g", "h", exact("size", price("p0", "q0")))
    none = pairs.where("size = 0").select("lang", "g", "h", F.lit(0).cast("decimal(38, 0)").alias("value"))
    value = filled.unionByName(none).unionByName(both).unionByName(here).unionByName(there).groupBy("lang", "g", "h").agg(F.sum("value").cast("long").alias("value"))
    ranked = lambda: F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    pair = value.select("lang", F.col("g").alias("source"), F.lit("pair").alias("part"), F.col("h").alias("item"), "value").withColumn("rank", ranked())

    said = terms.select("lang", "term", F.col("total").alias("b"), F.explode("own").alias("x")).select("lang", "term", "b", F.col("x.source").alias("source"), F.col("x.n").alias("a"))
    said = said.join(groups.select("lang", "source", F.col("total").alias("g_total"), "size", F.col("all").alias("h_total")), ["lang", "source"])
    more = chances(said, p=p, q=q).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(price("p", "q")).alias("value"))
    term = more.withColumn("rank", ranked()).where(F.col("rank") <= top)
    return pair.unionByName(term)
