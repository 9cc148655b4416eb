"""Near-duplicates by circulant MinHash: signatures from two permutations, bands that propose, whole shingle sets that decide.

The first permutation places each shingle on a ring of 2**32 slots. The second one orders the slots; shifted along the ring by k it gives
coordinate k of the signature, the least place that a text's shingles get. So two permutations make all coordinates, and two texts agree in
each with a probability that is the similarity of their sets.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.arrow import map_columns
from colloquy.llm.components import components
from colloquy.llm.rolling import BASE, joined, mixed, piece_hashes
from colloquy.llm.shared import written
from colloquy.llm.simhash import fingerprint_of
from colloquy.llm.simhash import links as fingerprint_links

#: Two texts of similarity s share none of the bands with a probability of (1 - s ** DEEP) ** BANDS: at 0.8 five in ten million.
BANDS, DEEP = 48, 6
#: All pairs of a bucket of up to this many nodes are looked at; nodes of larger ones are compared in blocks of so many.
CROWD, BLOCK = 32, 512
#: Bytes of text that are hashed at a time, and shingles whose coordinates are worked out at a time.
SLICE, CHUNK = 3 << 20, 1 << 15


def shingle_sets(texts: list[str | None], shingle: int) -> list[np.ndarray]:
    """For each text the different hashes of its shingles, sorted; none for null and blank texts.

    Words are what stands between ASCII blanks, A-Z in lower case; a text of fewer words is one shingle of its own kind.
    """
    lines = [b" ".join((t or "").encode("utf-8", "surrogatepass").lower().split()) for t in texts]
    raw = np.frombuffer(b"\n".join(lines), np.uint8)
    breaks = np.flatnonzero((raw == 32) | (raw == 10))
    starts, ends = np.concatenate(([0], breaks + 1)), np.concatenate((breaks, [len(raw)]))
    words = piece_hashes(raw, starts, ends)
    last = np.concatenate((np.flatnonzero(raw[breaks] == 10), [len(words) - 1]))
    first = np.concatenate(([0], last[:-1] + 1))
    runs, out = joined(words, shingle), []
    for a, b, line in zip(first.tolist(), last.tolist(), lines):
        if not line:
            out.append(np.empty(0, np.uint64))
        elif b - a + 1 < shingle:
            out.append(mixed(joined(words[a : b + 1], b - a + 1) + np.uint64(b - a + 1)))
        else:
            out.append(np.unique(runs[a : b - shingle + 2]))
    return out


def ring(hashes: np.ndarray) -> np.ndarray:
    """The first permutation: slots of 64-bit hashes on a ring of 2**32."""
    return (mixed(hashes ^ np.uint64(BASE)) >> np.uint64(32)).astype(np.uint32)


def shifted(slots: np.ndarray, k: int, out: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """The second permutation, shifted by k: the place of each slot. Each line is one-to-one on 32 bits."""
    np.add(slots, np.uint32(k), out=out)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        np.right_shift(out, np.uint32(shift), out=spare)
        np.bitwise_xor(out, spare, out=out)
        np.multiply(out, np.uint32(factor), out=out)
    np.right_shift(out, np.uint32(16), out=spare)
    return np.bitwise_xor(out, spare, out=out)


def signatures(sets: list[np.ndarray], size: int = BANDS * DEEP) -> np.ndarray:
    """Coordinates of each set's signature; those of an empty set are all the largest place."""
    least = np.full((len(sets), size), np.iinfo(np.uint32).max, np.uint32)
    slots = [ring(s) for s in sets]
    at = 0
    while at < len(sets):
        to, total = at, 0
        while to < len(sets) and (to == at or total + len(slots[to]) <= CHUNK):
            total += len(slots[to])
            to += 1
        some = [i for i in range(at, to) if len(slots[i])]
        at = to
        if not some:
            continue
        flat = np.concatenate([slots[i] for i in some])
        starts = np.concatenate(([0], np.cumsum([len(slots[i]) for i in some])[:-1]))
        for lo in range(0, len(flat), 1 << 20):  # one set alone may be longer
            part = flat[lo : lo + (1 << 20)]
            out, spare = np.empty_like(part), np.empty_like(part)
            own = starts if len(some) > 1 else [0]
            for k in range(size):
                least[some, k] = np.minimum(least[some, k], np.minimum.reduceat(shifted(part, k, out, spare), own))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A signed 64-bit key for each signature and band."""
    deep = np.cumprod(np.full(DEEP, BASE, np.uint64))
    own = (mixed(least.reshape(len(least), BANDS, DEEP).astype(np.uint64) + np.uint64(1)) * deep).sum(axis=2, dtype=np.uint64)
    return mixed(own + np.arange(BANDS, dtype=np.uint64) * np.uint64(BASE)).view(np.int64)


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the intersection is that share of the union (sorted sets)."""
    if not len(a) or not len(b):
        return len(a) == len(b)
    small, large = (a, b) if len(a) < len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketches(docs: DataFrame, *, id_col: str, text_col: str, shingle: int, simhash: bool = False) -> DataFrame:
    """doc_id, own (128-bit digest of the shingle set), n (its size), bands and, if asked for, fp (SimHash of the set) of whole texts."""

    def run(ids, texts):
        sets = shingle_sets(texts, shingle)
        bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(band_keys(signatures(sets)).reshape(-1), pa.int64()))
        made = {"doc_id": ids, "own": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "n": list(map(len, sets)), "bands": bands}
        return made | {"fp": [fingerprint_of(mixed(s)) for s in sets]} if simhash else made

    kind = docs.schema[id_col].dataType.simpleString()
    return map_columns(docs, {"doc_id": id_col, "text": text_col}, run, f"doc_id {kind}, own binary, n long, bands array<long>" + ", fp long" * simhash, SLICE)


def stored_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """node and shingles (the sorted hashes, eight bytes each) of texts (node, text), each set of a node once."""
    kind = texts.schema["node"].dataType.simpleString()

    def run(nodes, texts):
        sets = [s.tobytes() for s in shingle_sets(texts, shingle)]
        return {"node": nodes, "own": list(map(xxhash.xxh3_128_digest, sets)), "shingles": sets}

    rows = map_columns(texts, {"node": "node", "text": "text"}, run, f"node {kind}, own binary, shingles binary", SLICE)
    return rows.dropDuplicates(["node", "own"]).drop("own")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets (node, shingles) are as similar as that; written."""
    kind = pairs.schema["a"].dataType.simpleString()

    def run(a, b, x, y):
        own = functools.lru_cache(256)(lambda s: np.frombuffer(s, np.uint64))
        keep = [alike(own(s), own(t), percent) for s, t in zip(x, y)]
        return {"a": [i for i, k in zip(a, keep) if k], "b": [i for i, k in zip(b, keep) if k]}

    left, right = (sets.select(F.col("node").alias(c), F.col("shingles").alias(t)) for c, t in (("a", "x"), ("b", "y")))
    return written(map_columns(pairs.join(left, "a").join(right, "b"), {c: c for c in "abxy"}, run, f"a {kind}, b {kind}"), "links")


def fingerprint_pairs(nodes: DataFrame, distance: int, percent: int) -> DataFrame:
    """a, b: pairs of nodes (node, n, fp) that SimHash links: those of one fingerprint by their least node, and these by multi-index hashing."""
    least = written(nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("p")), "fingerprints")
    same = nodes.join(least, "fp").where("node <> p.node").select("p", F.struct("node", "n").alias("q"))
    links = fingerprint_links(least.select("fp"), distance).distinct()
    near = links.join(least.withColumnRenamed("fp", "a"), "a").join(least.withColumnsRenamed({"fp": "b", "p": "q"}), "b").select("p", "q")
    return same.unionByName(near).where(sizes("p.n", "q.n", percent)).select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b"))


def buckets(nodes: DataFrame) -> DataFrame:
    """key, node, n, leader: buckets that several nodes (node, n, bands) share, a row for each node; the leader is the least node, with its n."""
    rows = nodes.select("node", "n", F.explode("bands").alias("key"))
    several = rows.groupBy("key").agg(F.count("*").alias("many"), F.min(F.struct("node", "n")).alias("leader")).where("many > 1")
    return rows.join(several.select("key", "leader"), "key")


def sizes(x: str, y: str, percent: int) -> str:
    """Sizes x and y of sets that can be as similar as that."""
    return f"100 * least({x}, {y}) >= {percent} * greatest({x}, {y})"


def labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Rows with the label of their node: the least node that the links reach."""
    return rows.join(components(links), "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")


def unsettled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """key, node, n, centre, label, many, major of the buckets (key, node, n, centre) whose nodes aren't all linked yet, and the label that most of them have."""
    rows = written(labelled(rows.select("key", "node", "n", "centre"), links), "labelled")
    share = rows.groupBy("key", "label").agg(F.count("*").alias("c"))
    state = share.groupBy("key").agg(F.sum("c").alias("many"), F.count("*").alias("labels"), F.max_by("label", F.struct("c", "label")).alias("major")).where("labels > 1")
    return written(rows.join(state.select("key", "many", "major"), "key"), "unsettled")


def in_small(rows: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of differently labelled nodes of the same small bucket."""
    lists = rows.groupBy("key").agg(F.collect_list(F.struct("node", "n", "label")).alias("all"))
    other = f"p.node < q.node and p.label <> q.label and {sizes('p.n', 'q.n', percent)}"
    return lists.select(F.expr(f"explode(flatten(transform(all, p -> transform(filter(all, q -> {other}), q -> struct(p.node as a, q.node as b)))))").alias("e")).select("e.*")


def in_blocks(rows: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """a, b: links between differently labelled nodes of the crowded buckets (node, n, centre, label), a link to each label at least that a node has one to.

    Buckets of one centre are taken together. Two sets differ in what one of them, but not the other, differs from the centre in; such differences are
    short, and similarity follows from their sizes exactly. Nodes of other labels than the major one meet all nodes of their centre, block by block,
    so no task has a whole group, and what doesn't link isn't sent on. Pairs within the major label are linked already.
    """
    kind = rows.schema["node"].dataType.simpleString()
    members = rows.select("centre", "node", "label").distinct()
    centres = sets.join(members.select(F.col("centre").alias("node")).distinct(), "node", "left_semi").groupBy(F.col("node").alias("centre")).agg(F.min("shingles").alias("x"))
    met = members.join(sets.select("node", F.col("shingles").alias("y")), "node").join(centres, "centre")

    def apart(centres, nodes, labels, x, y):
        differ = [np.setxor1d(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64), assume_unique=True).tobytes() for s, t in zip(x, y)]
        return {"centre": centres, "node": nodes, "n": [len(t) // 8 for t in y], "label": labels, "differ": differ}

    columns = {c: c for c in ("centre", "node", "label", "x", "y")}
    own = written(map_columns(met, columns, apart, f"centre {kind}, node {kind}, n long, label {kind}, differ binary"), "differences")
    share = own.groupBy("centre", "label").agg(F.count("*").alias("c"))
    major = share.groupBy("centre").agg(F.sum("c").alias("many"), F.max_by("label", F.struct("c", "label")).alias("major"), F.max("c").alias("most")).select("centre", "many", "major", (F.col("many") - F.col("most")).alias("few"))
    parts = lambda n: F.ceil(F.col(n) / block).cast("int")
    at = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), parts(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), parts(n) - 1))
    placed = own.join(major.where("few > 0"), "centre").withColumn("p", F.struct("node", "n", "label", "differ"))
    left = placed.where("label <> major").select("centre", at("few", 1).alias("i"), every("many").alias("j"), "p").groupBy("centre", "i", "j").agg(F.collect_list("p").alias("left"))
    right = placed.select("centre", at("many", 2).alias("j"), every("few").alias("i"), "p").groupBy("centre", "i", "j").agg(F.collect_list("p").alias("right"))

    def compare(lefts, rights):
        a, b = [], []
        for some, others in zip(lefts, rights):
            own = [np.frombuffer(q["differ"], np.uint64) for q in others]
            owner, flat = np.repeat(np.arange(len(own)), list(map(len, own))), np.concatenate(own)
            order = np.argsort(flat)
            owner, flat = owner[order], flat[order]
            length, n = np.array(list(map(len, own))), np.array([q["n"] for q in others])
            labels = [q["label"] for q in others]
            for p in some:
                mine = np.frombuffer(p["differ"], np.uint64)
                lo, hi = np.searchsorted(flat, mine, "left"), np.searchsorted(flat, mine, "right")
                some_ = hi > lo
                hits = np.concatenate([owner[x:y] for x, y in zip(lo[some_].tolist(), hi[some_].tolist())]) if some_.any() else owner[:0]
                differ = len(mine) + length - 2 * np.bincount(hits, minlength=len(own))
                both = p["n"] + n
                found = {}
                for i in np.flatnonzero(100 * (both - differ) >= percent * (both + differ)).tolist():
                    if labels[i] != p["label"]:
                        found.setdefault(labels[i], others[i]["node"])
                a += [p["node"]] * len(found)
                b += found.values()
        return {"a": a, "b": b}

    return map_columns(left.join(right, ["centre", "i", "j"]), {"left": "left", "right": "right"}, compare, f"a {kind}, b {kind}")


def unlinked(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The pairs (a, b) that the links don't connect."""
    label = written(components(links), "labels")
    apart = pairs.join(label.withColumnsRenamed({"node": "a", "root": "ra"}), "a", "left").join(label.withColumnsRenamed({"node": "b", "root": "rb"}), "b", "left")
    return apart.where("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b")


def links_of(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, crowd: int, block: int, simhash: int | None = None) -> DataFrame:
    """a, b: links that connect all nodes (node, n, bands) that share a band and are as similar as that; `sets_of(nodes)`: their sets.

    With `simhash`, nodes (with fp too) whose fingerprints multi-index hashing links at that distance come first, where their sets are as similar;
    bands have to find the rest. Then each node meets the least of its buckets' leaders, then all of them; a bucket whose nodes are all connected by
    then is settled. In others a new leader, of the labels that are few, takes its turn as long as that settles half of them. What is left is
    compared pair by pair, in crowded buckets by blocks. A leader leaves its bucket after it has met all nodes there, so nothing stays uncompared.
    """
    rows = written(buckets(nodes), "buckets")
    wanted = rows.select("node")
    if simhash is not None:
        pairs = written(fingerprint_pairs(nodes, simhash, percent), "simhash")
        wanted = wanted.unionByName(pairs.select(F.explode(F.array("a", "b")).alias("node")))
    sets = written(sets_of(wanted.distinct()), "shingles")
    met = rows.where(f"node <> leader.node and {sizes('n', 'leader.n', percent)}").select(F.col("leader.node").alias("a"), F.col("node").alias("b"))
    links = None
    if simhash is not None:
        links = verified(pairs, sets, percent)
        met = written(unlinked(met.distinct(), links), "met")
    first = verified(met.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), sets, percent)
    links = first if links is None else links.unionByName(first)
    links = links.unionByName(verified(unlinked(met.distinct(), links), sets, percent))
    rows, before = rows.where("node <> leader.node").select("key", "node", "n", F.col("leader.node").alias("centre")), None
    while True:
        rows = unsettled(rows, links)
        few = rows.where(f"many > {crowd} and label <> major").count()
        if not few or before is not None and few > before / 2:
            break
        before = few
        leaders = rows.where(f"many > {crowd} and label <> major").groupBy("key").agg(F.min(F.struct("node", "n", "label")).alias("leader"))
        led = rows.join(leaders, "key", "left")
        found = led.where(f"node <> leader.node and label <> leader.label and {sizes('n', 'leader.n', percent)}").select(F.least("node", "leader.node").alias("a"), F.greatest("node", "leader.node").alias("b"))
        links = links.unionByName(verified(found.distinct(), sets, percent))
        rows = led.where("leader is null or node <> leader.node")
    links = links.unionByName(verified(in_small(rows.where(f"many <= {crowd}"), percent).distinct(), sets, percent))
    return links.unionByName(written(in_blocks(rows.where(f"many > {crowd}"), sets, percent, block), "links")) if few else links


def near_groups(docs: DataFrame, *, shingle: int, percent: int = 80, blank_alike: bool = False, simhash: int | None = None, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD,
                block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles (set size), component_id (the smallest doc_id that links reach), kept (doc_id = component_id), a row for each row.

    Two documents are linked if their sets' intersection is at least `percent` of the union. Equal sets are one node from the start, so copies
    cost a digest each. With `simhash`, SimHash fingerprints of the sets within that distance (3 at most) propose pairs before the bands do.
    Null and blank texts have no shingles and are linked with nothing, or with each other if `blank_alike`. Rows with a null
    id stand alone: their component is null and they are kept. Rows that repeat an id are one document, so what they are linked with is linked.
    An empty table gives no rows; further columns don't matter.
    """
    own = written(sketches(docs, id_col=id_col, text_col=text_col, shingle=shingle, simhash=simhash is not None), "sketches")
    named = own.where("doc_id is not null" + ("" if blank_alike else " and n > 0"))
    least = written(named.groupBy("own").agg(F.min("doc_id").alias("node")), "nodes")
    known = named.select("doc_id", "own").join(least, "own").select("doc_id", "node")
    nodes = named.where("n > 0").join(least.withColumnRenamed("node", "doc_id"), ["doc_id", "own"], "left_semi").withColumnRenamed("doc_id", "node").dropDuplicates(["own"])
    # a document of several texts connects their nodes; its id may be the node of each of them
    several = known.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("doc_id", "a")
    again = known.join(several, "doc_id").where("a <> node").select("a", F.col("node").alias("b"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        texts = docs.select(F.col(f"`{id_col}`").alias("node"), F.col(f"`{text_col}`").alias("text")).join(wanted, "node", "left_semi")
        return stored_sets(texts, shingle)

    roots = components(links_of(nodes, sets_of, percent, crowd, block, simhash).unionByName(again))
    placed = least.join(roots, "node", "left").select("own", F.coalesce("root", "node").alias("root"))
    rows = own.select("doc_id", "n", "own").join(placed, "own", "left")
    alone = F.col("doc_id").isNull() if blank_alike else F.col("doc_id").isNull() | (F.col("n") == 0)
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("root"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
