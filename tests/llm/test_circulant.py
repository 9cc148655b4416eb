"""Near-duplicates by circulant MinHash against all pairs of plain sets."""

import random

import numpy as np
from test_training_text import connected, edges, empty

import corpus_pipeline
from colloquy.llm import circulant
from colloquy.llm.circulant import near_groups
from colloquy.llm.rolling import mixed
from colloquy.llm.simhash import fingerprint_of


def plain_set(text, size):
    words = (text or "").lower().split()
    return {tuple(words)} if 0 < len(words) < size else {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def by_force(rows, size=2, blank_alike=False):
    """Sizes, and components of ids, by all pairs."""
    sets = [(i, plain_set(t, size)) for i, t in rows]
    like = lambda a, b: 100 * len(a & b) >= 80 * len(a | b) if a or b else blank_alike
    links = [(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[:k] if None not in (i, j) and (a and b or blank_alike) and like(a, b)]
    return connected({i for i, _ in rows if i is not None}, links)


def crowd(seed, copies=150, changes=14):
    """One text of 120 words with many edited copies, so that some are only alike through others, and texts that share half of it."""
    r, base = random.Random(seed), [f"w{k}" for k in range(120)]
    rows = [" ".join(base)]
    for k in range(copies):
        copy = list(base)
        for at in r.sample(range(120), r.randrange(1, changes)):
            copy[at] = f"x{r.randrange(6)}"
        rows.append(" ".join(copy if k % 5 else copy[:60] + [f"v{r.randrange(10**6)}" for _ in range(60)]))
    return list(enumerate(rows))[::-1]


def test_crowds_against_force(spark):
    """Buckets with many nodes, by leaders and by blocks."""
    rows = crowd(1) + [(1000 + i, t) for i, t in crowd(2, 60)] + [(5000 + i, "one two three") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = by_force(rows)
    for size in (4, 32):
        got = {r.doc_id: r for r in near_groups(docs, shingle=2, crowd=size, block=16).collect()}
        assert {i: r.component_id for i, r in got.items()} == want
    assert all(got[i].n_shingles == len(plain_set(t, 2)) and got[i].kept == (want[i] == i) for i, t in rows)


def test_blocks_alone(spark):
    """Sets around a centre, by their differences: each node of a small label gets a link to each label that it is linked with, in blocks of any size."""
    r = random.Random(3)
    sets = {i: set(range(100)) - set(r.sample(range(100), r.randrange(22))) | {1000 + r.randrange(40) for _ in range(r.randrange(12))} for i in range(80)} | {99: set(range(100))}
    label = {i: 0 if i < 40 else i // 2 for i in range(80)}
    rows = spark.createDataFrame([(99, i, len(sets[i]), label[i]) for i in range(80)], "centre long, node long, n long, label long")
    stored = spark.createDataFrame([(i, np.array(sorted(s), np.uint64).tobytes()) for i, s in sets.items()], "node long, shingles binary")
    want = {(a, label[b]) for a in range(40, 80) for b in range(80) if label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    for block in (7, 500):
        got = [tuple(x) for x in circulant.in_blocks(rows, stored, 80, block).collect()]
        assert {(a, label[b]) for a, b in got} == want and all(100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for a, b in got)


def edited(seed=3):
    """Copies of texts with a few words changed, cut or added, and texts that share half."""
    r, rows = random.Random(seed), []
    for _ in range(40):
        base = [f"w{r.randrange(5000)}" for _ in range(r.randrange(60, 400))]
        rows += [" ".join(base), " ".join(base[: len(base) // 2] + [f"v{r.randrange(5000)}" for _ in base[len(base) // 2 :]])]
        for n in (1, 1, 2, 3):
            copy = list(base)
            for _ in range(n):
                copy[r.randrange(len(copy))] = "changed"
            rows.append(" ".join(copy))
    return list(enumerate(rows + ["", " ", "one two", "One  two", "one three"]))


def test_pipeline_stage(spark):
    rows = edited()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = by_force(rows, 5, blank_alike=True)
    assert {r.doc_id: r.component_id for r in near_groups(docs, shingle=5, blank_alike=True).collect()} == want and len(set(want.values())) < len(rows) - 80
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == set(want.values())


def test_pipeline_links_by_fingerprints(spark, monkeypatch):
    """Where bands propose nothing, the stage still links the texts whose fingerprints differ in 3 bits or fewer, if their sets are as similar."""
    base = [f"w{k}" for k in range(2000)]
    more = [" ".join(base[:k] + ["changed"] + base[k + 1 :]) for k in range(100, 1000, 100)] + [" ".join([*base, "more"]), "a b c d e f", "f e d c b a"]
    rows = edited() + [(1000 + i, t) for i, t in enumerate([" ".join(base), *more])]
    prints = {i: fingerprint_of(mixed(circulant.shingle_sets([t], 5)[0])) for i, t in rows if t.strip()}
    sets = {i: plain_set(t, 5) for i, t in rows}
    near = [(i, j) for i in prints for j in prints if i < j and ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= 3]
    links = [(i, j) for i, j in near if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = connected(dict(rows), links + [(i, j) for i, t in rows for j, u in rows if i < j and not t.strip() and not u.strip()])
    assert any(sets[i] != sets[j] for i, j in links)
    buckets = circulant.buckets
    monkeypatch.setattr(circulant, "buckets", lambda nodes: buckets(nodes).limit(0))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == set(want.values())


def test_edges(spark):
    """Nulls, empty and short texts, repeats, ids that repeat with other texts, further columns, very long texts; empty tables."""
    long_ = " ".join(f"u{k}" for k in range(200_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "x"), (5, "X"), (6, "x y"), (7, "x y x"), (8, "X  y"), (9, "x x x"), (10, "x x"), (None, "x"), (None, None), (11, long_), (12, long_ + " v"), (12, "x y"), (12, "q r s"), (13, "q r s"), (13, "q r s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS own", "1 AS n", "2 AS node", "3 AS key")
    got = near_groups(docs, shingle=2).collect()
    assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got if r.doc_id} == by_force(rows) and by_force(rows)[13] == 6 == by_force(rows)[11]
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    alike = {r.doc_id: r.component_id for r in near_groups(docs, shingle=2, blank_alike=True).collect() if r.doc_id}
    assert alike == by_force(rows, blank_alike=True) and alike[3] == 1
    assert near_groups(empty(spark), shingle=5).count() == 0 and near_groups(edges(spark), shingle=5).count() == edges(spark).count()


def test_coordinates():
    """Each shift is one-to-one on the ring; coordinates of two sets agree with the similarity of the sets, for small and large ones."""
    slots = np.arange(1 << 16, dtype=np.uint32)
    out, spare = np.empty_like(slots), np.empty_like(slots)
    one, next_ = circulant.shifted(slots, 0, out, spare).copy(), circulant.shifted(slots, 1, out, spare)
    assert len(np.unique(one)) == len(slots) and (one[1:] == next_[:-1]).all()
    r = random.Random(4)
    for n in (3, 12, 100, 40_000):
        words = [[f"w{r.randrange(10**9)}" for _ in range(n + 1)] for _ in range(60 if n < 1000 else 4)]
        sets = circulant.shingle_sets([" ".join(w) for w in words] + [" ".join(w[: -max(1, n // 8)] + ["x"]) for w in words], 2)
        made, half = circulant.signatures(sets), len(words)
        agree, like = (made[:half] == made[half:]).mean(), np.mean([len(np.intersect1d(sets[i], sets[i + half])) / len(np.union1d(sets[i], sets[i + half])) for i in range(half)])
        assert abs(agree - like) < 0.04
