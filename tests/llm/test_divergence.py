"""Divergences of sources against sums over every word, one at a time."""

import random
import re
from collections import Counter

from test_training_text import edges, empty

from colloquy.llm import divergence
from colloquy.llm.divergence import divergences

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def by_force(rows, min_docs=3, top=200):
    rows = [(x[0] or "", x[1] or "", "".join(c.lower() if c.isascii() else c for c in x[2] or "")) for x in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        docs = Counter(t for g, _, text in rows if g == lang for t in set(TERM.findall(text)))
        kept = sorted(t for t, n in docs.items() if n >= min_docs)
        count = {}
        for g, source, text in rows:
            if g == lang:
                count.setdefault(source, Counter()).update(t for t in TERM.findall(text) if docs[t] >= min_docs)
        chance = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, all_ = {s: chance(c) for s, c in count.items()}, chance(sum(count.values(), Counter()))
        price = lambda x, y: (x - y) ** 2 // y
        for s in count:
            pairs = [(-sum(price(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in count if o != s]
            terms = [(-price(p[s][t], all_[t]), t.encode(), t) for t in kept if count[s][t] and p[s][t] > all_[t]]
            out |= {(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(sorted(pairs))}
            out |= {(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(sorted(terms)[:top])}
    return out


def made(seed, count=120):
    r = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Über", "ÜBER", "naïve", "日本", "🙂a"]
    rows = []
    for _ in range(count):
        some = r.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=r.randrange(1, 60))
        rows.append((r.choice(["en", "de", "fr", None]), f"s{r.choice('aaabcde')}", r.choice([" ", "-", "1", "\n\x00_"]).join(some)))
    return rows + [("en", "only empty", None), ("xx", "a", "once"), ("xx", "b", "twice Twice"), ("xx", None, "")]


def test_small_blocks_against_force(spark, monkeypatch):
    rows = made(1)
    docs = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "'x' AS g", "1 AS n", "'y' AS term").repartition(3)
    want = by_force(rows)
    assert {tuple(r) for r in divergences(docs).collect()} == want
    for name, value in (("BLOCK", 7), ("TILE", 4), ("ENTRIES", 9), ("HELD", 5), ("PIECE", 3)):
        monkeypatch.setattr(divergence, name, value)
    assert sorted(tuple(r) for r in divergences(docs, top=3).collect()) == sorted(by_force(rows, top=3))


def test_edges(spark):
    """Nulls, empty and very long texts, repeats, further columns; empty tables."""
    long_ = "Aa bb " * 300_000
    rows = [(None, None, None), ("en", "a", long_), ("en", "a", long_), ("en", "b", "aa"), ("en", "b", "aa"), ("en", "c", "")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert {tuple(r) for r in divergences(docs).collect()} == by_force(rows)
    assert divergences(docs.limit(0)).count() == 0 == divergences(empty(spark).selectExpr("*", "'x' AS lang", "'y' AS source")).count()
    assert divergences(edges(spark).selectExpr("*", "'x' AS lang", "cast(doc_id as string) AS source")).where("part = 'pair' and value <> 0").count() == 0


def test_letters():
    assert list(divergence.words_of("Éa_bÉ Ab1c\x7f\xa0d".encode())) == [["Éa".encode(), "bÉ".encode(), b"ab", b"c", "\xa0d".encode()]]
