"""Transducers, their composition, and learning: several labels, a bounded sample."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest

from colloquy.llm import toxicity


def test_shares_of_a_capped_sample(spark):
    """A weak match: 48 of 60 toxic and 162 of 540 clean rows have it, so a row that has it is clean more often than not."""
    rows = [(i, "this one is a moron" if (i // 10) % 10 < (8 if i % 10 == 0 else 3) else "all is well here", int(i % 10 == 0)) for i in range(600)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    whole, capped = (toxicity.learn(docs, labels, per_class=n) for n in (6000, 40))
    scores = [m.score(toxicity.Grammar(m.lexicon).patterns("this one is a moron")) for m in (whole, capped)]
    assert max(scores) < 0.5 and scores[1] == pytest.approx(scores[0], abs=0.1)


def random_machine(r, states, symbols):
    return toxicity.Transducer(tuple({x: (r.randrange(states), r.randrange(symbols), r.random()) for x in range(symbols)} for _ in range(states)))


def test_composition_against_enumeration():
    """A composed machine does to every short string what the two do one after the other."""
    r = random.Random(8)
    for _ in range(20):
        a, b = random_machine(r, 4, 3), random_machine(r, 3, 3)
        both = toxicity.compose(a, b)
        for text in itertools.product(range(3), repeat=4):
            mid = a.run(text)
            end = b.run(y for y, _ in mid)
            assert both.run(text) == [(y, pytest.approx(v + w)) for (_, v), (y, w) in zip(mid, end)]


def test_clauses_against_a_plain_reading():
    """Marks of random clauses by distances between words instead of states."""
    r, T = random.Random(3), toxicity
    g = T.Grammar(T.Lexicon({"moron": 5.0}))
    words = ["moron", "kill", "you", "not", "said", "x", "x", "x"]
    for _ in range(500):
        own = [r.choice(words) for _ in range(r.randrange(12))]
        want, seen = [], {"moron": 0, "kill": 0}
        for i, w in enumerate(own):
            if w in seen:
                aimed = any(x == "you" and abs(i - k) <= T.NEAR for k, x in enumerate(own))
                negated = "not" in own[max(0, i - T.REACH) : i]
                reported = "said" in own[:i]
                weight = (T.AGAIN if seen[w] else T.ONCE) * (5.0 if w == "moron" else T.LISTED)
                want.append(((T.INSULT if w == "moron" else T.THREAT, int(aimed), int(negated), int(reported)), weight))
                seen[w] = 1
        assert list(g.clause(own)) == want


def test_speech_after_a_colon_is_reported():
    g = toxicity.Grammar(toxicity.Lexicon({"moron": 5.0}))
    reported = g.patterns("she wrote: you moron")
    assert reported[toxicity.PLACE[toxicity.INSULT, 1, 0, 1]] > 0 and sum(map(bool, reported)) == 1
    assert g.patterns("she wrote it. you moron")[toxicity.PLACE[toxicity.INSULT, 1, 0, 0]] > 0


def test_longest_beginnings():
    assert toxicity.longest({"los": (9, 4.0), "lose": (9, 4.5), "loser": (9, 5.0), "mor": (7, 5.0), "more": (3, 6.0)}) == {"loser": 5.0, "mor": 5.0, "more": 6.0}


def test_several_labels_and_long_texts(spark):
    docs = spark.createDataFrame([(i, ("you gribbet " if i % 3 == 0 else "fine ") * (50_000 if i < 6 else 3), "x") for i in range(60)], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, y) for i in range(60) for y in ((0, 1) if i % 3 == 0 else (0,))] + [(None, 1), (5, None), (7, 3)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    rows = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    assert rows == {i: int(i % 3 == 0) for i in range(60)}
    assert {r.doc_id for r in toxicity.clean(docs, model).collect()} == {i for i in range(60) if i % 3} and toxicity.clean(docs, model).columns == docs.columns


def plain_lexicon(rows):
    """Learned words and word beginnings of (text, toxic) rows, by counting each unit in each row."""
    T = toxicity
    counts = {}
    for text, y in rows:
        words = set(T.WORD.findall(text.lower()))
        for unit in {("w", w) for w in words} | {("s", w[:n]) for w in words for n in range(3, 9) if len(w) >= n}:
            counts.setdefault(unit, [0, 0])[y] += 1
    n = [sum(y == c for _, y in rows) for c in (0, 1)]
    base, chosen = n[1] / sum(n), {}
    for unit, (neg, pos) in counts.items():
        odds = math.log((pos + 0.5) / (n[1] + 1)) - math.log((neg + 0.5) / (n[0] + 1))
        share = pos / (pos + neg)
        nats = (pos + neg) * ((share * math.log(share / base) if share else 0) + ((1 - share) * math.log((1 - share) / (1 - base)) if share < 1 else 0))
        if pos >= max(3, 0.005 * n[1]) and odds >= T.LISTED and nats >= 11:
            chosen[unit] = (pos, odds)
    stems = {u: x for (k, u), x in chosen.items() if k == "s"}
    kept = {s: w for s, (p, w) in stems.items() if not any(len(t) == len(s) + 1 and t.startswith(s) and stems[t][0] == p and w <= stems[t][1] for t in stems)}
    return dict.fromkeys(T.INSULTS, T.LISTED) | {u: w for (k, u), (_, w) in chosen.items() if k == "w"}, kept


def plain_patterns(text, words, stems):
    """Matches of each clause by distances between its words."""
    T, found = toxicity, [0.0] * toxicity.SIZE
    for clause in T.CLAUSE.split((text or "").lower()):
        own, seen = T.WORD.findall(clause), {T.INSULT: 0, T.THREAT: 0}
        for i, w in enumerate(own):
            weight = max([words.get(w, 0.0), *(stems.get(w[:n], 0.0) for n in range(3, 9) if len(w) >= n)])
            for kind, on, value in ((T.INSULT, weight > 0, weight), (T.THREAT, w in T.THREATS, T.LISTED)):
                if on:
                    flags = any(x in T.TARGETS and abs(i - k) <= T.NEAR for k, x in enumerate(own)), any(x in T.NEGATIONS for x in own[max(0, i - T.REACH) : i]), any(x in T.REPORTS for x in own[:i])
                    found[T.PLACE[(kind, *map(int, flags))]] += value * (T.AGAIN if seen[kind] else T.ONCE)
                    seen[kind] = 1
    return [math.log1p(x) for x in found]


def test_scores_of_the_query_against_a_plain_version(spark, small):
    """Every score of op7's query: units counted row by row, matches read plainly, weights that no small change betters."""
    from colloquy.llm import queries

    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{small}/documents.parquet").collect()}
    labels = [(x.doc_id, x.toxic) for x in spark.read.parquet(f"{small}/labels.parquet").collect() if zlib.crc32(str(x.doc_id).encode()) % 5]
    rows = [(docs[i], y) for i, y in labels if i in docs]
    words, stems = plain_lexicon([(t or "", y) for t, y in rows])
    x, y = np.array([plain_patterns(t, words, stems) for t, _ in rows]), np.array([float(y) for _, y in rows])
    weights, bias = toxicity.fit_weights(x, y)

    def loss(w):
        z = x @ w[:-1] + w[-1]
        return np.logaddexp(0, np.where(y == 1, -z, z)).sum() + ((w - np.append(toxicity.PRIOR, toxicity.BIAS)) ** 2).sum() / 2

    best = np.append(weights, bias)
    assert all(loss(np.where(np.arange(len(best)) == i, np.maximum(best + d, 0) if i < len(weights) else best + d, best)) >= loss(best) - 1e-9 for i in range(len(best)) for d in (0.01, -0.01))
    got = {r.doc_id: r.score for r in queries.op7_toxicity(spark, small).collect()}
    want = {i: 1 / (1 + math.exp(-(np.array(plain_patterns(t, words, stems)) @ weights + bias))) for i, t in docs.items()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want) and len({round(s, 3) for s in want.values()}) > 3
