"""Pruned searches of aliases and quotes against versions that try every window."""

import difflib
import random
from collections import Counter

from colloquy import plans
from colloquy.functions import fuzzy


def every_window(alias, text, least=0.80):
    if len(alias) < 3 or not text:
        return 0.0
    if alias in text:
        return 1.0
    grams = lambda t: {t[i : i + n] for n in (2, 3) for i in range(len(t) - n + 1)}
    best = 0.0
    for size in range(max(1, len(alias) - 3), len(alias) + 4):
        for at in range(max(1, len(text) - size + 1)):
            w = text[at : at + size]
            f1 = 2 * sum((Counter(alias) & Counter(w)).values()) / (len(alias) + len(w))
            a, b = grams(alias), grams(w)
            best = max(best, 0.5 * f1 + 0.3 * (2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0) + 0.2 * difflib.SequenceMatcher(None, alias, w).ratio())
    return best if best >= least else 0.0


def every_offset(quote, source, least=0.82):
    q, s = ("".join((x or "").lower().split()) for x in (quote, source))
    if not q or not s:
        return False
    return q in s or any(sum(a == b for a, b in zip(q, s[i : i + len(q)])) >= least * len(q) for i in range(max(1, len(s) - len(q) + 1)))


def test_aliases():
    r, hits = random.Random(1), 0
    for k in range(3000):
        letters = r.choice(["ab", "abcdef", "abcdefghijklmnop", "äöü🙂ab"])
        alias = "".join(r.choices(letters, k=r.randrange(1, 14)))
        text = "".join(r.choices(letters + " ", k=r.randrange(40)))
        if k % 2:
            near = list(alias)
            for _ in range(r.randrange(3)):
                near[r.randrange(len(near))] = r.choice(letters)
            text += "".join(near)[r.randrange(2) :] + text[:5]
        got = fuzzy.alias_score(alias, text)
        assert got == every_window(alias, text), (alias, text)
        hits += 0 < got < 1
    assert hits > 200


def test_few_windows_are_scored(monkeypatch):
    r, scored = random.Random(2), []
    own = fuzzy.Alias.score_of
    monkeypatch.setattr(fuzzy.Alias, "score_of", lambda self, w: scored.append(w) or own(self, w))
    text = " ".join("".join(r.choices("etaoinshrdlu", k=r.randrange(2, 9))) for _ in range(4000))
    assert fuzzy.alias_score("reschedule delivery", text + " rescheduled deliver " + text) > 0.8 and len(scored) < 10


def test_quotes():
    r, hits = random.Random(3), 0
    for k in range(4000):
        letters = r.choice(["ab", "abcdefghij", "aÄßß🙂 "])
        source = "".join(r.choices(letters, k=r.randrange(60)))
        at = r.randrange(len(source) + 1)
        quote = list(source[at : at + r.randrange(1, 30)] if k % 3 else r.choices(letters, k=r.randrange(1, 9)))
        for _ in range(r.randrange(6)):
            if quote:
                quote[r.randrange(len(quote))] = r.choice(letters)
        found = every_offset("".join(quote), source)
        assert fuzzy.quote_found("".join(quote), source) == found, ("".join(quote), source)
        hits += found
    assert 500 < hits < 3500
    long_ = "".join(r.choices("abcdefgh", k=300_000))
    passage = "".join(c if i % 7 else "X" for i, c in enumerate(long_[200_000:202_000]))
    assert fuzzy.quote_found(passage, long_) and not fuzzy.quote_found(passage.replace("a", "Y"), long_)


def test_queries_try_every_window(spark, small):
    texts = {(r.trace_id, r.turn): r.content for r in spark.read.parquet(f"{small}/conversations.parquet").selectExpr("conv_id AS trace_id", "turn", "text AS content").collect()}
    got = {(r.trace_id, r.turn): r.score for r in plans.QUERIES["d5_alias_match"](spark, small).collect()}
    assert got == {k: every_window("thention", t) for k, t in texts.items()} and len(set(got.values())) > 2
    found = {(r.trace_id, r.turn): r.found for r in plans.QUERIES["d11_fuzzy_quote"](spark, small).collect()}
    follow = {k: texts[n] for k, n in zip(sorted(texts), sorted(texts)[1:]) if k[0] == n[0]}
    assert found == {k: every_offset(follow.get(k), t) for k, t in texts.items()}
