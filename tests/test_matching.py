"""Words of policies in texts: both ways of bringing them together, against `in`."""

import random
import time

import pytest

from colloquy.operators.joins import forbidden_hits
from colloquy.operators.matching import Lists, first_words


def plain(texts, policies):
    out = set()
    for scenario, n, *said in texts:
        for own, name, words in policies:
            if own == scenario and words is not None:
                firsts = [next((w for w in words if t is not None and w is not None and w in t), None) for t in said]
                if any(f is not None for f in firsts):
                    out.add((n, name, *firsts))
    return out


@pytest.mark.parametrize("sent", [1 << 20, 0])
@pytest.mark.parametrize("split", [50_000, 7])
def test_first_words(spark, sent, split):
    r = random.Random(1)
    word = lambda: "".join(r.choices("abç", k=r.randrange(1, 5)))
    policies = [(s, f"l{i}", [word() for _ in range(r.randrange(0, 6))]) for s in range(6) for i in range(r.randrange(0, 4))]
    policies += [(7, "empty word", ["zz", ""]), (7, "null word", [None, "a"]), (8, "none", [None]), (9, "no text", ["a"])]
    texts = [(r.randrange(9), n, word() * 2 + " " + word(), r.choice([None, "", word() + word()])) for n in range(300)] + [(None, 900, "a", "a"), (77, 901, "a", "a")]
    a = spark.createDataFrame(texts, "scenario_id long, n long, x string, y string").repartition(3)
    b = spark.createDataFrame(policies, "scenario_id long, list_id string, words array<string>")
    got = [tuple(row) for row in first_words(a, b, ["x", "y"], ["n"], sent=sent, split=split).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(texts, policies)
    assert first_words(a.limit(0), b, ["x", "y"], ["n"], sent=sent).count() == first_words(a, b.limit(0), ["x", "y"], ["n"], sent=sent).count() == 0


def test_ten_thousand_words():
    """A text is read once: a thousand times as many words don't take ten times as long."""
    r = random.Random(2)
    words = [f"{r.randrange(10**9):x}" for _ in range(10_000)]
    text = " ".join(f"{r.randrange(10**12):x}" for _ in range(20_000)) + words[7000] + words[6000]

    def took(lists):
        best = 9.0
        for _ in range(3):
            began = time.perf_counter()
            lists.found(text)
            best = min(best, time.perf_counter() - began)
        return best

    many, few = Lists((tuple(words),)), Lists((tuple(words[:10]),))
    assert sorted(many.found(text)[0]) == [i for i, w in enumerate(words) if w in text] and took(many) < 10 * took(few) + 0.05


def test_forbidden_hits(spark):
    """Synonyms come right after their word; what only the raw text holds is major; a row per behaviour and turn."""
    words = [f"w{i}x" for i in range(10_000)]
    behaviors = spark.createDataFrame([(1, "a", "minor", ["no", *words]), (1, "b", "critical", ["yes", "sure"]), (2, "a", "minor", ["w1x"])], "scenario_id long, behavior_id string, severity string, keywords array<string>")
    rows = [(1, 1, 1, "agent", "say w9000x w77x", "same"), (1, 1, 2, "agent", "then", "sure yes"), (1, 1, 3, "agent", "never", "no"), (1, 1, 4, "user", "no", "no"), (2, 2, 1, "agent", "no w1x", ""), (1, 1, 1, "agent", "w5x", "")]
    messages = spark.createDataFrame(rows, "trace_id long, scenario_id long, turn long, role string, norm string, norm_raw string")
    got = {tuple(r) for r in forbidden_hits(messages, behaviors, {"no": ["never"]}).collect()}
    assert got == {(1, "a", 1, "minor", "w5x"), (1, "b", 2, "major", "yes"), (1, "a", 3, "minor", "never"), (2, "a", 1, "minor", "w1x")}
