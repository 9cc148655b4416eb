"""Orders by ranges, and repairs by rounds, against plain versions."""

import random

import pytest

from colloquy.operators import diagnosis, mutations, ranges, sampling


def test_ranges_follow_skewed_values(spark):
    """On log-normal values the longest range has at most twice the mean."""
    r = random.Random(1)
    df = spark.createDataFrame([(r.lognormvariate(0, 3),) for _ in range(20_000)], "v double")
    sizes = [x["count"] for x in ranges.in_ranges(df, "v", ranges=16).groupBy("_part").count().collect()]
    assert len(sizes) == 16 and max(sizes) <= 2 * sum(sizes) / 16


def test_numbers(spark):
    r = random.Random(2)
    rows = [(r.choice(["x", None, "y", f"z{r.randrange(500)}"]), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "a string, b long").repartition(7)
    got = {x.b: x.n for x in ranges.numbered(df, "n", "a", "b").collect()}
    assert got == {b: i for i, (_, b) in enumerate(sorted(rows, key=lambda x: (x[0] is not None, x[0] or "", x[1])), 1)}
    assert ranges.numbered(df.limit(0), "n", "a").count() == 0
    traces = df.selectExpr("b AS trace_id")
    one, two = ({x.trace_id: x.blind_id for x in sampling.blind_ids(t, 5).collect()} for t in (traces, traces.repartition(3)))
    assert one == two and sorted(one.values()) == list(range(1, 2001)) and one != {x.trace_id: x.blind_id for x in sampling.blind_ids(traces, 6).collect()}


@pytest.mark.parametrize("n", [1, 2, 700])
def test_rings(spark, n):
    """Following a ring passes each value once; swapped tables have the same values, and nulls stay."""
    df = spark.createDataFrame([(i, f"n{i % n}" if i % 5 else None) for i in range(1000)], "id long, name string").repartition(5)
    values = df.where("name is not null").select("name").distinct()
    after = {x["name"]: x["next"] for x in ranges.ring(values, "name", "next", "name").collect()}
    at, seen = next(iter(after)), []
    while at not in seen:
        seen.append(at)
        at = after[at]
    assert sorted(seen) == sorted(after) and at == seen[0]
    swapped = {x.id: x.name for x in mutations.entity_swap(df, ["name"]).collect()}
    assert all((swapped[x.id] is None) == (x.name is None) and (x.name is None or n == 1 or swapped[x.id] != x.name) for x in df.collect())


def repaired(weights, causes):
    """Walk from each atom until nothing grows."""
    total = max(sum(weights.values()), 1.0)
    out = {}
    for root in weights:
        good, grown = {root}, True
        while grown:
            more = {a for a in weights if a not in good and (own := {s for s, d in causes if d == a and s in weights}) and own <= good}
            good, grown = good | more, bool(more)
        out[root] = (len(good), sum(weights[a] for a in good) / total * 0.25)
    return out


def test_repairs_of_random_graphs(spark):
    r, verdicts, causes, want, roots = random.Random(4), [], [], {}, set()
    for policy in range(4):
        n = r.randrange(4, 9)
        own = {(f"a{r.randrange(n)}", f"a{r.randrange(n)}") for _ in range(r.randrange(2 * n))} if policy else {(f"a{i}", f"a{i + 1}") for i in range(n - 1)}
        causes += [(policy, s, d) for s, d in own]
        for trace in range(policy * 10, policy * 10 + 5):
            rows = [(policy, trace, f"a{i}", "unsatisfied" if trace % 10 == 0 else r.choice(["unsatisfied", "unsatisfied", "satisfied"]), -r.choice([0.25, 0.5, 2.0])) for i in range(n)]
            verdicts += rows + rows[:1]
            bad = {x[2]: -x[4] for x in rows if x[3] == "unsatisfied"}
            want |= {(trace, a): x for a, x in repaired(bad, own).items()}
            roots |= {(trace, a) for a in bad if not any(d == a and s in bad for s, d in own)}
    df = spark.createDataFrame(verdicts, "scenario_id long, trace_id long, atom string, verdict string, delta double")
    given = spark.createDataFrame(causes, "scenario_id long, src string, dst string")
    got = {(x.trace_id, x.atom): (x.recovers, pytest.approx(x.gain)) for x in diagnosis.counterfactual_repair(df, given).collect()}
    assert got == want and max(x[0] for x in want.values()) > 3
    assert {tuple(x) for x in diagnosis.causal_roots(df, given).collect()} == roots
    assert diagnosis.counterfactual_repair(df.limit(0), given).count() == 0
