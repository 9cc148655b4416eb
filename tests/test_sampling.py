"""The stratified sample against a plain walk over all runs."""

import random
from collections import Counter

import pytest

from colloquy import plans
from colloquy.operators import sampling
from colloquy.plans.views import Views


def walk(runs, n, per_scenario=3, per_model=6):
    """runs: (trace_id, scenario, model, overall, active, draw)."""
    name = lambda x: next((s for s, low in reversed(sampling.STRATA) if x >= low), None)
    rows = [(r, name(r[3])) for r in runs if r[3] is not None and name(r[3])]
    sizes, share, taken, counts, short = Counter(s for _, s in rows), max(1, n // 4), {}, Counter(), {}

    def take(pool, most):
        got = 0
        for r, s in pool:
            if got < most and r[0] not in taken and counts["s", r[1]] < per_scenario and counts["m", r[2]] < per_model:
                taken[r[0]] = (r, s)
                counts.update([("s", r[1]), ("m", r[2])])
                got += 1
        return got

    for s in sorted(sizes, key=lambda s: (sizes[s], s)):
        short[s] = share - take(sorted((x for x in rows if x[1] == s), key=lambda x: (not x[0][4], x[0][5], x[0][0])), share)
    take(sorted(rows, key=lambda x: (x[0][5], x[0][0])), n - len(taken))
    order = sorted(taken.values(), key=lambda x: (x[0][5], x[0][0]))
    return [(r[0], s, f"B{i:03d}", short[s]) for i, (r, s) in enumerate(order, 1)]


@pytest.mark.parametrize("seed", range(3))
def test_sample_is_the_walk(spark, seed):
    r = random.Random(seed)
    rows = [(i, f"s{min(r.randrange(12), r.randrange(12))}", f"m{r.choice([0, 0, 0, 1, 2, 3, 4])}", r.choice([None, r.random(), r.random() / 3, -1.0]), r.choice([True, False, None])) for i in range(200 + 200 * seed)]
    df = spark.createDataFrame(rows, "trace_id long, scenario string, model string, overall double, active boolean").repartition(5)
    drawn = {x.trace_id: x.d for x in df.select("trace_id", sampling.draw(7, "trace_id").alias("d")).collect()}
    for n in (8, 30):
        got = sorted(map(tuple, sampling.stratified_sample(df, n, 7).collect()), key=lambda x: x[2])
        assert got == walk([(*x, drawn[x[0]]) for x in rows], n)
    assert seed or sampling.stratified_sample(df.limit(0), 8, 7).count() == 0


def test_query_is_the_walk(spark, small):
    runs = Views(spark, small).runs.selectExpr("trace_id", "scenario", "model", "overall", "cust % 4 = 1 AS active").withColumn("d", sampling.draw(11, "trace_id")).collect()
    got = sorted(map(tuple, plans.QUERIES["k1_stratified_sample"](spark, small).collect()), key=lambda x: x[2])
    assert got == walk(list(map(tuple, runs)), 30)
