"""What grows with the tables isn't sent through the driver."""

import os

import pytest
from pyspark.sql import functions as F

from colloquy import plans

JOINED = ["b9_lint_policies", "e7_topological_order", "f3_observed_steps", "f9_branch_score", "f12_illegal_transitions"]


@pytest.fixture(scope="module")
def many_policies(spark, small, tmp_path_factory):
    """Tables with 30,000 customers, and so as many policies, whose file is small."""
    folder = tmp_path_factory.mktemp("many")
    for name in os.listdir(small):
        if name != "customer.parquet":
            os.symlink(f"{small}/{name}", folder / name)
    rows = spark.range(1, 30_001).select(F.col("id").alias("c_custkey"), F.concat(F.lit("c"), "id").alias("c_name"), (F.col("id") % 25).cast("int").alias("c_nationkey"), (F.col("id") % 1000).cast("double").alias("c_acctbal"), F.lit("x").alias("c_mktsegment"))
    rows.write.parquet(f"{folder}/customer.parquet")
    return str(folder)


@pytest.mark.parametrize("name", JOINED)
def test_policies_are_not_broadcast(name, spark, many_policies):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "400k")
    try:
        df = plans.QUERIES[name](spark, many_policies)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    joins = [line for line in plan.split("\n") if "BroadcastHashJoin [" in line and "BuildRight" in line]
    assert not [j for j in joins if "scenario_id" in j or "custkey" in j], joins


def test_slots_are_counted_not_paired(spark):
    """Against plain loops, with nulls, negative numbers and repeats; no join makes a row per need and slot."""
    from colloquy.operators import filters

    needs = [(i, i % 2, 0, [-5.0, 3.5, 20.0, None][i % 4], [-9, 0, 2, 7, 100, None][i % 6]) for i in range(600)] + [(1, 1, 0, 9.0, 1)]
    places = [(p, float(p % 13 - 4)) for p in range(300)] + [(300, None)]
    slots = [(p, p % 2, d, [-3, 0, 1, 2, 5, 8, None][(p + d) % 7]) for p in range(303) for d in (0, 1)]
    price, want = dict(places), {}
    for i, kind, day, budget, heads in needs:
        fit = [p for p, k, d, seats in slots if (k, d) == (kind, day) and None not in (seats, heads, budget, price.get(p)) and seats >= heads and price[p] <= budget]
        want[i] = want.get(i, 0) + len(fit)
    df = filters.feasible_slots(
        spark.createDataFrame(needs, "scenario_id long, kind int, day int, budget double, heads int"),
        spark.createDataFrame(places, "place_id long, price double"), spark.createDataFrame(slots, "place_id long, kind int, day int, seats int"))
    assert {r.scenario_id: r.n_slots for r in df.collect()} == want and max(want.values()) > 50
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Join Inner" in line and "kind" in line]


def test_draws_are_plain_comparisons(spark):
    """The same draws as a count of the steps passed, without a function that walks an array for each row and replicate."""
    from colloquy.operators import agreement as G

    u = F.xxhash64("id", F.lit(3), F.lit(7)).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    rows = spark.range(20_000).select(G.poisson_weight("id", 3, 7).alias("w"), u.alias("u"))
    got = rows.collect()
    assert all(r.w == sum(r.u >= s for s in G.POISSON) for r in got) and max(r.w for r in got) >= 5
    assert "lambda" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_repairs_are_not_broadcast(spark):
    """Rounds over what was written, whose files are far smaller than its rows, join by sorting; results as by hand."""
    from colloquy.operators import diagnosis as I

    verdicts = spark.range(1, 301).selectExpr("1L AS scenario_id", "id AS trace_id", "explode(array('a', 'b', 'c')) AS atom", "'unsatisfied' AS verdict", "-1.0D AS delta")
    causes = spark.createDataFrame([(1, "a", "b"), (1, "b", "c")], "scenario_id long, src string, dst string")
    df = I.counterfactual_repair(verdicts, causes)
    rows = df.collect()
    assert {(r.atom, r.recovers) for r in rows} == {("a", 3), ("b", 2), ("c", 1)} and len(rows) == 900
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_runs_are_numbered_in_ranges(spark):
    """One large group is numbered by several tasks; the same rows as a plain walk, groups of too few runs and nulls left out."""
    from colloquy.operators import analytics as A

    rows = [("a", 7 * i % 500 // 2, i, float(i)) for i in range(500)] + [("b", None if i == 3 else -i, i, i / 2) for i in range(40)] + [("c", 1, 1, 1.0), (None, 1, 1, 1.0), (None, 2, 2, 1.0), (None, 3, 3, 1.0)] + [(None, 9, i, 1.0) for i in range(40)]
    df = A.balanced(spark.createDataFrame(rows, "model string, started_at long, trace_id long, overall double").repartition(3), "model")
    want = {(g, n, x) for g in "ab" for n, (_, _, _, x) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2])), 1) if n <= 40}
    got = df.collect()
    assert {(r.subject, r.rater, r.x) for r in got} == want and len(got) == 80
    windows = [line for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [row_number" in line]
    assert windows and all("_part" in line for line in windows)


def test_rubrics_keep_no_row_per_atom(spark):
    """Against plain loops, with unknown, repeated and null atoms; judgements are hashed, not sorted, and traces meet a row per rubric."""
    from colloquy.operators import scoring as S

    rows = [(i % 7, ["d0", "d1", "d9", None][i * i % 4], f"a{i % 5}", ["yes", "partial", "no", "na", None][i * 3 % 11 % 5], [True, False, None][i % 3], None if i % 17 == 0 else i * 37 % 101) for i in range(120)]
    expected = [(d, f"a{i}") for d in ("d0", "d1") for i in range(4)]
    want = {}
    for t in range(7):
        for d in ("d0", "d1"):
            points = []
            for a in range(4):
                own = [r for r in rows if r[:3] == (t, d, f"a{a}") and r[5] is not None]
                _, _, _, s, e, _ = min(own, key=lambda r: r[5]) if own else (None,) * 6
                points.append({"yes": 1.0 if e else 0.5, "partial": 0.5 if e else 0.0, "no": 0.0}.get(s))
            n, p = sum(x is not None for x in points), sum(x or 0.0 for x in points)
            raw = min(5, int(p / (n + 0.5 * (4 - n)) * 5 + 0.5))
            want[t, d] = (p, min(raw, 2) if n < 3 else raw, n < 3)
    df = S.rubric_atoms(spark.createDataFrame(rows, "trace_id long, dim_id string, atom_id string, status string, evidence_found boolean, pos long"), spark.createDataFrame(expected, "dim_id string, atom_id string"))
    assert {(r.trace_id, r.dim_id): (r.points, r.score, r.undertested) for r in df.collect()} == want and len({x[1] for x in want.values()}) > 2
    assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()
