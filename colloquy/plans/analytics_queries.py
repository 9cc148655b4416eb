"""Queries of the analytics, agreement, sampling and set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.operators import agreement as G
from colloquy.operators import analytics as A
from colloquy.operators import sampling as K
from colloquy.operators import sets as L
from colloquy.plans.registry import query
from colloquy.plans.scoring_queries import near, r6
from colloquy.plans.views import duck


def rounded(df, *keep: str):
    """The kept columns as they are, the others rounded."""
    return df.select(*keep, *(near(F.col(c), c) for c in df.columns if c not in keep))


def rd(expr: str, name: str) -> str:
    return f"round({expr} + 1e-9, 6) AS {name}"


STATS = ", ".join(rd(f"{f}(overall)", n) for f, n in (("avg", "mean"), ("min", "min"), ("max", "max"), ("median", "median"))) + ", count(overall) AS n"


@query("j1_stat_block", duck("runs") + f"SELECT model, {STATS} FROM runs GROUP BY model")
def j1(v):
    return rounded(A.stat_block(v.runs, "overall", "model"), "model", "n")


@query("j2_summary_sections", duck("runs") + " UNION ALL ".join(
    f"SELECT '{s}' AS section, {k} AS key, {rd('avg(overall)', 'mean')}, count(overall) AS n FROM runs" + (f" GROUP BY {g}" if g else "")
    for s, k, g in (("overall", "NULL", ""), ("model", "model", "model"), ("difficulty", "difficulty", "difficulty"), ("scenario", "scenario", "scenario"), ("has_guard", "CAST(has_guard AS VARCHAR)", "has_guard"))))
def j2(v):
    return rounded(A.summary_sections(v.runs), "section", "key", "n")


@query("j2_score_histogram", duck("runs") + """SELECT CASE WHEN overall < 0.2 THEN 0 WHEN overall < 0.4 THEN 1 WHEN overall < 0.6 THEN 2 WHEN overall < 0.8 THEN 3 ELSE 4 END AS bin, count(*) AS n FROM runs GROUP BY 1""")
def j2_histogram(v):
    return A.score_histogram(v.runs)


@query("j2_guard_delta", duck("runs") + f"SELECT {rd('avg(overall) FILTER (WHERE has_guard)', '\"on\"')}, {rd('avg(overall) FILTER (WHERE NOT has_guard)', 'off')}, {rd('avg(overall) FILTER (WHERE has_guard) - avg(overall) FILTER (WHERE NOT has_guard)', 'delta')} FROM runs")
def j2_guard(v):
    return rounded(A.guard_delta(v.runs))


MISSED = "CASE WHEN overall < 0.3 THEN 'skipped' WHEN overall < 0.5 THEN 'missed' ELSE 'completed' END"


@query("j2_step_compliance", duck("runs") + f"SELECT {rd('avg(step)', 'mean')}, {rd('min(step)', 'min')}, {rd('max(step)', 'max')}, {rd('median(step)', 'median')}, count(step) AS n FROM runs")
def j2_steps(v):
    return rounded(A.compliance_section(v.runs, _steps(v))[0], "n")


@query("j2_skipped_steps", duck("runs") + "SELECT model AS step_id, count(*) AS n FROM runs WHERE overall < 0.5 GROUP BY 1 ORDER BY n DESC, step_id LIMIT 3")
def j2_skipped(v):
    return A.compliance_section(v.runs, _steps(v), 3)[1]


def _steps(v):
    """Every run stands for one step of its trace, named like its model."""
    return v.runs.select(F.col("model").alias("step_id"), F.expr(MISSED).alias("status"))


MODES = "list_filter([CASE WHEN step < 0.4 THEN 'step_skipping' END, CASE WHEN hard < 0.3 THEN 'tool_avoidance' END, CASE WHEN branch < 0.5 THEN 'branch_error' END], lambda x: x IS NOT NULL)"


def _diagnoses(v):
    modes = F.array_compact(F.expr("array(if(step < 0.4, 'step_skipping', null), if(hard < 0.3, 'tool_avoidance', null), if(branch < 0.5, 'branch_error', null))"))
    return v.runs.select("trace_id", modes.alias("modes"), F.expr("case when hard < 0.2 then 'high' when hard < 0.6 then 'medium' end").alias("severity"))


@query("j2_failure_modes", duck("runs") + f"SELECT mode, count(*) AS n FROM (SELECT unnest({MODES}) AS mode FROM runs) GROUP BY mode ORDER BY n DESC, mode LIMIT 10")
def j2_failures(v):
    return A.failure_section(_diagnoses(v))[0]


@query("j2_severities", duck("runs", "s AS (SELECT CASE WHEN hard < 0.2 THEN 'high' WHEN hard < 0.6 THEN 'medium' END AS severity FROM runs)") + "SELECT severity, count(*) AS n FROM s WHERE severity IS NOT NULL GROUP BY 1")
def j2_severities(v):
    return A.failure_section(_diagnoses(v))[1]


@query("j2_safety", duck("checks", "t AS (SELECT trace_id, count(*) FILTER (WHERE severity = 'critical' AND NOT passed) AS v, count(*) FILTER (WHERE status = 'F') AS b FROM checks GROUP BY 1)")
       + "SELECT CAST(sum(v) AS BIGINT) AS violations, count(*) FILTER (WHERE v > 0) AS traces, CAST(sum(b) AS BIGINT) AS blocks FROM t")
def j2_safety(v):
    runs = v.checks.groupBy("trace_id").agg(F.count_if((F.col("severity") == "critical") & ~F.col("passed")).alias("violations"), F.count_if(F.col("status") == "F").alias("blocks"))
    return A.safety_section(runs)


@query("j3_recommendations", duck("runs") + """SELECT scenario, concat_ws(',', CASE WHEN avg(overall) < 0.55 THEN 'raise_overall' END, CASE WHEN avg(step) < 0.505 THEN 'follow_steps' END, CASE WHEN avg(branch) < 0.505 THEN 'check_branches' END) AS advice FROM runs GROUP BY scenario""")
def j3(v):
    return A.recommendations(v.runs)


@query("j4_model_matrix", duck("runs") + "SELECT concat(CASE WHEN has_guard THEN 'H+' ELSE '' END, model) AS label, " + ", ".join(rd(f"avg(overall) FILTER (WHERE scenario = '{s}')", s) for s in "FOP") + " FROM runs GROUP BY 1")
def j4(v):
    return rounded(A.model_matrix(v.runs, ["F", "O", "P"]), "label")


@query("j5_overview", duck("checks") + f"SELECT {rd('avg(CASE WHEN check_type = ' + chr(39) + 'rule' + chr(39) + ' THEN 1.0 ELSE 0.0 END)', 'rule_share')}, {rd('avg(score)', 'mean')}, {rd('avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END)', 'passed')} FROM checks")
def j5(v):
    return rounded(A.overview(v.checks))


@query("j5_top_failures", duck("runs") + f"SELECT mode, count(*) AS n FROM (SELECT unnest({MODES}) AS mode FROM runs) GROUP BY mode ORDER BY n DESC, mode LIMIT 5")
def j5_failures(v):
    return A.failure_section(_diagnoses(v), 5)[0]


@query("j5_estimated_cost", duck("runs", "c AS (SELECT o_custkey AS trace_id, count(*) AS calls, sum(o_totalprice) / 1e6 AS cost FROM orders GROUP BY 1)") + f"""SELECT {rd("sum(coalesce(c.cost, (cust % 30) * 800 / 1000.0 * CASE model WHEN '1-URGENT' THEN 0.015 WHEN '2-HIGH' THEN 0.002 ELSE 0.01 END))", 'cost')},
    count(c.cost) AS counted, count(*) AS runs FROM runs r LEFT JOIN c ON c.trace_id = r.trace_id""")
def j5_cost(v):
    """Runs whose id is also a customer's have counted calls: that customer's orders."""
    counted = v.table("orders").groupBy(F.col("o_custkey").alias("trace_id")).agg(F.count("*").alias("calls"), (F.sum("o_totalprice") / 1e6).alias("cost"))
    prices = v.values("model string, per_1k double", [("1-URGENT", 0.015), ("2-HIGH", 0.002)])
    return rounded(A.estimated_cost(v.runs.withColumn("turns", F.col("cust") % 30), counted, prices), "counted", "runs")


@query("j6_pass_k", duck("runs", "p AS (SELECT scenario, model, avg(CASE WHEN overall >= 0.6 THEN 1.0 ELSE 0.0 END) AS p FROM runs GROUP BY ALL)")
       + f"SELECT scenario, model, CAST(k AS INTEGER) AS k, {rd('pow(p, k)', 'value')} FROM p, range(1, 5) r(k)")
def j6(v):
    return rounded(A.pass_k(v.runs), "scenario", "model", "k")


PARTS = {"hard": 0.30, "step": 0.24, "branch": 0.14, "temporal": 0.12, "path": 0.08}


def _config(out: str | None) -> str:
    left = {k: w for k, w in PARTS.items() if k != out}
    return "avg((" + " + ".join(f"coalesce({k}, 0) * {w}" for k, w in left.items()) + f") * {0.88 / sum(left.values())!r}::DOUBLE)"


@query("j7_ablation", duck("runs", "f AS (SELECT " + _config(None) + " AS o FROM runs)") + " UNION ALL ".join(
    f"SELECT '{'full' if k is None else 'no_' + k}' AS config, {rd(_config(k), 'mean')}, {rd(_config(k) + ' - any_value(o)', 'delta')} FROM runs, f" for k in (None, *PARTS)))
def j7(v):
    return rounded(A.ablation(v.runs), "config")


def _arms(keys: str) -> str:
    """Means of the three arms by these keys, in SQL."""
    mean = {"bare": "avg(overall) FILTER (WHERE NOT has_guard AND cust % 4 > 0)", "guard": "avg(overall) FILTER (WHERE has_guard AND cust % 4 > 0)", "adaptive": "avg(overall) FILTER (WHERE cust % 4 = 0)"}
    return (f"SELECT {keys}, " + ", ".join(rd(e, n) for n, e in mean.items()) + f", {rd(mean['guard'] + ' - ' + mean['bare'], 'delta')}, {rd('(' + mean['guard'] + ' - ' + mean['bare'] + ') / ' + mean['bare'] + ' * 100', 'rescue')}"
            f" FROM runs GROUP BY {keys}")  # fmt: skip


@query("j8_guard_matrix", duck("runs") + _arms("model"))
def j8(v):
    return rounded(A.guard_matrix(v.runs.withColumn("adaptive", F.expr("cust % 4 = 0"))), "model")


@query("j8_scenario_matrix", duck("runs") + _arms("scenario, model"))
def j8_scenarios(v):
    return rounded(A.guard_matrix(v.runs.withColumn("adaptive", F.expr("cust % 4 = 0")), "scenario", "model"), "scenario", "model")


ERRORS = [("opening_wrong", "CASE WHEN cust % 7 = 1 THEN 0.0 ELSE 1.0 END"), ("closing_wrong", "CASE WHEN cust % 5 > 1 THEN 0.0 ELSE 1.0 END"), ("forbidden_word", "cust % 3"), ("step_incomplete", "CASE WHEN step < 0.8 THEN 1.0 ELSE 0.0 END")]


@query("j8_error_rates", duck("runs") + " UNION ALL ".join(f"SELECT '{k}' AS kind, {rd(f'coalesce(avg({e}) FILTER (WHERE NOT has_guard), 0)', 'bare')}, {rd(f'coalesce(avg({e}) FILTER (WHERE has_guard), 0)', 'guard')} FROM runs" for k, e in ERRORS))
def j8_errors(v):
    rows = v.runs.selectExpr("has_guard", "step", "nullif(cust % 7 = 1, false) AS opening_ok", "cust % 5 > 1 AS closing_ok", "nullif(cust % 3, 0) AS violations")
    return rounded(A.guard_error_rates(rows), "kind")


@query("j9_repeat_stats", duck("runs") + f"SELECT scenario, {rd('avg(overall)', 'mean')}, {rd('stddev_samp(overall)', 'stdev')}, {rd('min(overall)', 'min')}, {rd('max(overall)', 'max')}, count(overall) AS n FROM runs GROUP BY ROLLUP (scenario)")
def j9(v):
    return rounded(A.repeat_stats(v.runs), "scenario", "n")


LAST = """l AS (SELECT model, scenario, difficulty, max_by(overall, struct_pack(s := started_at, t := trace_id)) FILTER (WHERE condition = 'good') AS good,
      max_by(overall, struct_pack(s := started_at, t := trace_id)) FILTER (WHERE condition = 'medium') AS medium, max_by(overall, struct_pack(s := started_at, t := trace_id)) FILTER (WHERE condition = 'flawed') AS flawed
    FROM runs GROUP BY ALL)"""


@query("j10_discrimination", duck("runs", LAST) + "SELECT count(*) AS n, " + ", ".join(rd(f"avg(CASE WHEN {a} >= {b} THEN 1.0 WHEN {a} < {b} THEN 0.0 END)", n) for a, b, n in (("good", "medium", "good_medium"), ("medium", "flawed", "medium_flawed"), ("good", "flawed", "good_flawed"))) + " FROM l")
def j10(v):
    return rounded(A.discrimination(v.runs, "model", "scenario", "difficulty"), "n")


FLAWS = [("f1", "the"), ("f2", "und"), ("f3", "que"), ("f4", "zz")]


@query("j11_flaw_recall", duck("messages", "f AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in FLAWS) + ") t(flaw, pattern))")
       + "SELECT flaw, count(*) AS n, CAST(sum(CASE WHEN regexp_matches(content, pattern) THEN 1 ELSE 0 END) AS BIGINT) AS caught FROM messages JOIN f ON flaw = concat('f', CAST(trace_id % 4 + 1 AS VARCHAR)) GROUP BY flaw")
def j11(v):
    seeded = F.concat(F.lit("f"), (F.col("trace_id") % 4 + 1).cast("string"))
    return A.flaw_recall(v.messages.withColumn("seeded", seeded), v.values("flaw string, pattern string", FLAWS))


def _icc(kind: int) -> str:
    agree = " + k * (msc - mse) / n" if kind == 2 else ""
    return f"""s AS (SELECT sum(t*t/c) AS ss, count(*) AS n FROM (SELECT sum(x) AS t, count(*) AS c FROM d GROUP BY subject)), r AS (SELECT sum(t*t/c) AS rr, count(*) AS k FROM (SELECT sum(x) AS t, count(*) AS c FROM d GROUP BY rater)),
    t AS (SELECT sum(x) AS t, sum(x*x) AS tt FROM d), q AS (SELECT n, k, ss - t*t/(n*k) AS a, rr - t*t/(n*k) AS b, tt - t*t/(n*k) AS c FROM s, r, t),
    m AS (SELECT n, k, a/(n-1) AS msr, b/(k-1) AS msc, (c-a-b)/((n-1)*(k-1)) AS mse FROM q)
    SELECT {rd(f'(msr - mse) / (msr + (k-1)*mse{agree})', 'icc')} FROM m"""


BALANCED = """z AS (SELECT scenario, count(*) AS size FROM runs GROUP BY scenario HAVING count(*) >= 3),
    d AS (SELECT scenario AS subject, r AS rater, overall AS x FROM (SELECT scenario, overall, row_number() OVER (PARTITION BY scenario ORDER BY started_at, trace_id) AS r FROM runs JOIN z USING (scenario))
      WHERE r <= (SELECT min(size) FROM z))"""


@query("j12_stability_icc", duck("runs", BALANCED + ", " + _icc(3)))
def j12(v):
    return rounded(A.icc3(A.balanced(v.runs, "scenario")))


@query("j12_variation", duck("runs") + f"SELECT {rd('avg(cv)', 'cv')} FROM (SELECT stddev_samp(overall) / avg(overall) * 100 AS cv FROM runs GROUP BY scenario)")
def j12_cv(v):
    return rounded(A.variation(v.runs, "scenario"))


@query("j13_icc2", duck("pairs", "d AS (SELECT trace_id * 10 + i AS subject, r AS rater, x FROM (SELECT trace_id, min(item_id) AS i0, 0 AS i, unnest([1, 2]) AS r, unnest([sum(system_score), sum(label)]) AS x FROM pairs GROUP BY trace_id)), " + _icc(2)))
def j13(v):
    sums = v.pairs.groupBy("trace_id").agg(F.sum("system_score").cast("double").alias("a"), F.sum("label").cast("double").alias("b"))
    table = sums.select(F.col("trace_id").alias("subject"), F.explode(F.array(*(F.struct(F.lit(i).alias("rater"), F.col(c).alias("x")) for i, c in ((1, "a"), (2, "b"))))).alias("r")).select("subject", "r.*")
    return rounded(A.icc2(table))


RANKS = """ranked AS (SELECT rank() OVER (ORDER BY system_score) + (count(*) OVER (PARTITION BY system_score) - 1) / 2.0 AS r1, rank() OVER (ORDER BY label) + (count(*) OVER (PARTITION BY label) - 1) / 2.0 AS r2 FROM pairs)"""


@query("j14_human_agreement", duck("pairs", RANKS) + f"SELECT count(*) AS n, {rd('corr(r1, r2)', 'spearman')} FROM ranked")
def j14(v):
    return rounded(G.human_agreement(v.pairs), "n")


@query("j15_spearman_d2", duck("pairs", RANKS) + f"SELECT {rd('1 - 6 * sum((r1 - r2) * (r1 - r2)) / (count(*)::DOUBLE * (count(*)::DOUBLE * count(*) - 1))', 'rho')} FROM ranked")
def j15(v):
    return rounded(G.spearman_d2(v.pairs))


@query("j16_anti_cheat", duck("runs", LAST) + f"SELECT model, scenario, difficulty, {rd('medium', 'medium')}, {rd('flawed', 'flawed')} FROM l WHERE flawed > medium")
def j16(v):
    return rounded(A.anti_cheat(v.runs, "model", "scenario", "difficulty"), "model", "scenario", "difficulty")


@query("j17_field_shares", duck("runs") + f"SELECT {rd('count(soft) * 1.0 / count(*)', 'soft')}, {rd('count(branch) * 1.0 / count(*)', 'branch')} FROM runs")
def j17(v):
    return rounded(A.field_shares(v.runs, ["soft", "branch"]))


@query("j18_cohen_kappa", f"""WITH g AS (SELECT avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END) AS po, avg(quality) AS p, avg(toxic) AS q FROM labels)
    SELECT {rd('CASE WHEN p*q + (1-p)*(1-q) = 1 THEN 1.0 ELSE (po - (p*q + (1-p)*(1-q))) / (1 - (p*q + (1-p)*(1-q))) END', 'kappa')} FROM g""")
def j18(v):
    return rounded(G.cohen_kappa(v.table("labels"), "quality", "toxic"))


@query("j18_weighted_kappa", duck("pairs", """o AS (SELECT avg(abs(system_score - label)) AS o, count(*) AS n FROM pairs), x AS (SELECT system_score AS x, count(*) AS cx FROM pairs GROUP BY 1), y AS (SELECT label AS y, count(*) AS cy FROM pairs GROUP BY 1),
    e AS (SELECT sum(abs(x - y) * cx * cy) AS e FROM x, y)""") + f"SELECT {rd('1 - o / (e / (n::DOUBLE * n))', 'kappa')} FROM o, e")
def j18_weighted(v):
    return rounded(G.weighted_kappa(v.pairs))


@query("j19_agreement_report", duck("pairs") + f"""SELECT item_id, count(*) AS n, {rd('avg(CASE WHEN system_score = label THEN 1.0 ELSE 0.0 END)', 'exact')}, {rd('avg(CASE WHEN abs(system_score - label) <= 1 THEN 1.0 ELSE 0.0 END)', 'within_one')},
    {rd('avg(system_score - label)', 'mean_diff')}, {rd('avg(abs(system_score - label))', 'mae')}, {rd('corr(system_score, label)', 'pearson')} FROM pairs GROUP BY GROUPING SETS ((item_id), ())""")
def j19(v):
    return rounded(G.agreement_report(v.pairs), "item_id", "n")


@query("j20_binary_prf", duck("pairs", """g AS (SELECT count(*) FILTER (WHERE system_score >= 3 AND label >= 3) AS tp, count(*) FILTER (WHERE system_score >= 3 AND label < 3) AS fp,
    count(*) FILTER (WHERE system_score < 3 AND label >= 3) AS fn, count(*) FILTER (WHERE system_score < 3 AND label < 3) AS tn FROM pairs)""")
       + f"SELECT tp, fp, fn, tn, {rd('tp / (tp + fp)', 'precision')}, {rd('tp / (tp + fn)', 'recall')}, {rd('2 * tp / (2 * tp + fp + fn)', 'f1')} FROM g")
def j20(v):
    return rounded(G.binary_prf(v.pairs, F.col("system_score") >= 3, F.col("label") >= 3), "tp", "fp", "fn", "tn")


GRADE = "CASE WHEN {0} >= 80 THEN 'A' WHEN {0} >= 60 THEN 'B' WHEN {0} >= 40 THEN 'C' ELSE 'D' END"


@query("j21_grade_confusion", duck("runs", f"g AS (SELECT {GRADE.format('overall * 100')} AS grade, {GRADE.format('hard * 100')} AS g2 FROM runs)") + "SELECT grade, " + ", ".join(f"nullif(count(*) FILTER (WHERE g2 = '{x}'), 0) AS {x}" for x in "ABCD") + " FROM g GROUP BY grade")
def j21(v):
    return G.grade_confusion(v.runs, F.col("overall") * 100, F.col("hard") * 100)


def _rows(v):
    return v.pairs.select(F.xxhash64("trace_id", "item_id", "system_score", "label").alias("row_id"), "system_score", "label", F.abs(F.col("system_score") - F.col("label")).alias("d"))


@query("j22_bootstrap_ci")
def j22(v):
    """No SQL: the draws are hashes of Spark's. Tests check the interval against the exact metric."""
    return G.bootstrap_ci(_rows(v), lambda w: F.sum(F.col("d") * w) / F.sum(w), n=50)


@query("j22_bootstrap_spearman")
def j22_spearman(v):
    """No SQL, as above."""
    return G.bootstrap_spearman(_rows(v), "system_score", "label", n=50)


@query("j23_naive_baseline", duck("messages", """g AS (SELECT trace_id, sum(CASE WHEN contains(lower(content), 'thth') THEN 1 ELSE 0 END + CASE WHEN contains(lower(content), 'keit') THEN 1 ELSE 0 END) AS bad,
    sum(CASE WHEN contains(lower(content), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(content), 'und') THEN 1 ELSE 0 END) AS good, count(*) AS n FROM messages WHERE role = 'agent' GROUP BY trace_id),
    s AS (SELECT trace_id, bad, 50 - 15 * bad + 3 * good - CASE WHEN n < 2 THEN 10 WHEN n > 20 THEN 5 ELSE 0 END AS raw FROM g)""")
       + "SELECT trace_id, CAST(greatest(0, least(100, CASE WHEN bad > 0 THEN least(raw, 40) ELSE raw END)) AS INTEGER) AS baseline FROM s")
def j23(v):
    return A.naive_baseline(v.messages, ["thth", "keit"], ["the", "und"])


@query("j24_coverage", duck("runs") + f"SELECT scenario, {rd('0.35 * avg(step) + 0.25 * avg(coalesce(branch, 0)) + 0.20 * least(avg(temporal) * 3, 1.0) + 0.20 * max(CASE WHEN has_guard THEN 1.0 ELSE 0.0 END)', 'coverage')} FROM runs GROUP BY scenario")
def j24(v):
    fault = F.max(F.when(F.col("has_guard"), 1.0).otherwise(0.0))
    return rounded(v.runs.groupBy("scenario").agg(A.coverage(F.avg("step"), F.avg(F.coalesce("branch", F.lit(0.0))), F.avg("temporal") * 3, fault).alias("coverage")), "scenario")


PRICES = [("m0", 0, 3.0, 15.0), ("m1", 1, 2.5, 10.0), ("m1-mini", 2, 0.15, 0.6), ("m2", 3, 0.5, 1.5)]
PRICED = "p AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', {b}, {c}, {d})" for a, b, c, d in PRICES) + """) t(pm, ordinal, usd_in, usd_out)),
    u AS (SELECT DISTINCT model FROM llm_calls), b AS (SELECT model, coalesce(arg_min(usd_in, (CASE WHEN pm = model THEN 0 ELSE 1 END) * 100 + ordinal), 1.0) AS i, coalesce(arg_min(usd_out, (CASE WHEN pm = model THEN 0 ELSE 1 END) * 100 + ordinal), 3.0) AS o
      FROM u LEFT JOIN p ON starts_with(model, pm) GROUP BY model),
    c AS (SELECT l.*, (input_tokens * i + output_tokens * o) / 1e6 AS usd FROM llm_calls l JOIN b USING (model))"""


def _priced(v):
    return A.price_calls(v.llm_calls, v.values("model string, ordinal int, usd_in double, usd_out double", PRICES))


@query("c10_price_calls", duck("llm_calls", PRICED) + f"SELECT model, {rd('sum(usd)', 'usd')}, count(*) AS n FROM c GROUP BY model")
def c10(v):
    return rounded(_priced(v).groupBy("model").agg(F.sum("usd").alias("usd"), F.count("*").alias("n")), "model", "n")


@query("j27_cost_summary", duck("llm_calls", PRICED) + f"SELECT purpose, model, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, {rd('sum(usd)', 'usd')} FROM c GROUP BY GROUPING SETS ((), (purpose), (model))")
def j27(v):
    return rounded(A.cost_summary(_priced(v)), "purpose", "model", "calls", "input_tokens", "output_tokens")


@query("j28_aggregate_raters", duck("pairs") + f"SELECT trace_id, {rd('avg(label)', 'overall')}, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS raters FROM pairs GROUP BY trace_id")
def j28(v):
    return rounded(A.aggregate_raters(v.pairs.select("trace_id", F.col("label").alias("overall"), F.col("item_id").alias("rater"))), "trace_id", "raters")


BUCKET = "(CASE WHEN {0} >= 0.4 THEN 1 ELSE 0 END + CASE WHEN {0} >= 0.6 THEN 1 ELSE 0 END + CASE WHEN {0} >= 0.8 THEN 1 ELSE 0 END)"


@query("j29_score_drift", duck("runs") + f"""SELECT {rd('avg(overall)', 'old')}, {rd('avg(hard)', 'new')}, CAST(sum(CASE WHEN abs(hard - overall) >= 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS changed,
    CAST(sum(CASE WHEN {BUCKET.format('overall')} <> {BUCKET.format('hard')} THEN 1 ELSE 0 END) AS BIGINT) AS moved FROM runs""")
def j29(v):
    return rounded(A.score_drift(v.runs, v.runs.select("trace_id", F.col("hard").alias("overall"))), "changed", "moved")


@query("j30_gold_items", duck("checks runs", "j AS (SELECT trace_id, soft_dimension AS item, avg(score) * 5 AS score, false AS made FROM checks WHERE check_type = 'judge' GROUP BY ALL)")
       + f"SELECT trace_id, item, {rd('score', 'score')}, made FROM (SELECT * FROM j UNION ALL SELECT trace_id, 'hard', hard * 5, true FROM runs WHERE trace_id NOT IN (SELECT trace_id FROM j))")
def j30(v):
    return rounded(A.gold_items(v.checks, v.runs), "trace_id", "item", "made")


@query("j31_mutation_relations", duck("runs", """m AS (SELECT trace_id, overall AS a, CASE cust % 4 WHEN 0 THEN overall WHEN 1 THEN hard WHEN 2 THEN 0.0 ELSE overall * 0.5 END AS b,
    CASE cust % 4 WHEN 0 THEN 'invariant' WHEN 1 THEN 'up' WHEN 2 THEN 'zero' ELSE 'cap' END AS relation FROM runs)""")
       + "SELECT trace_id, relation, CASE relation WHEN 'invariant' THEN abs(a - b) < 1e-9 WHEN 'up' THEN b >= a WHEN 'zero' THEN b = 0 ELSE b <= 0.4 END AS holds FROM m")
def j31(v):
    c = F.col("cust") % 4
    made = v.runs.select("trace_id", F.when(c == 0, "invariant").when(c == 1, "up").when(c == 2, "zero").otherwise("cap").alias("relation"),
                         F.when(c == 0, F.col("overall")).when(c == 1, F.col("hard")).when(c == 2, 0.0).otherwise(F.col("overall") * 0.5).alias("overall"))
    return A.mutation_relations(v.runs, made)


@query("j32_instruction_compliance", duck("checks", "o AS (SELECT trace_id, dimension, status, max(CASE severity WHEN 'critical' THEN 1.0 WHEN 'major' THEN 0.5 ELSE 0.25 END) AS s FROM checks WHERE passed GROUP BY ALL)")
       + f"SELECT trace_id, {rd('greatest(0.0, 100 - 12 * sum(s))', 'score')} FROM o GROUP BY trace_id")
def j32(v):
    sev = F.when(F.col("severity") == "critical", 1.0).when(F.col("severity") == "major", 0.5).otherwise(0.25)
    rows = v.checks.select("trace_id", F.col("dimension").alias("dim"), F.col("status").alias("quote"), sev.alias("severity"), F.col("passed").alias("verified"))
    return rounded(A.instruction_compliance(rows), "trace_id")


@query("c8_pair_labels", duck("pairs") + "SELECT p.trace_id, p.item_id, p.system_score, q.label FROM pairs p JOIN pairs q ON p.trace_id = q.trace_id AND p.item_id = q.item_id WHERE p.system_score <> 2 AND q.label <> 3")
def c8(v):
    keep = lambda c, x: v.pairs.select("trace_id", "item_id", F.when(F.col(c) != x, F.col(c)).alias(c))
    return G.pair_labels(keep("system_score", 2), keep("label", 3))


@query("k1_stratified_sample")
def k1(v):
    """No SQL: draws are Spark's hashes. Tests compare with a plain walk over all runs."""
    return K.stratified_sample(v.runs.withColumn("active", F.expr("cust % 4 = 1")), 30, seed=11)


@query("k2_anchors_by_level", duck("runs", "r AS (SELECT model, trace_id, overall, row_number() OVER (PARTITION BY model ORDER BY overall, trace_id) AS r, count(*) OVER (PARTITION BY model) AS n FROM runs)")
       + "SELECT model, trace_id, round(overall, 6) AS overall, CASE WHEN r = 1 THEN 'low' WHEN r = n THEN 'high' ELSE 'mid' END AS level FROM r WHERE r IN (1, n, n // 2 + 1)")
def k2(v):
    return K.anchors_by_level(v.runs, "model", "overall").select("model", "trace_id", r6("overall"), "level")


@query("k3_anchors_diverse", duck("runs", "r AS (SELECT trace_id, difficulty, overall, row_number() OVER (PARTITION BY difficulty ORDER BY overall DESC, trace_id) AS r FROM runs)")
       + "SELECT trace_id, difficulty, round(overall, 6) AS overall FROM r ORDER BY CASE WHEN r = 1 THEN 0 ELSE 1 END, r.overall DESC, trace_id LIMIT 7")
def k3(v):
    return K.anchors_diverse(v.runs, "difficulty", 7).select("trace_id", "difficulty", r6("overall"))


@query("k4_representatives", duck("runs", """b AS (SELECT *, CASE WHEN overall >= 0.7 THEN 'high' WHEN overall >= 0.4 THEN 'mid' ELSE 'low' END AS band FROM runs),
    s AS (SELECT *, row_number() OVER (PARTITION BY band, scenario, model ORDER BY trace_id) AS seen FROM b), p AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY seen, scenario, model, trace_id) AS place FROM s WHERE seen <= 5)""")
       + "SELECT trace_id, band, CAST(place AS INTEGER) AS place FROM p WHERE place <= 5")
def k4(v):
    return K.representatives(v.runs, 5)


@query("k5_insert_traps")
def k5(v):
    """No SQL: traps are drawn by Spark's hash; tests check their number and values."""
    return K.insert_traps(v.pairs.withColumn("row_id", F.xxhash64("trace_id", "item_id", "system_score", "label")), 8, seed=5)


@query("k6_top_k", duck("checks") + "SELECT check_id, count(*) AS n FROM checks WHERE NOT passed GROUP BY check_id ORDER BY n DESC, check_id LIMIT 5")
def k6(v):
    return A.top_k(v.checks.where("not passed"), "check_id", 5)


@query("k7_blind_ids")
def k7(v):
    """No SQL: the order is Spark's hash; tests check that ids are 1 to n."""
    return K.blind_ids(v.runs, seed=3)


@query("l1_missing_tools", duck("traced policy_must") + "SELECT t.trace_id, m.tool_name FROM (SELECT DISTINCT trace_id, scenario_id FROM traced) t JOIN policy_must m USING (scenario_id) EXCEPT SELECT trace_id, tool_name FROM traced WHERE event_type = 'tool_executed' AND source = 'guard'")
def l1(v):
    """Required tools that the guard didn't have to call."""
    return L.missing_tools(v.traced, v.policy_must, v.traced.where("event_type = 'tool_executed' and source = 'guard'"))


@query("l2_untested_steps", duck("traced policies") + "SELECT step_id FROM policies EXCEPT SELECT p.step_id FROM policies p JOIN traced t ON t.scenario_id = p.scenario_id AND t.tool_name = p.action AND p.step_id <> 'reschedule'")
def l2(v):
    """Steps whose tool some trace of the policy called; rescheduling leaves no entry."""
    seen = v.traced.select("scenario_id", F.col("tool_name").alias("action")).distinct().join(v.policies.where("step_id <> 'reschedule'"), ["scenario_id", "action"]).withColumn("status", F.lit("completed"))
    return L.untested_steps(v.policies, seen)


#: The branches that traces took: by what their ledger entry says at their policy's branching steps.
TAKEN = "taken AS (SELECT DISTINCT t.scenario_id, b.step_id, b.next_step FROM traced t JOIN policy_branches b ON b.scenario_id = t.scenario_id AND b.branch_idx % 2 = t.k % 2 AND (t.tool_name = 'click') = (b.step_id = 'inform'))"


def taken_branches(v):
    met = (F.col("branch_idx") % 2 == F.col("k") % 2) & ((F.col("tool_name") == "click") == (F.col("step_id") == "inform"))
    return v.traced.select("scenario_id", "k", "tool_name").join(v.policy_branches, "scenario_id").where(met).select("scenario_id", "step_id", "next_step")


@query("l3_covered_branches", duck("traced policy_branches", TAKEN) + "SELECT scenario_id, step_id, next_step FROM policy_branches INTERSECT SELECT * FROM taken")
def l3(v):
    return L.covered_branches(v.policy_branches, taken_branches(v))


@query("l4_distinct_violations", duck("ledger") + """SELECT trace_id, tool_name AS behavior_id, k % 10 AS turn, min(CASE WHEN source = 'agent' THEN 'keyword' ELSE 'semantic' END) AS source FROM ledger GROUP BY ALL""")
def l4(v):
    rows = v.ledger.select("trace_id", F.col("tool_name").alias("behavior_id"), (F.col("k") % 10).alias("turn"), F.when(F.col("source") == "agent", "keyword").otherwise("semantic").alias("source"))
    return L.distinct_violations(rows.where("source = 'keyword'"), rows.where("source = 'semantic'"))


GAPS = """u AS (SELECT DISTINCT CASE c_nationkey % 5 WHEN 0 THEN 'step' WHEN 1 THEN 'branch' WHEN 2 THEN 'constraint' WHEN 3 THEN 'persona' ELSE 'fault' END AS dimension, concat(lower(c_mktsegment), '-', CAST(c_custkey % 9 AS VARCHAR)) AS item FROM customer),
    g AS (SELECT dimension, item, CASE WHEN contains(item, 'auto') THEN 'busy' WHEN contains(item, 'mach') THEN 'angry' ELSE 'neutral' END AS persona FROM u WHERE item NOT LIKE '%-3' AND item NOT LIKE '%-4'),
    r AS (SELECT dimension, item, persona, count(*) OVER (PARTITION BY dimension) AS n_dimension, (SELECT least(10, greatest(1, count(*) FILTER (WHERE dimension IN ('branch', 'persona')))) FROM g) AS suggested FROM g)"""


def _gaps(v):
    kinds = F.element_at(F.array(*map(F.lit, ("step", "branch", "constraint", "persona", "fault"))), (F.col("c_nationkey") % 5 + 1).cast("int"))
    all_ = v.table("customer").select(kinds.alias("dimension"), F.concat(F.lower("c_mktsegment"), F.lit("-"), (F.col("c_custkey") % 9).cast("string")).alias("item"))
    return A.coverage_gap_report(all_, all_.where("item like '%-3' or item like '%-4'"), {"auto": "busy", "mach": "angry"})


@query("j25_coverage_gaps", "WITH " + GAPS + " SELECT * FROM r")
def j25(v):
    return _gaps(v)


@query("j26_targeted_variants", "WITH " + GAPS + """ SELECT persona, dimension, item, CASE persona WHEN 'busy' THEN 9 WHEN 'angry' THEN 3 END AS patience FROM r
    ORDER BY CASE dimension WHEN 'step' THEN 1 WHEN 'branch' THEN 2 WHEN 'constraint' THEN 3 WHEN 'persona' THEN 4 ELSE 5 END, item LIMIT 25""")
def j26(v):
    return A.targeted_variants(_gaps(v), v.values("persona string, patience int", [("busy", 9), ("angry", 3)]), 25).select("persona", "dimension", "item", "patience")
