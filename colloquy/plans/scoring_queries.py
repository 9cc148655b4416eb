"""Queries of the scoring operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.operators import scoring as S
from colloquy.plans.registry import query
from colloquy.plans.views import duck

HARD_W = "CASE dimension " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.HARD_WEIGHTS.items()) + " ELSE 0.05 END"
SOFT_W = "CASE soft_dimension " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.SOFT_WEIGHTS.items()) + " END"
PENALTY = "CASE severity WHEN 'critical' THEN 0.05 WHEN 'major' THEN 0.03 WHEN 'medium' THEN 0.02 ELSE 0.01 END"
OBJECTIVE = """CASE WHEN branch IS NULL THEN (0.30*hard + 0.24*step + 0.12*temporal + 0.08*path) * (0.88/0.74)
    ELSE 0.30*hard + 0.24*step + 0.14*branch + 0.12*temporal + 0.08*path END"""
BONUS = "coalesce(0.12 * soft * least(1.0, objective / 0.70), 0)"
COMPONENTS = "c AS (SELECT trace_id, overall, soft, hard, step, branch, temporal, path, cust, " + OBJECTIVE + " AS objective FROM runs)"
CAP = """least(1.0, CASE WHEN cust % 50 = 0 THEN 0.0 ELSE 1.0 END, CASE WHEN cust % 11 = 0 THEN 0.40 ELSE 1.0 END, CASE WHEN cust % 13 = 0 THEN 0.60 ELSE 1.0 END,
    CASE WHEN cust % 7 = 0 THEN 0.60 ELSE 1.0 END, CASE WHEN cust % 5 = 0 THEN 0.70 ELSE 1.0 END, CASE WHEN cust % 17 = 0 THEN 0.70 ELSE 1.0 END,
    CASE WHEN hard < 0.5 THEN hard + 0.15 ELSE 1.0 END)"""
LABEL = """CASE WHEN cust % 50 = 0 THEN 'zero' WHEN cust % 11 = 0 THEN 'cap_040' WHEN cust % 13 = 0 OR cust % 7 = 0 THEN 'cap_060'
    WHEN cust % 5 = 0 OR cust % 17 = 0 OR hard < 0.5 THEN 'cap_070' ELSE 'none' END"""


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)


def near(column, name: str):
    """Rounded with a shift, so that exact halves don't fall either way by the engine's rounding."""
    return F.round(column + 1e-9, 6).alias(name)


def _flags():
    at = lambda n: F.col("cust") % n == 0
    return at(50), at(11), at(13), at(7), at(5), at(17)


def _scored(v):
    objective = S.objective_score(*(F.col(c) for c in ("hard", "step", "branch", "temporal", "path")))
    runs = v.runs.withColumn("objective", objective)
    runs = runs.withColumn("evidence", S.evidence_score(F.col("objective"), F.col("soft"), F.lit(0.0)))
    return runs.withColumn("veto", S.veto_cap(*_flags(), F.col("hard"))).withColumn("final", S.overall_score(F.col("evidence"), F.col("veto.cap")))


@query("h1_hard_score", duck("checks") + f"""SELECT trace_id, round(sum(w*s)/sum(w), 6) AS hard FROM (
    SELECT trace_id, {HARD_W} AS w, avg(score) AS s FROM checks GROUP BY trace_id, dimension) GROUP BY trace_id""")
def h1(v):
    return S.hard_score(v.checks).select("trace_id", r6("hard"))


@query("h2_soft_score", duck("checks") + f"SELECT trace_id, round(sum({SOFT_W}*score)/sum({SOFT_W}), 6) AS soft FROM checks WHERE check_type = 'judge' GROUP BY trace_id")
def h2(v):
    return S.soft_score(v.checks.where("check_type = 'judge'")).select("trace_id", r6("soft"))


@query("h3_objective_score", duck("runs", COMPONENTS) + "SELECT trace_id, round(objective + 1e-9, 6) AS objective FROM c")
def h3(v):
    return _scored(v).select("trace_id", near(F.col("objective"), "objective"))


@query("h4_evidence_score", duck("runs checks", COMPONENTS + f", p AS (SELECT trace_id, sum({PENALTY}) AS penalty FROM checks WHERE NOT passed GROUP BY trace_id)")
       + f"SELECT c.trace_id, round(greatest(0.0, least(1.0, objective + {BONUS}) - coalesce(penalty, 0)) + 1e-9, 6) AS evidence FROM c LEFT JOIN p ON c.trace_id = p.trace_id")
def h4(v):
    penalty = S.severity_penalty(v.checks.where("not passed"))
    runs = _scored(v).select("trace_id", "objective", "soft").join(penalty, "trace_id", "left")
    return runs.select("trace_id", near(S.evidence_score(F.col("objective"), F.col("soft"), F.col("penalty")), "evidence"))


@query("h5_veto_cap", duck("runs", COMPONENTS) + f"SELECT trace_id, round({CAP}, 6) AS cap, {LABEL} AS label FROM c")
def h5(v):
    return _scored(v).select("trace_id", F.round("veto.cap", 6).alias("cap"), F.col("veto.label").alias("label"))


@query("h6_overall_score", duck("runs", COMPONENTS + f", f AS (SELECT trace_id, least(greatest(0.0, least(1.0, objective + {BONUS})), {CAP}) AS o FROM c)")
       + "SELECT trace_id, round(o + 1e-9, 6) AS overall, CAST(floor(round(o * 100 + 1e-9, 6) + 0.5) AS INTEGER) AS points FROM f")
def h6(v):
    return _scored(v).select("trace_id", near(F.col("final.overall"), "overall"), F.floor(F.round(F.col("final.overall") * 100 + 1e-9, 6) + 0.5).cast("int").alias("points"))


@query("h7_safety_dimensions", duck("runs", COMPONENTS) + """SELECT trace_id, concat_ws(',', CASE WHEN cust % 50 = 0 THEN 'dim1' END, CASE WHEN cust % 11 = 0 THEN 'dim2' END,
    CASE WHEN cust % 13 = 0 THEN 'dim3' END, CASE WHEN hard < 0.5 THEN 'dim9' END) AS dims FROM c""")
def h7(v):
    a, b, c, *_ = _flags()
    return v.runs.select("trace_id", F.array_join(S.safety_dimensions({"dim1": a, "dim2": b, "dim3": c, "dim9": F.col("hard") < 0.5}), ",").alias("dims"))


@query("h8_breakdown", duck("runs checks", """f AS (SELECT trace_id, coalesce(string_agg(check_id, ',' ORDER BY check_id) FILTER (WHERE NOT passed), '') AS failures FROM checks GROUP BY trace_id)""")
       + "SELECT runs.trace_id, round(0.30 * hard, 6) AS hard, round(0.14 * branch, 6) AS branch, failures FROM runs LEFT JOIN f ON runs.trace_id = f.trace_id")
def h8(v):
    parts = S.score_breakdown({k: F.col(k) for k in S.OBJECTIVE_WEIGHTS}, S.OBJECTIVE_WEIGHTS)
    runs = v.runs.select("trace_id", parts.alias("m")).join(S.failure_summary(v.checks), "trace_id", "left")
    return runs.select("trace_id", F.round(F.col("m")["hard"], 6).alias("hard"), F.round(F.try_element_at("m", F.lit("branch")), 6).alias("branch"), "failures")


PROGRESS = """p AS (SELECT t.trace_id, s.step_id, s.is_optional, s.weight, s.ord, l.first AS first FROM (SELECT DISTINCT trace_id, scenario_id FROM traced) t JOIN policies s USING (scenario_id)
    LEFT JOIN (SELECT trace_id, tool_name, min(turn) AS first FROM traced WHERE event_type = 'tool_executed' AND source <> 'guard' GROUP BY ALL) l ON l.trace_id = t.trace_id AND l.tool_name = s.action)"""


def _progress(v):
    first = v.traced.where("event_type = 'tool_executed' and source <> 'guard'").groupBy("trace_id", F.col("tool_name").alias("action")).agg(F.min("turn").alias("first"))
    need = v.traced.select("trace_id", "scenario_id").distinct().join(v.policies.drop("level", "words"), "scenario_id")
    return need.join(first, ["trace_id", "action"], "left").withColumn("completed", F.col("first").isNotNull())


@query("h9_progress_rate", duck("traced policies", PROGRESS) + "SELECT trace_id, round(sum(CASE WHEN NOT is_optional AND first IS NOT NULL THEN weight ELSE 0 END) / sum(CASE WHEN NOT is_optional THEN weight END), 6) AS progress FROM p GROUP BY trace_id")
def h9(v):
    return S.progress_rate(_progress(v)).select("trace_id", r6("progress"))


@query("h10_turn_efficiency", duck("messages") + "SELECT trace_id, round(least(1.0, 2.0 / count(DISTINCT turn)), 6) AS efficiency, least(1.0, 2.0 / count(DISTINCT turn)) >= 0.6 AS passed FROM messages WHERE role = 'agent' GROUP BY trace_id")
def h10(v):
    return S.turn_efficiency(v.messages, 2).select("trace_id", r6("efficiency"), "passed")


@query("h11_response_length", duck("messages", "r AS (SELECT trace_id, avg(CASE WHEN length(content) > 600 THEN 1.0 ELSE 0.0 END) AS rate FROM messages WHERE role = 'agent' GROUP BY trace_id)")
       + "SELECT trace_id, round(rate, 6) AS rate, round(CASE WHEN rate > 0.5 THEN 0.0 WHEN rate > 0.2 THEN greatest(0.0, 0.5 - (rate - 0.2) * 1.5) ELSE greatest(0.5, 1 - 2 * rate) END, 6) AS score FROM r")
def h11(v):
    return S.response_length_score(v.messages, 600).select("trace_id", r6("rate"), r6("score"))


@query("h12_required_tools", duck("traced policy_must", "s AS (SELECT trace_id, tool_name, bool_or(event_type = 'tool_executed') AS ok FROM traced WHERE source = 'guard' OR k % 3 = 0 GROUP BY ALL)")
       + """SELECT t.trace_id, m.tool_name, CASE WHEN ok THEN 'succeeded' WHEN ok IS NOT NULL THEN 'failed' ELSE 'not_called' END AS status
    FROM (SELECT DISTINCT trace_id, scenario_id FROM traced) t JOIN policy_must m USING (scenario_id) LEFT JOIN s ON s.trace_id = t.trace_id AND s.tool_name = m.tool_name""")
def h12(v):
    """A third of the events, and those of the guard, are calls; the others only report."""
    calls = v.traced.where("source = 'guard' or k % 3 = 0").withColumn("ok", F.col("event_type") == "tool_executed")
    return S.required_tool_checks(calls, v.traced, v.policy_must)


@query("h13_optional_steps", duck("traced policies", PROGRESS + ", taken AS (SELECT DISTINCT trace_id, 'complete' AS step_id FROM traced WHERE k % 19 = 0)")
       + """SELECT p.trace_id, p.step_id, CASE WHEN first IS NOT NULL THEN 'completed' WHEN is_optional AND taken.step_id IS NULL THEN 'not_applicable' ELSE 'missed' END AS status
    FROM p LEFT JOIN taken ON taken.trace_id = p.trace_id AND taken.step_id = p.step_id""")
def h13(v):
    taken = v.traced.where("k % 19 = 0").select("trace_id", F.lit("complete").alias("step_id"))
    return S.optional_steps(_progress(v), taken).select("trace_id", "step_id", "status")


JUDGED = """j AS (SELECT trace_id, concat('d', CAST(line % 2 AS VARCHAR)) AS dim_id, concat('a', CAST(part % 5 AS VARCHAR)) AS atom_id,
      CASE qty % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'partial' WHEN 2 THEN 'no' ELSE 'na' END AS status, supp % 3 > 0 AS evidence_found, line * 1000000 + part * 100 + qty AS pos FROM checks),
    first AS (SELECT trace_id, dim_id, atom_id, arg_min(status, pos) AS status, arg_min(evidence_found, pos) AS ev FROM j GROUP BY ALL),
    x AS (SELECT d AS dim_id, concat('a', CAST(i AS VARCHAR)) AS atom_id FROM (VALUES ('d0'), ('d1')) t(d), range(4) r(i)),
    n AS (SELECT t.trace_id, x.dim_id, CASE WHEN status = 'yes' AND NOT ev THEN 'partial' WHEN status = 'partial' AND NOT ev THEN 'no' ELSE coalesce(status, 'na') END AS s
      FROM (SELECT DISTINCT trace_id FROM j) t CROSS JOIN x LEFT JOIN first f ON f.trace_id = t.trace_id AND f.dim_id = x.dim_id AND f.atom_id = x.atom_id),
    g AS (SELECT trace_id, dim_id, coalesce(sum(CASE s WHEN 'yes' THEN 1.0 WHEN 'partial' THEN 0.5 WHEN 'no' THEN 0.0 END), 0.0) AS points,
      count(CASE WHEN s <> 'na' THEN 1 END) AS n, count(*) AS a FROM n GROUP BY ALL),
    h AS (SELECT *, least(5, CAST(floor(points / (n + 0.5 * (a - n)) * 5 + 0.5) AS INTEGER)) AS raw FROM g)"""


def _judged(v):
    status = F.element_at(F.array(*map(F.lit, ("yes", "partial", "no", "na"))), (F.col("qty") % 4 + 1).cast("int"))
    return v.checks.select(
        "trace_id", F.concat(F.lit("d"), (F.col("line") % 2).cast("string")).alias("dim_id"), F.concat(F.lit("a"), (F.col("part") % 5).cast("string")).alias("atom_id"),
        status.alias("status"), (F.col("supp") % 3 > 0).alias("evidence_found"), (F.col("line") * 1000000 + F.col("part") * 100 + F.col("qty")).alias("pos"),
    )


@query("h14_rubric_atoms", duck("checks", JUDGED) + "SELECT trace_id, dim_id, CAST(points AS DOUBLE) AS points, CASE WHEN n < 3 THEN least(raw, 2) ELSE raw END AS score, n < 3 AS undertested FROM h")
def h14(v):
    return S.rubric_atoms(_judged(v), v.values("dim_id string, atom_id string", [(d, f"a{i}") for d in ("d0", "d1") for i in range(4)]))


@query("h15_rubric_total", duck("checks", """r AS (SELECT trace_id, (sum(qty % 6) - count(CASE WHEN part % 9 = 0 THEN 1 END)) / (count(*) * 5.0) AS ratio FROM checks GROUP BY trace_id)""")
       + "SELECT trace_id, round(ratio, 6) AS ratio, CASE WHEN ratio >= 0.85 THEN 'A' WHEN ratio >= 0.68 THEN 'B' WHEN ratio >= 0.55 THEN 'C' ELSE 'D' END AS grade FROM r")
def h15(v):
    return S.rubric_total(v.checks.select("trace_id", (F.col("qty") % 6).alias("score"), (F.col("part") % 9 == 0).alias("triggered"))).select("trace_id", r6("ratio"), "grade")


@query("h16_arbitrate", duck("checks", """g AS (SELECT trace_id, status AS item_id, avg(qty % 6) AS m, median(qty % 6) AS mid, CAST(max(qty % 6) - min(qty % 6) AS BIGINT) AS spread, count(*) AS n FROM checks GROUP BY ALL)""")
       + "SELECT trace_id, item_id, round(CASE WHEN spread > 1.5 AND n >= 3 THEN mid ELSE m END, 6) AS score, spread, spread > 1 AS disagree FROM g")
def h16(v):
    return S.arbitrate(v.checks.select("trace_id", F.col("status").alias("item_id"), (F.col("qty") % 6).alias("score"))).select("trace_id", "item_id", r6("score"), "spread", "disagree")


NORMAL = """j AS (SELECT trace_id, concat('s', CAST(line % 3 AS VARCHAR)) AS item_id, qty % 9 - 2 AS score, CASE part % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'skipped' ELSE 'odd' END AS st,
      supp % 8 AS turn, part * 10000 + supp * 100 + qty AS pos FROM checks),
    f AS (SELECT trace_id, item_id, arg_min(score, pos) AS score, arg_min(st, pos) AS st, arg_min(turn, pos) AS turn FROM j GROUP BY ALL)"""


@query("h17_normalize_judgements", duck("checks messages", NORMAL) + """SELECT t.trace_id, i.item_id, least(greatest(coalesce(score, 0), 0), 5) AS score, CASE WHEN st IN ('completed', 'skipped') THEN st ELSE 'not_reached' END AS status,
      CASE WHEN m.turn IS NOT NULL THEN f.turn END AS turn, f.trace_id IS NULL AS missing
    FROM (SELECT DISTINCT trace_id FROM j) t CROSS JOIN (VALUES ('s0'), ('s1'), ('s2')) i(item_id) LEFT JOIN f ON f.trace_id = t.trace_id AND f.item_id = i.item_id
      LEFT JOIN messages m ON m.trace_id = f.trace_id AND m.turn = f.turn""")
def h17(v):
    status = F.when(F.col("part") % 3 == 0, "completed").when(F.col("part") % 3 == 1, "skipped").otherwise("odd")
    rows = v.checks.select("trace_id", F.concat(F.lit("s"), (F.col("line") % 3).cast("string")).alias("item_id"), (F.col("qty") % 9 - 2).alias("score"), status.alias("status"),
                           (F.col("supp") % 8).alias("turn"), (F.col("part") * 10000 + F.col("supp") * 100 + F.col("qty")).alias("pos"))
    return S.normalize_judgements(rows, v.values("item_id string", [("s0",), ("s1",), ("s2",)]), v.messages)


@query("h19_rule_dimensions", duck("checks") + "SELECT trace_id, " + ", ".join(
    f"round((coalesce(avg(score) FILTER (WHERE soft_dimension = 'D{i}'), avg(score)) + avg(score)) / 2, 6) AS D{i}" if i != 4 else "round((avg(score) FILTER (WHERE soft_dimension = 'D4') + avg(score)) / 2, 6) AS D4" for i in range(1, 7))
    + ", CASE WHEN round(avg(score), 6) >= 0.8 THEN 'A' WHEN round(avg(score), 6) >= 0.6 THEN 'B' WHEN round(avg(score), 6) >= 0.4 THEN 'C' ELSE 'D' END AS grade FROM checks GROUP BY trace_id")
def h19(v):
    rows = S.rule_dimensions(v.checks)
    again = v.checks.groupBy("trace_id").agg(S.grade(F.round(F.avg("score"), 6), S.RULE_GRADES).alias("grade"))
    return rows.drop("grade").join(again, "trace_id").select("trace_id", *(r6(f"D{i}") for i in range(1, 7)), "grade")


@query("h20_atom_faults", duck("checks") + """SELECT trace_id, check_id, part, supp, qty FROM checks WHERE (check_type = 'rule' AND supp % 10 = 0) OR (NOT passed AND qty % 7 > 4)""")
def h20(v):
    atoms = v.checks.withColumns({"objective": F.col("check_type") == "rule", "evidence": F.col("supp") % 10, "verdict": F.when(F.col("passed"), "pass").otherwise("fail"),
                                  "awarded": F.when(F.col("qty") % 7 > 4, 1).otherwise(0)})
    return S.atom_faults(atoms).select("trace_id", "check_id", "part", "supp", "qty")


@query("h21_booking_score", duck("checks", """g AS (SELECT trace_id, avg(score) FILTER (WHERE check_type = 'rule') AS r, avg(score) FILTER (WHERE check_type = 'judge') AS j FROM checks GROUP BY trace_id),
    s AS (SELECT trace_id, round(CASE WHEN j IS NULL THEN r ELSE 0.6 * coalesce(r, 0) + 0.4 * j END, 6) AS score FROM g)""")
       + "SELECT trace_id, score, CASE WHEN score * 32 >= 27 THEN 'A' WHEN score * 32 >= 22 THEN 'B' WHEN score * 32 >= 18 THEN 'C' ELSE 'D' END AS grade FROM s")
def h21(v):
    rows = S.booking_score(v.checks).select("trace_id", r6("score"))
    return rows.withColumn("grade", S.grade(F.col("score") * 32, S.BOOKING_GRADES))


@query("h22_merge_violations", duck("ledger", """s AS (SELECT trace_id, tool_name AS b, turn % 50 AS turn, 'major' AS severity, 'keyword' AS source, 0 AS p FROM ledger WHERE k % 5 = 0
    UNION ALL SELECT trace_id, tool_name, turn % 50, 'minor', 'semantic', 1 FROM ledger WHERE k % 3 = 0)""")
       + "SELECT trace_id, b AS behavior_id, turn, arg_min(severity, p) AS severity, arg_min(source, p) AS source FROM s GROUP BY ALL")
def h22(v):
    rows = [v.ledger.where(f"k % {n} = 0").select("trace_id", F.col("tool_name").alias("behavior_id"), (F.col("turn") % 50).alias("turn"), F.lit(sev).alias("severity"), F.lit(src).alias("source"))
            for n, sev, src in ((5, "major", "keyword"), (3, "minor", "semantic"))]
    return S.merge_violations(rows)


@query("h23_run_validity", duck("runs") + """SELECT trace_id, CASE WHEN cust % 9 = 0 THEN 'invalid' ELSE 'valid' END AS status,
    CASE WHEN cust % 9 = 0 OR overall IS NULL THEN 'not_scored' WHEN overall >= 0.6 THEN 'success' ELSE 'failed' END AS outcome FROM runs""")
def h23(v):
    return v.runs.select("trace_id", S.run_validity(F.col("cust") % 9 == 0, F.col("overall")).alias("v")).select("trace_id", "v.*")


@query("h24_replay_score", duck("runs", COMPONENTS) + f"SELECT trace_id, round(least(1.0, objective + {BONUS}) + 1e-9, 6) AS replayed, abs(least(1.0, objective + {BONUS}) - overall) <= 0.005 AS matches FROM c")
def h24(v):
    return S.replay_score(v.runs).select("trace_id", near(F.col("replayed"), "replayed"), "matches")


def _count(words: list[str]) -> str:
    return "(" + " + ".join(f"CASE WHEN contains(lower(content), '{w}') THEN 1 ELSE 0 END" for w in words) + ")"


CONSISTENCY = f"""j AS (SELECT trace_id, turn AS item_id, (trace_id + turn * 3) % 8 - 1 AS s, {_count(['nicht', 'not', 'pas '])} AS bad, {_count(['the', 'und', 'que'])} AS good, {_count(['tion'])} AS den, CASE WHEN trace_id % 5 > 0 THEN 'x' END AS ev,
      turn % 3 = 0 AS safe FROM messages),
    f AS (SELECT trace_id, item_id, list_filter([CASE WHEN s NOT BETWEEN 0 AND 5 THEN 'out_of_range' END, CASE WHEN s >= 4 AND bad >= 2 THEN 'praised_fault' END, CASE WHEN s <= 1 AND good > 0 AND bad = 0 THEN 'blamed_virtue' END,
      CASE WHEN ev IS NULL THEN 'no_evidence' END, CASE WHEN safe AND s > 0 AND den > 0 THEN 'safety_denied' END], lambda x: x IS NOT NULL) AS l FROM j)"""


@query("h18_judge_consistency", duck("messages", CONSISTENCY) + "SELECT trace_id, item_id, array_to_string(l, ',') AS faults, len(l) >= 2 OR list_contains(l, 'safety_denied') AS needs_rejudge FROM f")
def h18(v):
    judged = v.messages.select("trace_id", F.col("turn").alias("item_id"), F.expr("(trace_id + turn * 3) % 8 - 1").alias("score"), F.col("content").alias("reason"),
                               F.expr("case when trace_id % 5 > 0 then 'x' end").alias("evidence"), F.expr("turn % 3 = 0").alias("is_safety"))
    rows = S.judge_consistency(judged, ["nicht", "not", "pas "], ["the", "und", "que"], ["tion"])
    return rows.select("trace_id", "item_id", F.array_join("faults", ",").alias("faults"), "needs_rejudge")
