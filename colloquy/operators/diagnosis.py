"""Why traces fail: deviation points, failure modes, causal roots and repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.sources.shared import written

SEVERITY = [("critical", {"safety_violation", "fabrication"}), ("high", {"branch_error", "tool_avoidance"}), ("medium", {"step_skipping", "repetition"})]
ADVICE = {"step_skipping": "cover every required step", "tool_avoidance": "call the required tools", "branch_error": "check the branch condition", "safety_violation": "remove forbidden content"}
#: Where a failure starts, most basic first.
MODE_ORDER = ["tool", "branch", "temporal", "step"]


def deviation_point(facts: DataFrame) -> DataFrame:
    """trace_id, kind, turn: the first of too few turns, missing tool, bad closing, skipped step that a trace has.

    `facts` (trace_id, agent_turns, missing_tool_turn, closing_ok, last_turn, skipped_turn)."""
    at = lambda on, kind, turn: F.when(on, F.struct(F.lit(kind).alias("kind"), turn.cast("long").alias("turn")))
    first = F.coalesce(at(F.col("agent_turns") < 2, "too_short", F.col("last_turn")), at(F.col("missing_tool_turn").isNotNull(), "missing_tool", F.col("missing_tool_turn")),
                       at(~F.col("closing_ok"), "bad_closing", F.col("last_turn")), at(F.col("skipped_turn").isNotNull(), "skipped_step", F.col("skipped_turn")))
    return facts.select("trace_id", first.alias("d")).where("d is not null").select("trace_id", "d.*")


def failure_modes(rules: dict[str, Column]) -> Column:
    """Names of the modes that hold, in order."""
    return F.array_compact(F.array(*(F.when(on, mode) for mode, on in rules.items())))


def _only(modes: Column, members: set[str]) -> Column:
    return F.filter(modes, lambda m: m.isin(*sorted(members)))


def severity_and_cause(modes: Column) -> Column:
    """severity and the first mode of that severity; low without modes."""
    out = F.when(F.size(modes) == 0, F.struct(F.lit("low").alias("severity"), F.lit(None).cast("string").alias("cause")))
    for name, members in SEVERITY:
        own = _only(modes, members)
        out = out.when(F.size(own) > 0, F.struct(F.lit(name).alias("severity"), F.get(own, F.lit(0)).alias("cause")))
    return out.otherwise(F.struct(F.lit("low").alias("severity"), F.get(modes, F.lit(0)).alias("cause")))


def recommendations(modes: Column, advice: dict[str, str] = ADVICE) -> Column:
    table = F.create_map(*(F.lit(x) for kv in advice.items() for x in kv))
    return F.array_compact(F.transform(modes, lambda m: F.try_element_at(table, m)))


def unsatisfied(verdicts: DataFrame) -> DataFrame:
    """scenario_id, trace_id, atom, weight (the largest loss) of unsatisfied atoms."""
    return verdicts.where("verdict = 'unsatisfied'").groupBy("scenario_id", "trace_id", "atom").agg(F.max(F.abs("delta")).alias("weight"))


def failed_causes(bad: DataFrame, causes: DataFrame) -> DataFrame:
    """trace_id, src, dst: the causes (scenario_id, src, dst) of a policy whose ends are both unsatisfied in a trace of it."""
    ends = bad.select("scenario_id", "trace_id", F.col("atom").alias("dst")).join(causes.distinct(), ["scenario_id", "dst"])
    return ends.join(bad.select("trace_id", F.col("atom").alias("src")), ["trace_id", "src"]).select("trace_id", "src", "dst")


def causal_roots(verdicts: DataFrame, causes: DataFrame) -> DataFrame:
    """trace_id, atom of unsatisfied atoms (scenario_id, trace_id, atom, verdict, delta) none of whose causes in their policy is unsatisfied."""
    bad = unsatisfied(verdicts)
    caused = failed_causes(bad, causes).select("trace_id", F.col("dst").alias("atom")).distinct()
    return bad.select("trace_id", "atom").join(caused, ["trace_id", "atom"], "left_anti")


def failure_kind(verdicts: DataFrame, order: list[str] = MODE_ORDER) -> DataFrame:
    """trace_id, kind: of the unsatisfied atoms' kinds the most basic one."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("kind"))
    return verdicts.where("verdict = 'unsatisfied'").groupBy("trace_id").agg(F.min_by("kind", place).alias("kind"))


def counterfactual_repair(verdicts: DataFrame, causes: DataFrame) -> DataFrame:
    """trace_id, atom, recovers, gain: how many atoms are satisfied once an unsatisfied one is repaired, itself included, and the share of weight in that.

    An atom recovers when all its unsatisfied causes (`causes`: scenario_id, src, dst) have, and it has some. All repairs of all traces take a round together,
    until one brings nothing new; a round looks at what follows from the atoms of the last one. Atoms on a cycle of causes recover by their own repair only.
    Rounds are sorted to meet: what they have written is far smaller as a file than as rows, so Spark would send it whole through the driver.
    """
    merged = lambda df, name: written(df, name).hint("merge")
    bad = merged(unsatisfied(verdicts), "unsatisfied")
    links = merged(failed_causes(bad, causes).distinct(), "causes")
    need = links.groupBy("trace_id", "dst").agg(F.count("*").alias("need")).hint("merge")
    good = merged(bad.select("trace_id", F.col("atom").alias("root"), "atom"), "good")
    new = good
    while not new.isEmpty():
        touched = new.join(links.withColumnRenamed("src", "atom"), ["trace_id", "atom"]).select("trace_id", "root", "dst").distinct()
        met = touched.join(links, ["trace_id", "dst"]).join(good.withColumnRenamed("atom", "src").hint("merge"), ["trace_id", "root", "src"])
        full = met.groupBy("trace_id", "root", "dst").agg(F.count("*").alias("met")).join(need, ["trace_id", "dst"]).where("met = need")
        new = merged(full.select("trace_id", "root", F.col("dst").alias("atom")).join(good.hint("merge"), ["trace_id", "root", "atom"], "left_anti"), "new")
        good = good.unionByName(new)
    total = bad.groupBy("trace_id").agg(F.greatest(F.sum("weight"), F.lit(1.0)).alias("total")).hint("merge")
    sums = good.join(bad.select("trace_id", "atom", "weight"), ["trace_id", "atom"]).groupBy("trace_id", "root").agg(F.count("*").alias("recovers"), F.sum("weight").alias("sum"))
    return sums.join(total, "trace_id").select("trace_id", F.col("root").alias("atom"), "recovers", (F.col("sum") / F.col("total") * 0.25).alias("gain"))


def dialogue_side_quality(messages: DataFrame, meta: Column, refuse: Column, agree: Column, long_: int = 100) -> DataFrame:
    """trace_id, leaks, long_share, refusals, agreements, ok: quality of the user side."""
    g = messages.where("role = 'user'").groupBy("trace_id").agg(
        F.sum(meta.cast("long")).alias("leaks"), F.avg((F.length("content") > long_).cast("double")).alias("long_share"), F.sum(refuse.cast("long")).alias("refusals"), F.sum(agree.cast("long")).alias("agreements")
    )
    return g.withColumn("ok", (F.col("leaks") == 0) & (F.col("long_share") <= 0.2))


def review_checklist(checks: DataFrame, violations: DataFrame) -> DataFrame:
    """trace_id, item, turn, source: one row per automatic check to look at."""
    a = checks.select("trace_id", F.col("check_id").alias("item"), F.col("line").cast("long").alias("turn"), F.lit("check").alias("source"))
    b = violations.select("trace_id", F.col("behavior_id").alias("item"), F.col("turn").cast("long").alias("turn"), F.lit("violation").alias("source"))
    return a.unionByName(b)
