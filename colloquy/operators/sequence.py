"""Windows and sequences within a trace."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.functions.text import matches_any, template_elements

#: Strategies of a user simulator by how often the agent refused.
ESCALATION = ["calm", "insistent", "annoyed", "angry", "threatening"]


def in_trace():
    return Window.partitionBy("trace_id").orderBy("msg_idx")


def so_far():
    return in_trace().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def verbatim_repetition(messages: DataFrame, similar) -> DataFrame:
    """trace_id, turn of agent messages that repeat the one before, blanks around them aside; empty ones and pairs of up to 5 characters don't count.

    `similar(previous, current)` is a condition, e.g. `fuzzy.similar` with a threshold.
    """
    rows = messages.where("role = 'agent'").withColumn("content", F.trim(F.col("content"), F.lit(" \t\n\x0b\x0c\r"))).withColumn("before", F.lag("content").over(in_trace()))
    long_ = F.greatest(F.length("before"), F.length("content")) > 5
    fit = (F.length("before") > 0) & (F.length("content") > 0) & long_
    return rows.where(fit & similar(F.when(fit, F.col("before")), F.when(fit, F.col("content")))).select("trace_id", "turn")


def opening_closing(messages: DataFrame, opening: str | None, closing: str | None) -> DataFrame:
    """trace_id, opening_ok, closing_ok: first and last agent message hold 60 % and 50 % of the template's parts."""
    g = messages.where("role = 'agent'").groupBy("trace_id").agg(F.min_by("content", "msg_idx").alias("first"), F.max_by("content", "msg_idx").alias("last"))
    every = messages.select("trace_id").distinct().join(g, "trace_id", "left")

    def ok(c: str, template: str | None, share: float) -> Column:
        if not template:
            return F.lit(True)
        parts = template_elements(F.lit(template))
        return F.coalesce(F.size(F.filter(parts, lambda p: F.col(c).contains(p))) >= share * F.size(parts), F.lit(False))

    return every.select("trace_id", ok("first", opening, 0.6).alias("opening_ok"), ok("last", closing, 0.5).alias("closing_ok"))


def mechanical_openings(messages: DataFrame, prefix: int = 30, least: int = 3) -> DataFrame:
    """trace_id, mechanical: enough agent messages and a repeated beginning."""
    g = messages.where("role = 'agent'").groupBy("trace_id").agg(F.count("*").alias("n"), F.count_distinct(F.substring("content", 1, prefix)).alias("d"))
    return g.select("trace_id", ((F.col("n") >= least) & (F.col("d") < F.col("n"))).alias("mechanical"))


def pressure_floor(messages: DataFrame, patterns: list[str], floors: list[tuple[int, int]]) -> DataFrame:
    """trace_id, turn, pressure (agent turns with a pressure phrase so far), floor (value of the highest threshold reached)."""
    hit = ((F.col("role") == "agent") & matches_any(F.col("content"), patterns)).cast("int")
    rows = messages.withColumn("pressure", F.sum(hit).over(so_far()))
    floor = F.greatest(F.lit(0), *(F.when(F.col("pressure") >= at, value).otherwise(0) for at, value in floors))
    return rows.select("trace_id", "turn", "pressure", floor.alias("floor"))


def escalation_level(messages: DataFrame, patterns: list[str], names: list[str] = ESCALATION) -> DataFrame:
    """trace_id, turn, level (refusals so far, 4 at most), strategy."""
    hit = ((F.col("role") == "agent") & matches_any(F.col("content"), patterns)).cast("int")
    level = F.least(F.sum(hit).over(so_far()), F.lit(len(names) - 1)).cast("int")
    return messages.withColumn("level", level).select("trace_id", "turn", "level", F.element_at(F.array(*map(F.lit, names)), F.col("level") + 1).alias("strategy"))


def emotion_resolution(states: DataFrame, negative: list[str], resolved: list[str]) -> DataFrame:
    """trace_id, trajectory, score: of traces with a negative state, 1 if the last one is resolved, else 0.3."""
    g = states.groupBy("trace_id").agg(
        F.bool_or(F.col("state").isin(negative)).alias("ever"), F.max_by("state", "msg_idx").alias("last"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("msg_idx", "state"))), lambda s: s["state"]), ">").alias("trajectory"),
    )
    return g.where("ever").select("trace_id", "trajectory", F.when(F.col("last").isin(resolved), 1.0).otherwise(0.3).alias("score"))


def tool_frequency_anomaly(ledger: DataFrame, threshold: int = 5) -> DataFrame:
    """trace_id, tool_name, n of the most frequent tool where that is `threshold` or more; ties by name."""
    g = ledger.groupBy("trace_id", "tool_name").agg(F.count("*").alias("n"))
    return g.where(F.col("n") >= threshold).groupBy("trace_id").agg(F.min_by(F.struct("tool_name", "n"), F.struct(-F.col("n"), F.col("tool_name"))).alias("w")).select("trace_id", "w.*")


def first_tool_turn(ledger: DataFrame) -> DataFrame:
    return ledger.where("event_type = 'tool_executed'").groupBy("trace_id", "tool_name").agg(F.min("turn").alias("turn"))


def fault_recovery(ledger: DataFrame, fault: Column) -> DataFrame:
    """trace_id, tool_name, recovered: did a call without an error follow the tool's first fault?"""
    g = ledger.groupBy("trace_id", "tool_name").agg(F.min(F.when(fault, F.col("seq"))).alias("f"), F.max(F.when(F.col("error").isNull() & ~fault, F.col("seq"))).alias("ok"))
    return g.where("f is not null").select("trace_id", "tool_name", F.coalesce(F.col("ok") > F.col("f"), F.lit(False)).alias("recovered"))


def constraint_lifecycle(events: DataFrame) -> DataFrame:
    """trace_id, constraint_id, status from events (trace_id, constraint_id, event): a violated constraint is recovered if satisfied later on,
    else violated; then satisfied, acknowledged, revealed, introduced."""
    has = lambda e: F.bool_or(F.col("event") == e)
    g = events.groupBy("trace_id", "constraint_id").agg(*(has(e).alias(e) for e in ("violated", "satisfied", "acknowledged", "revealed")))
    status = F.when(F.col("violated") & F.col("satisfied"), "recovered")
    for e in ("violated", "satisfied", "acknowledged", "revealed"):
        status = status.when(F.col(e), e)
    return g.select("trace_id", "constraint_id", status.otherwise("introduced").alias("status"))


def final_state(rows: DataFrame, least: int, budget: float) -> DataFrame:
    """trace_id, enough (rows), status (of the latest row), within_budget."""
    return rows.groupBy("trace_id").agg((F.count("*") >= least).alias("enough"), F.max_by("status", "seq").alias("status"), (F.sum("amount") <= budget).alias("within_budget"))


def constraint_tool_usage(required: DataFrame, ledger: DataFrame) -> DataFrame:
    """trace_id, constraint_id, used: was the tool of each of the policy's constraints (scenario_id, constraint_id, tool_name) called at all?"""
    called = ledger.select("trace_id", "tool_name").distinct().withColumn("used", F.lit(True))
    rows = ledger.select("trace_id", "scenario_id").distinct().join(required, "scenario_id")
    return rows.join(called, ["trace_id", "tool_name"], "left").select("trace_id", "constraint_id", F.coalesce("used", F.lit(False)).alias("used"))


def state_snapshots(ledger: DataFrame, changing: list[str]) -> DataFrame:
    """trace_id, seq, n_changes, total after each state-changing call."""
    w = Window.partitionBy("trace_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ledger.where(F.col("tool_name").isin(changing) & (F.col("event_type") == "tool_executed"))
    return rows.select("trace_id", "seq", F.count("*").over(w).alias("n_changes"), F.sum("amount").over(w).alias("total"))


def step_progress(ledger: DataFrame, steps: DataFrame) -> DataFrame:
    """trace_id, step_id, turn at which a tool of the step of the trace's policy first succeeds."""
    own = first_tool_turn(ledger).join(ledger.select("trace_id", "scenario_id").distinct(), "trace_id")
    hit = own.join(steps.select("scenario_id", "step_id", F.col("action").alias("tool_name")), ["scenario_id", "tool_name"])
    return hit.groupBy("trace_id", "step_id").agg(F.min("turn").alias("turn"))


def any_word(words: list[str]) -> Column:
    return reduce(Column.__or__, (F.col("content").contains(w) for w in words))
