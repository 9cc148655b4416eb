"""Set operations between what is required, what was tested and what was seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_tools(traces: DataFrame, required: DataFrame, called: DataFrame) -> DataFrame:
    """trace_id, tool_name of tools that a trace's policy (scenario_id, tool_name) requires and the trace (trace_id, scenario_id) didn't call."""
    wanted = traces.select("trace_id", "scenario_id").distinct().join(required.select("scenario_id", "tool_name").distinct(), "scenario_id").select("trace_id", "tool_name")
    return wanted.join(called.select("trace_id", "tool_name"), ["trace_id", "tool_name"], "left_anti")


def untested_steps(steps: DataFrame, entries: DataFrame) -> DataFrame:
    """step_id of steps that no run completed, failed or skipped."""
    seen = entries.where(F.col("status").isin("completed", "failed", "skipped")).select("step_id").distinct()
    return steps.select("step_id").distinct().join(seen, "step_id", "left_anti")


def covered_branches(branches: DataFrame, taken: DataFrame) -> DataFrame:
    """scenario_id, step_id, next_step of branches that some run took."""
    keys = ["scenario_id", "step_id", "next_step"]
    return branches.select(keys).distinct().join(taken.select(keys).distinct(), keys, "left_semi")


def distinct_violations(keyword: DataFrame, semantic: DataFrame) -> DataFrame:
    """trace_id, behavior_id, turn, source: one per behaviour and turn; keyword hits win."""
    return keyword.unionByName(semantic).groupBy("trace_id", "behavior_id", "turn").agg(F.min("source").alias("source"))
