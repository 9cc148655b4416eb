"""Joins of traces with policies, lexicons, ledgers and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.lexicons import FORBIDDEN_SYNONYMS
from colloquy.operators.matching import first_words
from colloquy.operators.scoring import OBJECTIVE_WEIGHTS


def attach_scenario(traces: DataFrame, scenarios: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Traces with their scenario's columns, and the traces whose scenario is unknown."""
    return traces.join(scenarios, "scenario"), traces.join(scenarios.select("scenario"), "scenario", "left_anti")


def fabricated_calls(calls: DataFrame, executed: DataFrame) -> DataFrame:
    """Calls without an error that the ledger doesn't know."""
    return calls.where("error is null").join(executed.select("trace_id", "call_id").distinct(), ["trace_id", "call_id"], "left_anti")


def forbidden_hits(messages: DataFrame, behaviors: DataFrame, synonyms: dict[str, list[str]] = FORBIDDEN_SYNONYMS) -> DataFrame:
    """trace_id, behavior_id, turn, severity, keyword of the forbidden behaviours of each trace's policy in its agent messages.

    `behaviors` (scenario_id, behavior_id, severity, keywords: an array in order of declaration). The keyword is the first one, or the first
    of its synonyms, that the normalised delivered text (`norm`) holds; if none does, the raw text (`norm_raw`) is looked at, and a
    hit there is major. One row per behaviour and turn. Each text is read once, whatever the number of keywords.
    """
    more = F.create_map(*(F.lit(x) for k, ws in synonyms.items() for x in (k, ws))) if synonyms else F.create_map().cast("map<string,array<string>>")
    words = F.flatten(F.transform("keywords", lambda k: F.concat(F.array(k), F.coalesce(F.try_element_at(more, k), F.array().cast("array<string>")))))
    lists = behaviors.select("scenario_id", F.struct("behavior_id", "severity").alias("list_id"), words.alias("words"))
    rows = first_words(messages.where("role = 'agent'"), lists, ["norm", "norm_raw"], ["trace_id", "turn"])
    hit = F.struct(F.col("norm").isNull().alias("hidden"), F.coalesce("norm", "norm_raw").alias("keyword"), F.when(F.col("norm").isNull(), "major").otherwise(F.col("list_id.severity")).alias("severity"))
    found = rows.select("trace_id", F.col("list_id.behavior_id").alias("behavior_id"), "turn", hit.alias("h"))
    return found.groupBy("trace_id", "behavior_id", "turn").agg(F.min("h").alias("h")).select("trace_id", "behavior_id", "turn", "h.severity", "h.keyword")


def branch_evidence(users: DataFrame, branch_turns: DataFrame, words: dict[str, list[str]]) -> DataFrame:
    """trace_id, step_id, cond, turn: user messages from one turn before the branch to two after it with a word of the condition."""
    said = reduce(lambda a, kv: F.array_append(a, F.when(reduce(Column.__or__, (F.col("content").contains(w) for w in kv[1])), F.lit(kv[0]))), words.items(), F.array().cast("array<string>"))
    near = users.join(branch_turns, "trace_id").where("turn between branch_turn - 1 and branch_turn + 2")
    return near.select("trace_id", "step_id", "turn", F.explode(F.array_compact(said)).alias("cond"))


def first_response_after(agents: DataFrame, users: DataFrame) -> DataFrame:
    """Agent turns with the turn of the first user message at or after it (forward as-of join).

    One ordered pass per trace over both sides: the next user message is a running minimum from the end, so no pairs are made.
    """
    from pyspark.sql.window import Window

    both = agents.select("trace_id", "turn", F.lit(0).alias("side")).unionByName(users.select("trace_id", "turn", F.lit(1).alias("side")))
    ahead = Window.partitionBy("trace_id").orderBy("turn", "side").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return both.withColumn("response_turn", F.min(F.when(F.col("side") == 1, F.col("turn"))).over(ahead)).where("side = 0").drop("side")


def state_match(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """trace_id, matched, total, score: expected rows of which some actual row has all (key, value) pairs.

    `expected` (trace_id, row_id, table_name, key, value), `actual` (trace_id, table_name, row_idx, key, value).
    """
    hit = expected.join(actual, ["trace_id", "table_name", "key", "value"]).groupBy("trace_id", "row_id", "row_idx").agg(F.count("*").alias("n"))
    best = hit.groupBy("trace_id", "row_id").agg(F.max("n").alias("n"))
    need = expected.groupBy("trace_id", "row_id").agg(F.count("*").alias("need"))
    rows = need.join(best, ["trace_id", "row_id"], "left").select("trace_id", (F.coalesce("n", F.lit(0)) >= F.col("need")).cast("int").alias("ok"))
    return rows.groupBy("trace_id").agg(F.sum("ok").alias("matched"), F.count("*").alias("total"), F.avg("ok").alias("score"))


def coverage_gaps(branches: DataFrame, taken: DataFrame) -> DataFrame:
    """Branches that no run took."""
    return branches.join(taken.select("scenario_id", "step_id", "next_step").distinct(), ["scenario_id", "step_id", "next_step"], "left_anti")


def validated_outcome(ledger: DataFrame, causal_tool: str, log_tool: str, proof: Column) -> DataFrame:
    """trace_id, valid: a result is logged, its causal tool last ran before the first log, and a business row proves it."""
    seq = F.col("seq")
    g = ledger.groupBy("trace_id").agg(
        F.max(F.when(F.col("tool_name") == causal_tool, seq)).alias("cause"), F.min(F.when(F.col("tool_name") == log_tool, seq)).alias("log"), F.bool_or(proof).alias("proof")
    )
    return g.select("trace_id", (F.coalesce(F.col("cause") <= F.col("log"), F.lit(False)) & F.coalesce("proof", F.lit(False))).alias("valid"))


def replay_grid(components: DataFrame, weights: dict[str, float] = OBJECTIVE_WEIGHTS) -> DataFrame:
    """trace_id, config, score: every trace under every configuration, as an array in each row that is then exploded."""
    parts = {k: F.coalesce(F.col(k), F.lit(0.0)) * w for k, w in weights.items()}
    configs = {"full": None, **{f"no_{k}": k for k in weights}}
    rows = F.array(*(F.struct(F.lit(n).alias("config"), sum((c for k, c in parts.items() if k != out), F.lit(0.0)).alias("score")) for n, out in configs.items()))
    return components.select("trace_id", F.explode(rows).alias("r")).select("trace_id", "r.*")
