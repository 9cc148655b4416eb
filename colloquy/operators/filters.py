"""Filters and validity checks of messages, ledgers, traces and policies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Columns of a scenario that an agent must not see.
ANSWER_KEY = ["expected_steps_completed", "expected_branch_taken", "expected_call_result", "must_call_tools", "expected_db_state", "canonical_intent", "context_checkpoints", "trace_match_mode", "knowledge_points"]


def scored_messages(messages: DataFrame) -> DataFrame:
    """Messages that count: without those of the book-keeping round after the call."""
    return messages.where(~F.coalesce(F.col("post_call"), F.lit(False)))


def agent_safe_view(scenarios: DataFrame, hidden: list[str] = ANSWER_KEY) -> DataFrame:
    return scenarios.drop(*hidden)


def drop_rolled_back(ledger: DataFrame) -> DataFrame:
    """Executions whose call wasn't rolled back in the same trace."""
    back = ledger.where((F.col("event_type") == "tool_rollback") & (F.col("call_id") != "")).select("trace_id", "call_id").distinct()
    return ledger.where("event_type = 'tool_executed'").join(back, ["trace_id", "call_id"], "left_anti")


def successful_tool_events(ledger: DataFrame, order_ids: DataFrame | None = None) -> DataFrame:
    """Executions without an error, not by the guard, not rolled back, of the trace's own order or of none."""
    ok = drop_rolled_back(ledger).where("coalesce(error, '') = '' and source <> 'guard'")
    if order_ids is not None:
        ok = ok.join(order_ids.select("trace_id", F.col("order_id").alias("own")), "trace_id", "left").where("order_id is null or order_id = own").drop("own")
    return ok


def successful_calls(calls: DataFrame, entity_tools: list[str]) -> DataFrame:
    """Without a ledger: calls without an error; tools that need an order id count only with one."""
    return calls.where(F.col("error").isNull() & (~F.col("tool_name").isin(entity_tools) | F.col("order_id").isNotNull()))


def eligible_runs(runs: DataFrame, excluded: DataFrame, models: str) -> DataFrame:
    """Scored runs that are neither excluded by id nor by a pattern of their model's name."""
    return runs.where(F.col("overall").isNotNull() & ~F.col("model").rlike(models)).join(excluded.select("trace_id"), "trace_id", "left_anti")


def tool_markup_leaks(messages: DataFrame, with_calls: DataFrame, pattern: str = r"<tool_call>|</?function|\"tool_name\"\s*:") -> DataFrame:
    """trace_id, turn of agent messages without tool calls whose text holds raw tool markup."""
    hits = messages.where((F.col("role") == "agent") & F.col("content").rlike(pattern))
    return hits.join(with_calls.select("trace_id", "turn").distinct(), ["trace_id", "turn"], "left_anti").select("trace_id", "turn")


def find_traces(traces: DataFrame, wanted: DataFrame) -> DataFrame:
    """Traces whose id contains one of the wanted strings; the list is a short one, typed by a user."""
    return traces.join(wanted, F.expr("contains(cast(trace_id as string), wanted)"), "left_semi")


def first_fault(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that is broken; null if none is."""
    return F.coalesce(*(F.when(bad, name) for name, bad in rules))


def validate_tool_calls(calls: DataFrame, most: float = 500.0) -> DataFrame:
    """trace_id, seq, fault: the first broken rule of each faulty call."""
    amount = F.col("amount")
    rules = [
        ("missing_order", F.col("order_id").isNull()), ("wrong_order", F.col("order_id") != F.col("own_order")), ("long_text", F.length("note") > 500),
        ("bad_amount", amount.isNull() | (amount <= 0)), ("too_much", amount > most), ("bad_time", ~F.col("slot").rlike(r"^([01]\d|2[0-3]):[0-5]\d$")),
        ("failed", F.col("error").isNotNull()),
    ]
    return calls.withColumn("fault", first_fault(rules)).where("fault is not null").select("trace_id", "seq", "fault")


def findings(*parts: tuple[str, DataFrame]) -> DataFrame:
    """rule, subject: a union of findings; each part has a column subject."""
    return reduce(DataFrame.unionByName, (df.select(F.lit(rule).alias("rule"), F.col("subject").cast("string").alias("subject")).distinct() for rule, df in parts))


#: Beginnings of actions that are acts of speech, not tools, and the tool that an outcome needs: fixed values.
SPEECH_ACTS = ["self_", "confirm_", "state_", "offer_", "ask_", "say_", "apologize", "empathize", "final_", "restate_"]
OUTCOME_TOOLS = {"refunded": "create_compensation", "rescheduled": "reschedule_delivery", "confirmed": "query_order", "escalated": "transfer_to_human"}
IDENTITY_ACTIONS = ["confirm_name", "confirm_identity"]
LOG_TOOL, SELF_DISCLOSURE = "log_call_result", ["智能助手", "AI"]


def lint_policies(scenarios: DataFrame, steps: DataFrame, branches: DataFrame, must_call: DataFrame, forbidden: DataFrame, tools: DataFrame, *, speech: list[str] = SPEECH_ACTS, outcome_tools: dict[str, str] = OUTCOME_TOOLS,
                  identity: list[str] = IDENTITY_ACTIONS, log_tool: str = LOG_TOOL, disclosure: list[str] = SELF_DISCLOSURE) -> DataFrame:
    """scenario_id, rule, severity, subject of each finding.

    S001 no steps; S002 a required step that neither follows a required step nor is a branch's target; B001 a branch to nowhere; T001
    an unknown tool in the must-call list; T002 an action that is neither tool nor speech; I001 identity to be confirmed without a name or
    role to confirm; O001 an outcome whose tool isn't called; O002 no call of the log; R001 an opening that gives the agent away; R002 nothing
    forbidden. `scenarios` (scenario_id, outcome, opening, customer_name, role); the others have scenario_id. Findings come from
    anti-joins by scenario, so the work grows with the policies; these are sorted to meet, never sent whole through the driver.
    """
    merged = lambda df, *columns: df.select("scenario_id", *columns).hint("merge")
    at = Window.partitionBy("scenario_id").orderBy("ord")
    ids = scenarios.select("scenario_id").distinct()
    known = tools.select("tool_name").distinct()
    follow = steps.withColumns({"r": F.row_number().over(at), "nxt": F.lead("step_id").over(at)})
    firm = follow.where("not is_optional")
    reached = follow.where("r = 1").select("scenario_id", "step_id").unionByName(firm.where("nxt is not null").select("scenario_id", F.col("nxt").alias("step_id")))
    reached = reached.unionByName(branches.join(merged(firm, "step_id"), ["scenario_id", "step_id"], "left_semi").select("scenario_id", F.col("next_step").alias("step_id")))
    acts = steps.where(~reduce(Column.__or__, (F.col("action").startswith(s) for s in speech), F.lit(False)))
    asks = steps.where(F.col("step_id").contains("confirm_identity") | F.col("action").isin(identity)).select("scenario_id").distinct()
    outcome = F.create_map(*(F.lit(x) for kv in outcome_tools.items() for x in kv))
    needed = scenarios.select("scenario_id", "outcome", F.try_element_at(outcome, F.col("outcome")).alias("tool_name")).where("tool_name is not null")
    called = must_call.select("scenario_id", "tool_name").distinct()

    def found(rule: str, severity: str, df: DataFrame, subject: str | None = None) -> DataFrame:
        return df.select("scenario_id", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), (F.col(subject) if subject else F.lit(None)).cast("string").alias("subject")).distinct()

    parts = [
        found("S001", "error", ids.join(merged(steps), "scenario_id", "left_anti")),
        found("S002", "warning", firm.join(merged(reached, "step_id"), ["scenario_id", "step_id"], "left_anti"), "step_id"),
        found("B001", "error", branches.where("next_step <> ''").join(merged(steps, F.col("step_id").alias("next_step")), ["scenario_id", "next_step"], "left_anti"), "next_step"),
        found("T001", "error", called.join(known, "tool_name", "left_anti"), "tool_name"),
        found("T002", "info", acts.join(known.withColumnRenamed("tool_name", "action"), "action", "left_anti"), "action"),
        found("I001", "warning", scenarios.where("coalesce(customer_name, '') = '' and coalesce(role, '') = ''").join(merged(asks), "scenario_id", "left_semi")),
        found("O001", "warning", needed.join(merged(called, "tool_name"), ["scenario_id", "tool_name"], "left_anti"), "outcome"),
        found("O002", "info", called.join(merged(called.where(F.col("tool_name") == log_tool)), "scenario_id", "left_anti")),
        found("R001", "info", scenarios.where(reduce(Column.__or__, (F.col("opening").contains(w) for w in disclosure), F.lit(False)))),
        found("R002", "info", ids.join(merged(forbidden), "scenario_id", "left_anti")),
    ]
    return reduce(DataFrame.unionByName, parts)


def validate_policies(steps: DataFrame, branches: DataFrame) -> DataFrame:
    """rule, subject: repeated step ids and orders, steps that branch to themselves, weights that aren't positive."""
    twice = lambda c: steps.groupBy("scenario_id", c).count().where("count > 1").withColumn("subject", F.col(c).cast("string"))
    return findings(
        ("repeated_step", twice("step_id")), ("repeated_order", twice("ord")), ("self_branch", branches.where("step_id = next_step").withColumn("subject", F.col("step_id"))),
        ("weight", steps.where("weight <= 0").withColumn("subject", F.col("step_id"))),
    )


def feasible_slots(needs: DataFrame, places: DataFrame, slots: DataFrame) -> DataFrame:
    """scenario_id, n_slots: slots of places within budget and head count; scenarios without any have 0. Seats are whole numbers.

    Counted, never paired: of two numbers the larger one has a bit that the other lacks, and is equal to it above that bit. So a slot stands for each of
    the bits of its seats with what is above, a need looks for each bit that it lacks, and they meet on kind, day and bit, where slots are summed in
    order of price. The work grows with needs and slots times the bits of the seats.
    """
    offers = slots.join(places, "place_id").where("seats is not null and price is not null").groupBy("kind", "day", "seats", "price").agg(F.count("*").alias("n"))
    span = offers.agg(F.min("seats").cast("long").alias("low"), F.expr("length(bin(max(cast(seats as long)) - min(cast(seats as long)) + 1)) - 1").alias("top"))
    asked = needs.select("kind", "day", "heads", "budget").where("heads is not null and budget is not null").distinct()
    bits = "explode(transform(filter(sequence(0, top), l -> getbit(x, l) = {bit}), l -> struct(l AS bit, shiftright(x, l) + {more} AS above)))"
    there = offers.join(F.broadcast(span)).withColumn("x", F.expr("seats - low + 1").cast("long")).select("kind", "day", F.expr(bits.format(bit=1, more=0)).alias("b"), F.col("price").alias("at"), F.lit(0).alias("side"), "n")
    sought = asked.join(F.broadcast(span)).withColumn("x", F.expr("greatest(ceil(heads) - low, 0)").cast("long"))
    sought = sought.select("kind", "day", F.expr(bits.format(bit=0, more=1)).alias("b"), F.col("budget").alias("at"), F.lit(1).alias("side"), "heads", "budget")
    below = F.sum("n").over(Window.partitionBy("kind", "day", "b").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = there.unionByName(sought, allowMissingColumns=True).withColumn("below", below).where("side = 1").groupBy("kind", "day", "heads", "budget").agg(F.sum("below").alias("fit"))
    rows = needs.join(found, ["kind", "day", "heads", "budget"], "left")
    return rows.groupBy("scenario_id").agg(F.sum(F.coalesce("fit", F.lit(0))).alias("n_slots"))
