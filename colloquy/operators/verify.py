"""Verification of traces against policies: one timeline of events, matched predicates, aligned paths, verdicts.

Each trace is checked against its own policy: ledgers, messages and traces have a scenario_id, policies have one per row, and they
meet by it. What is joined grows with traces times the steps of one policy.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from colloquy.operators.matching import all_places, first_words

#: Costs of the alignment.
DELETE, DELETE_OPTIONAL, INSERT, SUBSTITUTE, SUBSTITUTE_LEGAL = 3.0, 0.5, 0.2, 2.0, 1.0
GENESIS = "0" * 64
OVERALL = {"step": 0.40, "align": 0.25, "temporal": 0.15, "branch": 0.20}


def normalize_events(messages: DataFrame, ledger: DataFrame) -> DataFrame:
    """trace_id, pos, turn, kind, name: messages and ledger events on one timeline; in a turn, messages come first.

    Rolled back and fabricated calls are blocked, others with an error failed.
    """
    back = ledger.where("event_type = 'tool_rollback'").select("trace_id", "call_id").distinct().withColumn("back", F.lit(True))
    tools = ledger.where("event_type <> 'tool_rollback'").join(back, ["trace_id", "call_id"], "left").select(
        "trace_id", "turn", F.lit(1).alias("side"), F.col("seq").alias("n"),
        F.when(F.col("back") | (F.col("event_type") == "tool_fabricated"), "blocked").when(F.col("error").isNotNull(), "failed").otherwise("tool").alias("kind"), F.col("tool_name").alias("name"))
    said = messages.select("trace_id", "turn", F.lit(0).alias("side"), F.col("msg_idx").alias("n"), F.concat(F.lit("say_"), "role").alias("kind"), F.lit(None).cast("string").alias("name"))
    pos = F.row_number().over(Window.partitionBy("trace_id").orderBy("turn", "side", "n"))
    return said.unionByName(tools).select("trace_id", pos.alias("pos"), "turn", "kind", "name")


def values_equivalent(expected: Column, actual: Column) -> Column:
    """Equal as texts, as numbers, or as booleans in any case; false for a null on either side."""
    number = lambda c: c.try_cast("double")
    flags = F.lower(expected).isin("true", "false") & (F.lower(expected) == F.lower(actual))
    return F.coalesce(expected == actual, F.lit(False)) | F.coalesce(number(expected) == number(actual), F.lit(False)) | F.coalesce(flags, F.lit(False))


def variant_arguments(c: Column) -> Column:
    """Arguments of a call, a VARIANT object, as a map from name to text."""
    return c.cast("map<string,string>")


def arguments_match(expected: Column, actual: Column) -> Column:
    """Does the map of arguments hold an equivalent of each expected one? Further arguments don't matter."""
    return F.forall(F.map_keys(expected), lambda k: values_equivalent(F.try_element_at(expected, k), F.try_element_at(actual, k)))


def tool_call_match(calls: DataFrame, expected: DataFrame) -> DataFrame:
    """trace_id, seq, matched, confidence of calls (with arguments, a map) of expected tools (tool_name, args).

    Confidence is the share of expected arguments with an equivalent value, 1 without any.
    """
    met = calls.join(expected.select("tool_name", F.col("args").alias("want")), "tool_name")
    n = F.size("want")
    right = F.size(F.filter(F.map_keys("want"), lambda k: values_equivalent(F.try_element_at("want", k), F.try_element_at("arguments", k))))
    return met.select("trace_id", "seq", (right == n).alias("matched"), F.when(n == 0, 1.0).otherwise(right / n).alias("confidence"))


def match_tools(ledger: DataFrame, predicates: DataFrame) -> DataFrame:
    """trace_id, scenario_id, step_id, ord, pred, kind, key, event (seq), turn of the first event that satisfies each tool predicate.

    `ledger` has scenario_id, arguments (a map), source, order_id and own_order; `predicates` (scenario_id, step_id, ord, pred, kind, tool_name,
    args). An event counts if it was executed without an error, not by the guard, holds the arguments and isn't of another order.
    """
    ok = ledger.where("event_type = 'tool_executed' and coalesce(error, '') = '' and source <> 'guard' and (own_order is null or coalesce(order_id, '') in ('', own_order))")
    met = ok.join(predicates.where("kind = 'tool'").select("scenario_id", "step_id", "ord", "pred", "tool_name", "args"), ["scenario_id", "tool_name"]).where(arguments_match(F.col("args"), F.col("arguments")))
    first = met.groupBy("trace_id", "scenario_id", "step_id", "ord", "pred").agg(F.min("seq").alias("event"), F.min_by("turn", "seq").alias("turn"))
    return first.select("trace_id", "scenario_id", "step_id", "ord", "pred", F.lit("tool").alias("kind"), F.lit(None).cast("string").alias("key"), "event", "turn")


def match_words(messages: DataFrame, predicates: DataFrame, negation: Column, ratio: float = 0.4, instruction_ratio: float = 0.3) -> DataFrame:
    """`match_tools` for predicates with words: event is msg_idx, key the words.

    An agent message satisfies a predicate with at least that share of its words (one at least) if `negation`, a condition on content, isn't
    'negated'. Steps without predicates of their own have one of kind `instruction`, with the words of the instruction: a smaller
    share is enough, negated or not.
    """
    said = messages.where("role = 'agent'").select("trace_id", "scenario_id", "msg_idx", "turn", F.lower("content").alias("low"), (negation == "negated").alias("negated"))
    met = said.join(predicates.where("kind in ('words', 'instruction')").select("scenario_id", "step_id", "ord", "pred", "kind", "words"), "scenario_id")
    share = F.when(F.col("kind") == "words", ratio).otherwise(instruction_ratio)
    hits = F.size(F.filter("words", lambda w: F.col("low").contains(w)))
    met = met.where((hits >= F.greatest(F.lit(1.0), share * F.size("words"))) & ((F.col("kind") == "instruction") | ~F.col("negated")))
    first = met.groupBy("trace_id", "scenario_id", "step_id", "ord", "pred", "kind", F.array_join("words", ",").alias("key")).agg(F.min("msg_idx").alias("event"), F.min_by("turn", "msg_idx").alias("turn"))
    return first.select("trace_id", "scenario_id", "step_id", "ord", "pred", "kind", "key", "event", "turn")


def observed_steps(matches: DataFrame, predicates: DataFrame) -> DataFrame:
    """trace_id, scenario_id, step_id, first_turn, last_turn, evidence, confidence of the steps that a trace shows.

    `matches` are those of tools and words. Steps take their events in order: a tool event counts for one step only, a message for one step per
    set of words. A step whose tool was called stands; one of several utterances needs half of them. Confidence is evidence per
    predicate, 1 at most.
    """
    taken = Window.partitionBy("trace_id", F.col("kind") == "tool", "event", "key").orderBy("ord", "step_id", "pred")
    own = matches.withColumn("r", F.row_number().over(taken)).where("r = 1")
    seen = own.groupBy("trace_id", "scenario_id", "step_id").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("evidence"), F.bool_or(F.col("kind") == "tool").alias("tool"),
                                                                   F.count_if(F.col("kind") == "words").alias("said"))
    need = predicates.groupBy("scenario_id", "step_id").agg(F.count_if(F.col("kind") != "instruction").alias("n"), F.count_if(F.col("kind") == "words").alias("words"))
    rows = seen.join(need, ["scenario_id", "step_id"]).where("tool or words < 2 or 2 * said >= words")
    return rows.select("trace_id", "scenario_id", "step_id", "first_turn", "last_turn", "evidence", F.least(F.lit(1.0), F.col("evidence") / F.greatest("n", F.lit(1))).alias("confidence"))


def paths(observed: DataFrame, steps: DataFrame, edges: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """trace_id, expected, observed, optional, legal: what the alignments compare, as arrays.

    Observed steps are in order of their first turn, then of the policy; expected ones are the required steps of the trace's
    policy, or those of `expected` (scenario_id, pos, step_id); legal successors are written src>dst.
    """
    in_order = lambda *c: F.transform(F.array_sort(F.collect_list(F.struct(*c, "step_id"))), lambda s: s["step_id"])
    seen = observed.join(steps.select("scenario_id", "step_id", "ord"), ["scenario_id", "step_id"]).groupBy("trace_id", "scenario_id").agg(in_order("first_turn", "ord").alias("observed"))
    plan = (steps.where("not is_optional").withColumnRenamed("ord", "pos") if expected is None else expected).groupBy("scenario_id").agg(in_order("pos").alias("expected"))
    free = steps.groupBy("scenario_id").agg(F.sort_array(F.collect_list(F.when(F.col("is_optional"), F.col("step_id")))).alias("optional"))
    legal = edges.groupBy("scenario_id").agg(F.sort_array(F.collect_list(F.concat_ws(">", "src", "dst"))).alias("legal"))
    none = F.array().cast("array<string>")
    rows = seen.join(plan, "scenario_id", "left").join(free, "scenario_id", "left").join(legal, "scenario_id", "left")
    return rows.select("trace_id", *(F.coalesce(c, none).alias(c) for c in ("expected", "observed", "optional", "legal")))


def align(expected: list[str], observed: list[str], optional: set[str] = frozenset(), edges: set[tuple[str, str]] = frozenset()) -> tuple[float, list[str]]:
    """Cost and operations of the cheapest alignment; of equal costs substitution comes first, then deletion, then insertion.

    A substitution is cheaper where the observed step is a legal successor of the one observed before it.
    """
    n, m = len(expected), len(observed)
    cost, back = [[0.0] * (m + 1) for _ in range(n + 1)], [[""] * (m + 1) for _ in range(n + 1)]
    gone = [DELETE_OPTIONAL if e in optional else DELETE for e in expected]
    for i in range(n + 1):
        for j in range(m + 1):
            ways = []
            if i and j:
                same = expected[i - 1] == observed[j - 1]
                legal = j > 1 and (observed[j - 2], observed[j - 1]) in edges
                ways.append((cost[i - 1][j - 1] + (0.0 if same else SUBSTITUTE_LEGAL if legal else SUBSTITUTE), 0, "match" if same else "substitute"))
            if i:
                ways.append((cost[i - 1][j] + gone[i - 1], 1, "delete"))
            if j:
                ways.append((cost[i][j - 1] + INSERT, 2, "insert"))
            if ways:
                cost[i][j], _, back[i][j] = min(ways)
    ops, i, j = [], n, m
    while i or j:
        op = back[i][j]
        ops.append(f"{op}:{observed[j - 1] if op == 'insert' else expected[i - 1]}")
        i, j = i - (op != "insert"), j - (op != "delete")
    return cost[n][m], ops[::-1]


def align_ordered(paths: DataFrame) -> DataFrame:
    """trace_id, cost, ops of each trace's observed against its expected path (`paths`)."""
    kind = StructType([StructField("cost", DoubleType()), StructField("ops", ArrayType(StringType()))])

    @F.pandas_udf(kind)
    def run(expected: pd.Series, observed: pd.Series, optional: pd.Series, legal: pd.Series) -> pd.DataFrame:
        made = [align(list(e), list(o), set(p), {tuple(x.split(">")) for x in g}) for e, o, p, g in zip(expected, observed, optional, legal)]
        return pd.DataFrame(made, columns=["cost", "ops"])

    return paths.select("trace_id", run("expected", "observed", "optional", "legal").alias("a")).select("trace_id", "a.*")


def deletion(step: Column, optional: Column | str = "optional") -> Column:
    return F.when(F.array_contains(optional, step), DELETE_OPTIONAL).otherwise(DELETE)


def summed(costs: Column) -> Column:
    return F.aggregate(costs, F.lit(0.0), lambda a, x: a + x)


def align_strict(paths: DataFrame) -> DataFrame:
    """trace_id, cost: position by position; missing positions are deletions, further ones insertions."""
    both = F.zip_with("expected", "observed", lambda x, y: F.when(x.isNull(), INSERT).when(y.isNull(), deletion(x)).when(x == y, 0.0).otherwise(SUBSTITUTE))
    return paths.select("trace_id", summed(both).alias("cost"))


def align_unordered(paths: DataFrame) -> DataFrame:
    """trace_id, cost: as sets."""
    missing = F.transform(F.filter("expected", lambda x: ~F.array_contains("observed", x)), lambda x: deletion(x))
    return paths.select("trace_id", (summed(missing) + F.size(F.array_except("observed", "expected")) * INSERT).alias("cost"))


def alignment_score(cost: Column, expected: Column, optional: Column) -> Column:
    """1 less cost over the cost of deleting everything; 1 where nothing is expected."""
    return F.when(F.size(expected) == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - cost / summed(F.transform(expected, lambda x: deletion(x, optional)))))


def first_turns(observed: DataFrame, ledger: DataFrame) -> DataFrame:
    """trace_id, scenario_id, turns: a map from steps, and tools that no step is called like, to their first turns."""
    tools = ledger.where("event_type = 'tool_executed' and coalesce(error, '') = '' and source <> 'guard'").groupBy("trace_id", "scenario_id", F.col("tool_name").alias("name")).agg(F.min("turn").alias("turn"))
    both = observed.select("trace_id", "scenario_id", F.col("step_id").alias("name"), F.col("first_turn").alias("turn"), F.lit(0).alias("side")).unionByName(tools.withColumn("side", F.lit(1)))
    one = both.groupBy("trace_id", "scenario_id", "name").agg(F.min_by("turn", "side").alias("turn"))
    return one.groupBy("trace_id", "scenario_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "turn"))).alias("turns"))


def temporal_violations(turns: DataFrame, constraints: DataFrame) -> DataFrame:
    """trace_id, src, dst, kind of violated constraints of the trace's policy: src later than dst; for `requires`, also dst without src.

    `turns` (trace_id, scenario_id, turns) is what `first_turns` makes; `constraints` (scenario_id, src, dst, kind).
    """
    s, d = F.try_element_at("turns", F.col("src")), F.try_element_at("turns", F.col("dst"))
    late = F.coalesce(s > d, F.lit(False))
    bad = late | ((F.col("kind") == "requires") & d.isNotNull() & s.isNull())
    return turns.join(constraints.select("scenario_id", "src", "dst", "kind"), "scenario_id").where(bad).select("trace_id", "src", "dst", "kind")


def temporal_score(violations: DataFrame, traces: DataFrame, constraints: DataFrame) -> DataFrame:
    """trace_id, temporal: 1 less the violated share of the policy's constraints; 1 without any."""
    n, total = violations.groupBy("trace_id").agg(F.count("*").alias("n")), constraints.groupBy("scenario_id").agg(F.count("*").alias("total"))
    rows = traces.select("trace_id", "scenario_id").distinct().join(n, "trace_id", "left").join(total, "scenario_id", "left")
    return rows.select("trace_id", F.when(F.col("total").isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.coalesce("n", F.lit(0)) / F.col("total"))).alias("temporal"))


def verify_branches(observed: DataFrame, branches: DataFrame, expected: DataFrame) -> DataFrame:
    """trace_id, step_id, verdict: correct if exactly the expected target was observed, ambiguous for several, wrong, or missing.

    `expected` (scenario_id, step_id, cond); `branches` (scenario_id, step_id, next_step, cond).
    """
    taken = observed.select("trace_id", "scenario_id", F.col("step_id").alias("next_step")).join(branches.select("scenario_id", "step_id", "next_step", "cond"), ["scenario_id", "next_step"])
    g = taken.groupBy("trace_id", "step_id").agg(F.count_distinct("next_step").alias("n"), F.max("cond").alias("cond"))
    want = observed.select("trace_id", "scenario_id").distinct().join(expected.select("scenario_id", "step_id", F.col("cond").alias("want")), "scenario_id")
    rows = want.join(g, ["trace_id", "step_id"], "left")
    return rows.select("trace_id", "step_id", F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").when(F.col("cond") == F.col("want"), "correct").otherwise("wrong").alias("verdict"))


def branch_score(verdicts: DataFrame, traces: DataFrame, branches: DataFrame) -> DataFrame:
    """trace_id, branch: correct share of the expected branches; null where a policy has branches of which none is expected, 1 without branches."""
    g = verdicts.groupBy("trace_id").agg(F.avg((F.col("verdict") == "correct").cast("double")).alias("share"))
    forks = branches.select("scenario_id").distinct().withColumn("forks", F.lit(True))
    rows = traces.select("trace_id", "scenario_id").distinct().join(g, "trace_id", "left").join(forks, "scenario_id", "left")
    return rows.select("trace_id", F.when(F.col("share").isNotNull(), F.col("share")).when(F.col("forks").isNull(), 1.0).alias("branch"))


def atom_verdicts(atoms: DataFrame, traces: DataFrame, facts: DataFrame) -> DataFrame:
    """trace_id, kind, atom, verdict, delta of the atoms (scenario_id, kind, atom, weight) of each trace's policy: satisfied ones give
    their weight, others take it away; optional ones that weren't seen don't apply. `facts` (trace_id, kind, atom, ok)."""
    rows = traces.select("trace_id", "scenario_id").distinct().join(atoms, "scenario_id").join(facts, ["trace_id", "kind", "atom"], "left")
    ok = F.coalesce("ok", F.lit(False))
    verdict = F.when(ok, "satisfied").when((F.col("kind") == "step") & (F.col("weight") < 1), "not_applicable").otherwise("unsatisfied")
    delta = F.when(verdict == "satisfied", F.col("weight")).when(verdict == "unsatisfied", -F.col("weight")).otherwise(0.0)
    return rows.select("trace_id", "kind", "atom", verdict.alias("verdict"), delta.alias("delta"))


def step_compliance(verdicts: DataFrame) -> DataFrame:
    """trace_id, compliance: satisfied share of the step atoms that apply; 1 without any."""
    on = (F.col("kind") == "step") & (F.col("verdict") != "not_applicable")
    return verdicts.groupBy("trace_id").agg(F.coalesce(F.avg(F.when(on, (F.col("verdict") == "satisfied").cast("double"))), F.lit(1.0)).alias("compliance"))


def illegal_transitions(observed: DataFrame, edges: DataFrame, steps: DataFrame) -> DataFrame:
    """trace_id, src, dst: consecutive observed steps that go back in the policy's order along none of its edges."""
    at = steps.select("scenario_id", "step_id", "ord")
    seen = observed.join(at, ["scenario_id", "step_id"])
    w = Window.partitionBy("trace_id").orderBy("first_turn", "ord")
    follow = seen.select("trace_id", "scenario_id", F.col("step_id").alias("src"), F.lead("step_id").over(w).alias("dst"), "ord", F.lead("ord").over(w).alias("next"))
    return follow.where("next < ord").join(edges.select("scenario_id", "src", "dst"), ["scenario_id", "src", "dst"], "left_anti").select("trace_id", "src", "dst")


def overall_verification(step: Column, align_: Column, temporal: Column, branch: Column, weights: dict[str, float] = OVERALL) -> Column:
    """Weighted mean of the parts that aren't null."""
    parts = {"step": step, "align": align_, "temporal": temporal, "branch": branch}
    total = sum((F.coalesce(c * weights[k], F.lit(0.0)) for k, c in parts.items()), F.lit(0.0))
    return total / sum((F.when(c.isNotNull(), weights[k]).otherwise(0.0) for k, c in parts.items()), F.lit(0.0))


def rule_step_entries(steps: DataFrame, matches: DataFrame, traces: DataFrame) -> DataFrame:
    """trace_id, step_id, by, turn of each step of the trace's policy: the tool's first call, else the first utterance, else none.

    `matches` are those of tools and words, events that several steps use included.
    """
    first = lambda kind, n: matches.where(kind).groupBy("trace_id", "step_id").agg(F.min("turn").alias(n))
    rows = traces.select("trace_id", "scenario_id").distinct().join(steps.select("scenario_id", "step_id"), "scenario_id")
    rows = rows.join(first("kind = 'tool'", "t"), ["trace_id", "step_id"], "left").join(first("kind <> 'tool'", "u"), ["trace_id", "step_id"], "left")
    return rows.select("trace_id", "step_id", F.when(F.col("t").isNotNull(), "tool").when(F.col("u").isNotNull(), "words").otherwise("none").alias("by"), F.coalesce("t", "u").alias("turn"))


def event_hash(*columns: str) -> Column:
    """SHA-256 of an event as key-sorted JSON, the previous hash included."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def verify_hash_chain(ledger: DataFrame) -> DataFrame:
    """trace_id, first_bad (seq of the first event whose prev_hash isn't its predecessor's hash; null if sound), events, tip.

    `ledger` has prev_hash and own_hash.
    """
    w = Window.partitionBy("trace_id").orderBy("seq")
    want = F.coalesce(F.lag("own_hash").over(w), F.lit(GENESIS))
    rows = ledger.withColumn("bad", F.when(~F.col("prev_hash").eqNullSafe(want), F.col("seq")))
    return rows.groupBy("trace_id").agg(F.min("bad").alias("first_bad"), F.count("*").alias("events"), F.max_by("own_hash", "seq").alias("tip"))


def reconstruct_ledger(calls: DataFrame) -> DataFrame:
    """trace_id, seq, event_type of logged calls: fabricated and blocked by their error marks; the guard's own calls fall away."""
    kind = F.when(F.col("error").startswith("[FABRICATED]"), "tool_fabricated").when(F.col("error").startswith("[BLOCKED]"), "tool_blocked").otherwise("tool_executed")
    seq = F.row_number().over(Window.partitionBy("trace_id").orderBy("turn", "call_idx"))
    return calls.where("source <> 'guard'").select("trace_id", seq.cast("long").alias("seq"), kind.alias("event_type"), "tool_name")


def canonical_intent(mentions: DataFrame, requirements: DataFrame, traces: DataFrame) -> DataFrame:
    """trace_id, req_id, verdict, critical of the requirements (scenario_id, req_id, mutable) of each trace's policy.

    `mentions` (trace_id, req_id, turn, response_turn, pressure): agent turns that state a requirement without negation. No mention is
    missing; a response under pressure (2 or more) induced skip; any response satisfied, none satisfied_no_user_response. Immutable
    requirements that are missing or induced are critical.
    """
    g = mentions.groupBy("trace_id", "req_id").agg(F.min_by(F.struct("response_turn", "pressure"), "turn").alias("m"))
    rows = traces.select("trace_id", "scenario_id").distinct().join(requirements, "scenario_id").join(g, ["trace_id", "req_id"], "left")
    verdict = F.when(F.col("m").isNull(), "missing").when(F.col("m.response_turn").isNull(), "satisfied_no_user_response").when(F.col("m.pressure") >= 2, "induced_skip").otherwise("satisfied")
    return rows.select("trace_id", "req_id", verdict.alias("verdict"), (~F.col("mutable") & verdict.isin("missing", "induced_skip")).alias("critical"))


def context_retention(messages: DataFrame, facts: DataFrame) -> DataFrame:
    """trace_id, score, passed (0.6 or more): the share of the facts of the trace's policy that some agent message from their check turn on still holds.

    `messages` (trace_id, scenario_id, turn, role, content); `facts` (scenario_id, fact_id, check_turn, words): a word is enough, whatever its case. A policy
    without facts gives 1, facts without words are never held.
    """
    lists = facts.select("scenario_id", F.struct("fact_id", "check_turn").alias("list_id"), F.transform("words", F.lower).alias("words"))
    said = messages.where("role = 'agent'").withColumn("content", F.lower("content"))
    held = first_words(said, lists, ["content"], ["trace_id", "turn"]).where("turn >= list_id.check_turn").groupBy("trace_id").agg(F.countDistinct("list_id.fact_id").alias("held"))
    total = facts.groupBy("scenario_id").agg(F.countDistinct("fact_id").alias("total"))
    every = messages.select("trace_id", "scenario_id").distinct().join(total, "scenario_id", "left").join(held, "trace_id", "left")
    rows = every.select("trace_id", F.coalesce(F.coalesce("held", F.lit(0)) / F.col("total"), F.lit(1.0)).alias("score"))
    return rows.withColumn("passed", F.col("score") >= 0.6)


def knowledge_accuracy(messages: DataFrame, points: DataFrame) -> DataFrame:
    """trace_id, score (0 to 100): the points of the trace's policy of which a best message has half the words and numbers, less those that it contradicts:
    a word is there, an expected number is missing and another number appears. A policy without points gives 100.

    `messages` (trace_id, scenario_id, turn, role, content); `points` (scenario_id, point_id, words, numbers). The best message has most of them, and is the
    first of several.
    """
    lists = points.select("scenario_id", F.struct("point_id", F.size("words").alias("n_words"), F.size("numbers").alias("n_numbers")).alias("list_id"), F.concat("words", "numbers").alias("words"))
    said = messages.where("role = 'agent'").withColumn("digits", F.col("content").rlike(r"\d"))
    hits = all_places(said, lists, ["content"], ["trace_id", "turn", "digits"])
    hits = hits.select("trace_id", "list_id.*", F.struct(F.size("content").alias("n"), (-F.col("turn")).alias("t"), F.size(F.filter("content", lambda p: p < F.col("list_id.n_words"))).alias("w"), "digits").alias("hit"))
    best = hits.groupBy("trace_id", "point_id", "n_words", "n_numbers").agg(F.max("hit").alias("hit"))
    right = F.col("hit.n") >= 0.5 * (F.col("n_words") + F.col("n_numbers"))
    wrong = (F.col("n_numbers") > 0) & (F.col("hit.w") > 0) & (F.col("hit.n") - F.col("hit.w") < F.col("n_numbers")) & F.col("hit.digits")
    sums = best.groupBy("trace_id").agg(F.sum(right.cast("int") - wrong.cast("int")).alias("sum"))
    total = points.groupBy("scenario_id").agg(F.count("*").alias("total"))
    every = messages.select("trace_id", "scenario_id").distinct().join(total, "scenario_id", "left").join(sums, "trace_id", "left")
    share = F.coalesce("sum", F.lit(0)) * 100.0 / F.col("total")
    return every.select("trace_id", F.when(F.col("total").isNull(), 100.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), share))).alias("score"))


def judge_evidence(citations: DataFrame, messages: DataFrame, similar: Column) -> DataFrame:
    """trace_id, rate, factor: share of citations (trace_id, turn, quote) that point at an agent turn with a similar text; scores are
    multiplied by 1 (all good), 0.7 + 0.3 rate, or 0.5 (none)."""
    rows = citations.join(messages.where("role = 'agent'").select("trace_id", "turn", "content"), ["trace_id", "turn"], "left")
    g = rows.groupBy("trace_id").agg(F.avg(F.coalesce(similar, F.lit(False)).cast("double")).alias("rate"))
    return g.select("trace_id", "rate", F.when(F.col("rate") == 1, 1.0).when(F.col("rate") == 0, 0.5).otherwise(0.7 + 0.3 * F.col("rate")).alias("factor"))


def missing_event_ids(citations: DataFrame, ledger: DataFrame) -> DataFrame:
    """Citations of events that the ledger doesn't have."""
    return citations.join(ledger.select("trace_id", "seq").distinct(), ["trace_id", "seq"], "left_anti")
