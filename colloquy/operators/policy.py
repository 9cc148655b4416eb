"""Policies as graphs in tables, derived once per scenario: nodes, edges, constraints, atoms, expected path.

A policy has some twenty steps; what grows is the number of policies, and every operator here is a join or window within
a scenario_id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Outcome -> tool that must come before it is logged.
CAUSAL_TOOLS = {"refunded": "create_compensation", "rescheduled": "reschedule_delivery", "confirmed": "query_order", "escalated": "transfer_to_human"}


def in_order():
    return Window.partitionBy("scenario_id").orderBy("ord")


def compile_nodes(steps: DataFrame, branches: DataFrame, tools: DataFrame) -> DataFrame:
    """scenario_id, step_id, ord, weight, is_optional, is_branch_target, predicate (tool, or words of the instruction)."""
    targets = branches.select("scenario_id", F.col("next_step").alias("step_id")).distinct().withColumn("t", F.lit(True))
    known = tools.select(F.col("tool_name").alias("action")).distinct().withColumn("is_tool", F.lit(True))
    rows = steps.join(targets, ["scenario_id", "step_id"], "left").join(known, "action", "left")
    return rows.select("scenario_id", "step_id", "ord", "weight", "is_optional", F.coalesce("t", F.lit(False)).alias("is_branch_target"),
                       F.when(F.col("is_tool"), "tool").otherwise("words").alias("predicate"))


def compile_edges(steps: DataFrame, branches: DataFrame) -> DataFrame:
    """scenario_id, src, dst, kind, cond.

    A step with branches has a branch edge to each target, and a sequential one to the next step unless that is a target;
    from other steps an edge to an optional target is a skip, any other is sequential.
    """
    targets = branches.select("scenario_id", F.col("next_step").alias("nxt")).distinct().withColumn("nxt_target", F.lit(True))
    sources = branches.select("scenario_id", "step_id").distinct().withColumn("has_branches", F.lit(True))
    follow = steps.withColumns({"nxt": F.lead("step_id").over(in_order()), "nxt_optional": F.lead("is_optional").over(in_order())}).where("nxt is not null")
    rows = follow.join(sources, ["scenario_id", "step_id"], "left").join(targets, ["scenario_id", "nxt"], "left").na.fill(False, ["has_branches", "nxt_target"])
    plain = rows.where("not (has_branches and nxt_target)").select(
        "scenario_id", F.col("step_id").alias("src"), F.col("nxt").alias("dst"),
        F.when(~F.col("has_branches") & F.col("nxt_target") & F.col("nxt_optional"), "skip").otherwise("sequential").alias("kind"), F.lit(None).cast("string").alias("cond"),
    )
    return plain.unionByName(branches.select("scenario_id", F.col("step_id").alias("src"), F.col("next_step").alias("dst"), F.lit("branch").alias("kind"), "cond"))


def pre_post_conditions(edges: DataFrame) -> DataFrame:
    """scenario_id, step_id, pre, post: neighbours by sequential and branch edges, sorted and joined by commas."""
    use = edges.where("kind in ('sequential', 'branch')")
    both = use.select("scenario_id", F.col("dst").alias("step_id"), F.col("src").alias("pre"), F.lit(None).cast("string").alias("post")).unionByName(
        use.select("scenario_id", F.col("src").alias("step_id"), F.lit(None).cast("string").alias("pre"), F.col("dst").alias("post")))
    return both.groupBy("scenario_id", "step_id").agg(*(F.array_join(F.sort_array(F.collect_set(c)), ",").alias(c) for c in ("pre", "post")))


def expected_path(expected: DataFrame, taken: DataFrame) -> DataFrame:
    """scenario_id, path: expected steps with the target of each expected branch put in after its step, or at the end.

    `taken` (scenario_id, ord, step_id, next_step). The path changes between insertions, so they are folded in order.
    """
    base = expected.groupBy("scenario_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "step_id"))), lambda s: s["step_id"]).alias("path"))
    more = taken.groupBy("scenario_id").agg(F.array_sort(F.collect_list(F.struct("ord", "step_id", "next_step"))).alias("b"))

    def put(path, b):
        at = F.array_position(path, b["step_id"])
        n = F.when(at == 0, F.size(path)).otherwise(at).cast("int")
        return F.when(F.array_contains(path, b["next_step"]), path).otherwise(F.concat(F.slice(path, 1, n), F.array(b["next_step"]), F.slice(path, n + 1, F.size(path))))

    rows = base.join(more, "scenario_id", "left")
    return rows.select("scenario_id", F.when(F.col("b").isNull(), F.col("path")).otherwise(F.aggregate("b", F.col("path"), put)).alias("path"))


def temporal_constraints(steps: DataFrame, must_call: DataFrame, outcomes: DataFrame, causal: DataFrame) -> DataFrame:
    """scenario_id, kind, src, dst, penalty: neighbouring required steps (0.8), consecutive required tools (1.0), the causal tool of the
    expected outcome before the log (2.0)."""
    need = steps.where("not is_optional").withColumn("dst", F.lead("step_id").over(in_order())).where("dst is not null")
    tools = must_call.withColumn("dst", F.lead("tool_name").over(Window.partitionBy("scenario_id").orderBy("pos"))).where("dst is not null")
    row = lambda df, kind, src, penalty: df.select("scenario_id", F.lit(kind).alias("kind"), F.col(src).alias("src"), "dst", F.lit(penalty).alias("penalty"))
    cause = outcomes.join(causal, "outcome")
    return row(need, "before", "step_id", 0.8).unionByName(row(tools, "before_tool", "tool_name", 1.0)).unionByName(row(cause, "requires", "tool_name", 2.0))


def scoring_atoms(nodes: DataFrame, branches: DataFrame, must_call: DataFrame, constraints: DataFrame) -> DataFrame:
    """scenario_id, kind, atom, weight: steps 1 (optional 0.5), branches 1.5, tools 1, constraints half their penalty."""
    row = lambda df, kind, atom, w: df.select("scenario_id", F.lit(kind).alias("kind"), atom.alias("atom"), w.alias("weight"))
    return (
        row(nodes, "step", F.col("step_id"), F.when(F.col("is_optional"), 0.5).otherwise(1.0))
        .unionByName(row(branches, "branch", F.concat_ws(">", "step_id", "next_step"), F.lit(1.5)))
        .unionByName(row(must_call, "tool", F.col("tool_name"), F.lit(1.0)))
        .unionByName(row(constraints, "temporal", F.concat_ws(">", "src", "dst"), F.col("penalty") * 0.5))
    )


def _graphs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """scenario_id, steps: a row per policy, its steps (i from 1, step_id, ord, degree, after) by `ord` and step_id. `degree`: how many edges lead to a step,
    also from unknown ones; `after`: where its edges lead. Repeated edges count once, edges to unknown steps don't count; of repeated nodes the first counts."""
    own = nodes.where("step_id is not null").groupBy("scenario_id", "step_id").agg(F.min("ord").alias("ord"))
    steps = own.withColumn("i", F.row_number().over(Window.partitionBy("scenario_id").orderBy("ord", "step_id")))
    known = steps.select("scenario_id", "step_id", "i")
    links = edges.select("scenario_id", F.col("src").alias("from"), F.col("dst").alias("step_id")).distinct().join(known.withColumnRenamed("i", "to"), ["scenario_id", "step_id"])
    links = links.join(known.select("scenario_id", F.col("step_id").alias("from"), "i"), ["scenario_id", "from"], "left")
    # a row for each step and for both ends of each link; one exchange by policy serves both groupings
    ends = links.select("scenario_id", F.expr("inline(array(struct(to as i, 1 as into, cast(null as int) as next), struct(i, 0 as into, to as next)))")).where("i is not null")
    rows = steps.withColumn("into", F.lit(0)).unionByName(ends, allowMissingColumns=True).repartition("scenario_id")
    each = rows.groupBy("scenario_id", "i").agg(F.max("step_id").alias("step_id"), F.max("ord").alias("ord"), F.sum("into").cast("int").alias("degree"), F.collect_list("next").alias("after"))
    return each.groupBy("scenario_id").agg(F.sort_array(F.collect_list(F.struct("i", "step_id", "ord", "degree", "after"))).alias("steps"))


def places(degrees: list[int], after: list[list[int]]) -> tuple[list[int | None], list[int | None]]:
    """Depth and place of each step of a policy by Kahn's algorithm: of the steps that wait for none, the first is next; none for those that always wait."""
    waiting, depth, pos = list(degrees), [0] * len(degrees), [None] * len(degrees)
    ready = [j for j, n in enumerate(waiting) if not n]  # sorted, so a heap
    placed = 0
    while ready:
        j = heapq.heappop(ready)
        placed += 1
        pos[j] = placed
        for i in after[j]:
            depth[i - 1] = max(depth[i - 1], depth[j] + 1)
            waiting[i - 1] -= 1
            if not waiting[i - 1]:
                heapq.heappush(ready, i - 1)
    return [d if p else None for d, p in zip(depth, pos)], pos


def topological_order(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """scenario_id, step_id, depth (longest way from a step without predecessors), pos: Kahn's order; of the steps that are ready, the first in
    step order (`ord`, then step_id) comes next. A policy is one row, so one of any length is ordered, in a time that grows with its steps and edges.

    Steps on a cycle, or behind one or behind a step that isn't in `nodes`, are never ready: their depth and pos are null.
    """
    kinds = {c: nodes.schema[c].dataType.simpleString() for c in ("scenario_id", "step_id")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            policies, steps, degrees, after = part.columns
            sizes = steps.value_lengths().to_numpy()
            waits, lists = degrees.flatten().to_numpy().tolist(), after.flatten()
            to, ends = lists.flatten().to_numpy().tolist(), np.cumsum(lists.value_lengths().to_numpy()).tolist()
            own = [to[a:b] for a, b in zip([0, *ends], ends)]
            depth, pos, at = [], [], 0
            for n in sizes.tolist():
                for column, values in zip((depth, pos), places(waits[at : at + n], own[at : at + n])):
                    column += values
                at += n
            yield pa.RecordBatch.from_arrays(
                [policies.take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), steps.flatten(), pa.array(depth, pa.int32()), pa.array(pos, pa.int32())],
                ["scenario_id", "step_id", "depth", "pos"])

    rows = _graphs(edges, nodes).select("scenario_id", "steps.step_id", "steps.degree", "steps.after")
    return rows.mapInArrow(run, f"scenario_id {kinds['scenario_id']}, step_id {kinds['step_id']}, depth int, pos int")


def reachable_from(edges: DataFrame, start: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """scenario_id, step_id that can be reached from `start` (scenario_id, step_id), which is part of them; over as many edges as there are, cycles included.

    With `taken` (scenario_id, step_id, cond), branch edges count only where their condition was taken at their step. A policy is one row; what is new is
    followed until nothing is.
    """
    way = edges.where("kind <> 'branch'") if taken is not None else edges
    ways = way.select("scenario_id", "src", "dst")
    if taken is not None:
        own = taken.select("scenario_id", F.col("step_id").alias("src"), "cond").distinct()
        ways = ways.unionByName(edges.where("kind = 'branch'").join(own, ["scenario_id", "src", "cond"]).select("scenario_id", "src", "dst"))
    at = start.where("step_id is not null").select("scenario_id", "step_id", F.lit(0).alias("ord"))
    ends = [ways.select("scenario_id", F.col(c).alias("step_id"), F.lit(1).alias("ord")) for c in ("src", "dst")]
    graphs = _graphs(ways, at.unionByName(ends[0]).unionByName(ends[1]))
    first = "transform(filter(steps, s -> s.ord = 0), s -> s.i)"
    more = "array_except(flatten(transform(s.new, i -> steps[i - 1].after)), s.seen)"
    step = f"if(size(s.new) = 0, s, named_struct('seen', array_union(s.seen, {more}), 'new', {more}))"
    found = graphs.where("exists(steps, s -> s.ord = 0)").select("scenario_id", "steps", F.expr(f"aggregate(steps, named_struct('seen', {first}, 'new', {first}), (s, x) -> {step}).seen").alias("seen"))
    return found.select("scenario_id", F.expr("explode(transform(seen, i -> steps[i - 1].step_id))").alias("step_id"))


def enumerate_branches(edges: DataFrame, steps: DataFrame) -> DataFrame:
    """scenario_id, src, cond, dst and the orders of both steps, for branch edges."""
    at = lambda c, n: steps.select("scenario_id", F.col("step_id").alias(c), F.col("ord").alias(n))
    return edges.where("kind = 'branch'").join(at("src", "src_ord"), ["scenario_id", "src"]).join(at("dst", "dst_ord"), ["scenario_id", "dst"]).select("scenario_id", "src", "cond", "dst", "src_ord", "dst_ord")
