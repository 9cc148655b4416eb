"""Samples and rankings. Draws are seeded hashes of ids, so they don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.operators.ranges import numbered
from colloquy.sources.shared import written


def draw(seed: int, *ids: str) -> Column:
    return F.xxhash64(*ids, F.lit(seed))


#: Strata of scores: name and lower bound, fixed values.
STRATA = [("severe", 0.0), ("weak", 0.4), ("borderline", 0.6), ("pass", 0.8)]


def capped(pool: DataFrame, taken: DataFrame, order: list[str], caps: dict[str, int], most: int) -> DataFrame:
    """The first `most` rows of the pool, in order, that a walk takes which leaves out rows of a value that has reached its cap; `taken` rows count from
    the start. `caps`: column -> how many rows of a value there may be.

    No task walks. In a round, a row is taken if its values stay below their caps even if all rows before it that aren't decided yet are taken, and
    left out if rows taken before it reach one. The first undecided row is always decided, and on most data a few rounds decide all. Rows that
    have the same value in all these columns are taken from the front, so no more of them than the least cap are looked at.
    """
    columns = list(caps)
    nth = F.row_number().over(Window.partitionBy(*columns).orderBy(*order))
    state = pool.withColumn("_nth", nth).where(F.col("_nth") <= min(caps.values())).drop("_nth")
    for c in columns:
        state = state.join(taken.groupBy(c).agg(F.count("*").alias(f"_{c}")), c, "left").na.fill(0, [f"_{c}"])
    state = written(state.withColumn("_in", F.lit(None).cast("boolean")), "pool")
    while state.where("_in is null").limit(1).count():
        sure, out = F.lit(True), F.lit(False)
        for c, cap in caps.items():
            w = Window.partitionBy(c).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
            before = lambda on, w=w: F.coalesce(F.sum(on.cast("int")).over(w), F.lit(0))
            known = F.col(f"_{c}") + before(F.coalesce("_in", F.lit(False)))
            sure &= known + before(F.col("_in").isNull()) < cap
            out |= known >= cap
        state = written(state.withColumn("_in", F.coalesce("_in", F.when(sure, True).when(out, False))), "pool")
    return state.where("_in").orderBy(*order).limit(most).select(pool.columns)


def stratified_sample(runs: DataFrame, n: int, seed: int, per_scenario: int = 3, per_model: int = 6) -> DataFrame:
    """trace_id, stratum, blind_id, short of n runs (trace_id, scenario, model, overall, active).

    Strata are filled in turn, the scarcest first, each with its share of n: runs with tool calls or database activity (`active`) come first,
    then by draw, with caps per scenario and model over all. What is missing is topped up from any stratum, by draw. `short` says how
    many runs the stratum lacked before that. Runs without a score are left out; an empty table gives no rows.
    """
    named = F.expr("case " + " ".join(f"when overall >= {low} then '{name}'" for name, low in reversed(STRATA)) + " end")
    rows = runs.where("overall is not null").select("trace_id", "scenario", "model", named.alias("stratum"), (~F.coalesce("active", F.lit(False))).alias("idle"), draw(seed, "trace_id").alias("d")).where("stratum is not null")
    caps, share, count, short = {"scenario": per_scenario, "model": per_model}, max(1, n // len(STRATA)), 0, {}
    taken = written(rows.limit(0), "taken")
    sizes = rows.groupBy("stratum").agg(F.count("*").alias("size")).orderBy("size", "stratum").collect()  # a row per stratum, four at most
    for stratum in [r.stratum for r in sizes]:
        got = written(capped(rows.where(F.col("stratum") == stratum), taken, ["idle", "d", "trace_id"], caps, share), "taken")
        taken = taken.unionByName(got)
        short[stratum] = share - got.count()
        count += share - short[stratum]
    if n > count:
        taken = taken.unionByName(written(capped(rows.join(taken.select("trace_id"), "trace_id", "left_anti"), taken, ["d", "trace_id"], caps, n - count), "taken"))
    number = F.concat(F.lit("B"), F.lpad(F.col("number").cast("string"), F.greatest(F.lit(3), F.length(F.col("number").cast("string"))), F.lit("0")))
    lacked = F.create_map(*(F.lit(x) for kv in short.items() for x in kv)) if short else F.create_map().cast("map<string,int>")
    return numbered(taken, "number", "d", "trace_id").select("trace_id", "stratum", number.alias("blind_id"), F.try_element_at(lacked, F.col("stratum")).cast("long").alias("short"))


def anchors_by_level(items: DataFrame, by: str, score: str) -> DataFrame:
    """Of each group the items with the lowest, middle and highest score: level low, mid, high."""
    w = Window.partitionBy(by).orderBy(score, "trace_id")
    r = items.withColumns({"r": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy(by))})
    level = F.when(F.col("r") == 1, "low").when(F.col("r") == F.col("n"), "high").when(F.col("r") == F.floor(F.col("n") / 2) + 1, "mid")
    return r.withColumn("level", level).where("level is not null").select(by, "trace_id", score, "level")


def anchors_diverse(runs: DataFrame, category: str, k: int) -> DataFrame:
    """k runs: the best, then the best of each category, then the best of the rest."""
    first = F.row_number().over(Window.partitionBy(category).orderBy(F.desc("overall"), "trace_id"))
    best = runs.withColumn("r", first).where(F.col("r") <= k)
    return best.orderBy(F.when(F.col("r") == 1, 0).otherwise(1), F.desc("overall"), "trace_id").limit(k).select("trace_id", category, "overall")


def representatives(runs: DataFrame, per_band: int) -> DataFrame:
    """trace_id, band: of each score band (high, mid, low) the runs whose scenario and model are seen least before, then by draw."""
    band = F.when(F.col("overall") >= 0.7, "high").when(F.col("overall") >= 0.4, "mid").otherwise("low")
    rows = runs.withColumn("band", band)
    seen = F.row_number().over(Window.partitionBy("band", "scenario", "model").orderBy("trace_id"))
    rows = rows.withColumn("seen", seen).where(F.col("seen") <= per_band)
    place = F.row_number().over(Window.partitionBy("band").orderBy("seen", "scenario", "model", "trace_id"))
    return rows.withColumn("place", place).where(F.col("place") <= per_band).select("trace_id", "band", "place")


def insert_traps(items: DataFrame, n: int, seed: int) -> DataFrame:
    """Items with shown_score and trap: n items, by draw, show a wrong score (3 less from 3 on, otherwise 3 more)."""
    chosen = items.select("trace_id", "item_id", "row_id").orderBy(draw(seed, "row_id"), "row_id").limit(n).withColumn("trap", F.lit(True))
    rows = items.join(chosen.select("row_id", "trap"), "row_id", "left").withColumn("trap", F.coalesce("trap", F.lit(False)))
    wrong = F.when(F.col("system_score") >= 3, F.col("system_score") - 3).otherwise(F.col("system_score") + 3)
    return rows.withColumn("shown_score", F.when(F.col("trap"), wrong).otherwise(F.col("system_score")))


def blind_ids(traces: DataFrame, seed: int) -> DataFrame:
    """trace_id, blind_id: ids in an order that says nothing about the trace.

    The order is by a seeded hash of the trace, cut into ranges of like size that are numbered apart; traces without an id are ordered like others.
    """
    rows = traces.select("trace_id", draw(seed, "trace_id").alias("d"))
    return numbered(rows, "blind_id", "d", "trace_id").select("trace_id", "blind_id")
