"""Agreement between raters, or between the system and raters, from a long table of paired scores."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.operators.ranges import before, in_ranges


def pair_labels(system: DataFrame, labels: DataFrame) -> DataFrame:
    """trace_id, item_id, system_score, label of pairs that both sides scored."""
    return system.where("system_score is not null").join(labels.where("label is not null"), ["trace_id", "item_id"])


def average_ranks(rows: DataFrame, value: str, name: str, *by: str, ranges: int | None = None) -> DataFrame:
    """Rows with the average rank of a value; rows without one are left out.

    Ranks come from counts of distinct values. These are cut into ranges of like size by a sample of them, so skewed values spread too, and each range is
    ordered by itself; only one sum per range is added up in order.
    """
    placed = in_ranges(rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c")), *by, value, ranges=ranges)
    sums = before(placed.groupBy(*by, "_part").agg(F.sum("_c").alias("_n")), "_n", *by)
    below = F.sum("_c").over(Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranks = placed.withColumn("_below", below).join(sums, [*by, "_part"]).select(*by, value, (F.col("_before") + F.col("_below") - (F.col("_c") - 1) / 2).alias(name))
    return rows.join(ranks, [*by, value])


def human_agreement(pairs: DataFrame) -> DataFrame:
    """n, spearman (correlation of average ranks; null for fewer than 3 pairs)."""
    ranked = average_ranks(average_ranks(pairs.select("system_score", "label"), "system_score", "r1"), "label", "r2")
    return ranked.agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, F.corr("r1", "r2")).alias("spearman"))


def spearman_d2(pairs: DataFrame) -> DataFrame:
    """rho by squared rank differences; under ties it differs from the correlation of ranks."""
    ranked = average_ranks(average_ranks(pairs.select("system_score", "label"), "system_score", "r1"), "label", "r2")
    n, d2 = F.count("*").cast("double"), F.sum(F.pow(F.col("r1") - F.col("r2"), 2))
    return ranked.agg((1 - 6 * d2 / (n * (n * n - 1))).alias("rho"))


def confusion(pairs: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    return pairs.groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def cohen_kappa(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """kappa of two binary raters; 1 where both are constant and equal."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    g = pairs.agg(F.avg((x == y).cast("double")).alias("po"), F.avg(x).alias("p"), F.avg(y).alias("q"))
    pe = F.col("p") * F.col("q") + (1 - F.col("p")) * (1 - F.col("q"))
    return g.select(F.when(pe == 1, 1.0).otherwise((F.col("po") - pe) / (1 - pe)).alias("kappa"))


def weighted_kappa(pairs: DataFrame, a: str = "system_score", b: str = "label") -> DataFrame:
    """kappa with linear weights: 1 - observed over expected disagreement; null where none is expected.

    Only the two marginals (one row per score) meet, not the pairs.
    """
    seen = pairs.agg(F.avg(F.abs(F.col(a) - F.col(b))).alias("o"), F.count("*").alias("n"))
    one = pairs.groupBy(F.col(a).alias("x")).agg(F.count("*").alias("cx"))
    two = pairs.groupBy(F.col(b).alias("y")).agg(F.count("*").alias("cy"))
    expected = one.join(two).agg(F.sum(F.abs(F.col("x") - F.col("y")) * F.col("cx") * F.col("cy")).alias("e"))
    e = F.col("e") / (F.col("n") * F.col("n"))
    return seen.join(expected).select(F.when(e > 0, 1 - F.col("o") / e).alias("kappa"))


def agreement_report(pairs: DataFrame, least: int = 5) -> DataFrame:
    """item_id (null: all), n, exact, within_one, mean_diff, mae, pearson; groups with fewer than `least` pairs have nulls."""
    d = F.col("system_score") - F.col("label")
    enough = lambda c: F.when(F.count("*") >= least, c)
    return pairs.groupingSets([["item_id"], []], "item_id").agg(
        F.count("*").alias("n"), enough(F.avg((d == 0).cast("double"))).alias("exact"), enough(F.avg((F.abs(d) <= 1).cast("double"))).alias("within_one"),
        enough(F.avg(d)).alias("mean_diff"), enough(F.avg(F.abs(d))).alias("mae"), enough(F.corr("system_score", "label")).alias("pearson"),
    )


def binary_prf(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 (0 where undefined)."""
    n = lambda c: F.sum(c.cast("long"))
    g = rows.agg(n(predicted & actual).alias("tp"), n(predicted & ~actual).alias("fp"), n(~predicted & actual).alias("fn"), n(~predicted & ~actual).alias("tn"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    g = g.withColumns({"precision": safe(F.col("tp"), F.col("tp") + F.col("fp")), "recall": safe(F.col("tp"), F.col("tp") + F.col("fn"))})
    return g.withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def grade_confusion(pairs: DataFrame, a: Column, b: Column) -> DataFrame:
    """grade (of a), its counts by the grade of b: columns A to D. Grades start at 80, 60, 40."""
    grade = lambda c: F.when(c >= 80, "A").when(c >= 60, "B").when(c >= 40, "C").otherwise("D")
    return pairs.select(grade(a).alias("grade"), grade(b).alias("g2")).groupBy("grade").pivot("g2", ["A", "B", "C", "D"]).agg(F.count(F.lit(1)))


#: Where the distribution function of a Poisson variable with mean 1 steps up: fixed values.
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]


def poisson_weight(row_id: str, replicate: int, seed: int) -> Column:
    """How often a row is drawn in a replicate: a count that follows from hashes of its id, the replicate and the seed, so draws don't
    depend on how rows are dealt out."""
    u = F.xxhash64(row_id, F.lit(replicate), F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    return reduce(lambda c, ns: c.when(u < ns[1], ns[0]), list(enumerate(POISSON))[1:], F.when(u < POISSON[0], 0)).otherwise(len(POISSON))  # most draws end at the first steps


def interval(values: DataFrame, level: float) -> DataFrame:
    low = (1 - level) / 2
    return values.agg(*(F.percentile("value", F.lit(q)).alias(name) for q, name in ((low, "low"), (0.5, "mid"), (1 - low, "high"))))


def bootstrap_ci(pairs: DataFrame, metric: Callable[[Column], Column], n: int = 200, seed: int = 7, level: float = 0.95) -> DataFrame:
    """low, mid, high: percentile interval of an aggregate under Poisson resampling.

    `metric(weight)` is the aggregate with rows weighted. One pass over the rows (with row_id) works out all replicates; no row is repeated.
    """
    wide = pairs.agg(F.array(*(metric(poisson_weight("row_id", i, seed)) for i in range(n))).alias("v"))
    return interval(wide.select(F.explode("v").alias("value")), level)


def bootstrap_spearman(pairs: DataFrame, a: str, b: str, n: int = 200, seed: int = 7, level: float = 0.95) -> DataFrame:
    """low, mid, high: percentile interval of the rank correlation of two scores under Poisson resampling.

    One pass over the rows (with row_id) counts each combination of scores in every replicate; ranks are worked out from these counts, a
    row per replicate and combination.
    """
    cells = pairs.groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.array(*(F.sum(poisson_weight("row_id", i, seed)) for i in range(n))).alias("w"))
    long = cells.select("x", "y", F.posexplode("w").alias("rep", "w")).where("w > 0")
    for c in "xy":
        sums = long.groupBy("rep", c).agg(F.sum("w").alias("m"))
        upto = F.sum("m").over(Window.partitionBy("rep").orderBy(c).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        long = long.join(sums.select("rep", c, (upto - (F.col("m") - 1) / 2).alias(f"r{c}")), ["rep", c])
    m = lambda e: F.sum(F.col("w") * e) / F.sum("w")
    x, y = F.col("rx"), F.col("ry")
    g = long.groupBy("rep").agg(m(x * y).alias("xy"), m(x).alias("mx"), m(y).alias("my"), m(x * x).alias("xx"), m(y * y).alias("yy"))
    spread = F.sqrt((F.col("xx") - F.col("mx") ** 2) * (F.col("yy") - F.col("my") ** 2))
    return interval(g.select(F.when(spread > 0, (F.col("xy") - F.col("mx") * F.col("my")) / spread).alias("value")), level)
