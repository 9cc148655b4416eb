"""Orders over whole tables without a task that sees them all: ranges that Spark cuts by a sample, and sums over ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.sources.shared import written


def in_ranges(rows: DataFrame, *order: Column | str, ranges: int | None = None) -> DataFrame:
    """Rows with `_part`: the number of the range of the order that they are in; what comes first has the lower number.

    Spark draws a sample to cut ranges of like size, however values are spread, as many as there are shuffle partitions, or `ranges`. Equal rows are
    in one range. The rows are written, so ranges stay as they were cut.
    """
    cut = rows.repartitionByRange(ranges, *order) if ranges else rows.repartitionByRange(*order)
    return written(cut.withColumn("_part", F.spark_partition_id()), "ranges")


def before(parts: DataFrame, amount: str, *by: str) -> DataFrame:
    """`by`, _part, _before: sums of an amount over the ranges before each one; there is a row per range."""
    w = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(*by, "_part", F.coalesce(F.sum(amount).over(w), F.lit(0)).alias("_before"))


def numbered(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """Rows with their number, from 1, in an order; each range is numbered by itself, after the counts of those before it."""
    placed = in_ranges(rows, *order)
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.withColumn("_own", own).join(before(counts, "_n"), "_part").withColumn(name, F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


def ring(values: DataFrame, column: str, name: str, *order: Column | str) -> DataFrame:
    """Each value with the next one in an order; the last one's is the first. A range needs the first value of the next range only."""
    placed = in_ranges(values, *order)
    own = Window.partitionBy("_part").orderBy(*order)
    firsts = placed.withColumn("_r", F.row_number().over(own)).where("_r = 1").select("_part", F.col(column).alias("_first"))
    every = Window.orderBy("_part")
    start = F.first("_first").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = firsts.select("_part", F.coalesce(F.lead("_first").over(every), start).alias("_after"))
    return placed.withColumn(name, F.lead(column).over(own)).join(after, "_part").select(column, F.coalesce(name, "_after").alias(name))
