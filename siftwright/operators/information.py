"""Mutual information from count or probability tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from siftwright.functions.expressions import TINY


def shares(counts: DataFrame, *unit: str) -> DataFrame:
    """Counts as shares of their unit's total: column p."""
    return counts.withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy(*unit)))


def mutual_information(table: DataFrame, unit: tuple[str, ...] = ("feature",), x: tuple[str, ...] = ("bin",), nats: bool = False) -> DataFrame:
    """(unit..., mi) of a table (unit..., x..., y, p). Shares of ``TINY`` or less are skipped and
    results of ``TINY`` or less are zero.

    The table has at most features x bins x classes rows, so its windows are small.
    """
    px = F.sum("p").over(Window.partitionBy(*unit, *x))
    py = F.sum("p").over(Window.partitionBy(*unit, "y"))
    log = F.log if nats else F.log2
    cells = table.withColumn("px", px).withColumn("py", py)
    term = F.when((F.col("p") > TINY) & (F.col("px") > TINY) & (F.col("py") > TINY), F.col("p") * log(F.col("p") / (F.col("px") * F.col("py")))).otherwise(0.0)
    total = F.sum(term)
    return cells.groupBy(*unit).agg(F.when(total > TINY, total).otherwise(0.0).alias("mi"))


def merge_gaps(counts: DataFrame) -> DataFrame:
    """Bins as a histogram over the occupied range with as many cells as occupied bins has them:
    where occupied bins have gaps, two can fall into one cell."""
    seen = counts.groupBy("feature").agg(F.min("bin").alias("mn"), F.max("bin").alias("mx"), F.count_distinct("bin").alias("arity"))
    step = (F.col("mx") - F.col("mn")) / F.col("arity")
    edges = F.aggregate(F.sequence(F.lit(1), F.col("arity")), F.lit(0), lambda s, i: s + F.when(F.col("bin") >= F.col("mn") + i * step, 1).otherwise(0))
    cell = F.when(F.col("mn") == F.col("mx"), 0).otherwise(F.least(edges, F.col("arity") - 1)).cast("int")
    return counts.join(seen, "feature").withColumn("bin", cell).groupBy("feature", "bin", "y").agg(F.sum("c").alias("c"))
