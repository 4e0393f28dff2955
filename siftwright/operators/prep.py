"""Cleaning of labelled matrices, and discretization."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from siftwright.functions.expressions import bin_of
from siftwright.functions.shared import stored
from siftwright.operators import order
from siftwright.operators.sites import global_rank


def nonnegative_label(rows: DataFrame) -> DataFrame:
    return rows.withColumn("y", F.when(F.col("y") < 0, 0).otherwise(F.col("y")))


def relabel(rows: DataFrame, label: str = "y") -> DataFrame:
    """Labels become their ranks, from 0. The distinct labels are one row each, so the window over
    them is as large as there are classes, and they travel to the rows: dealt by label, all rows of a
    class would meet in one task. Null labels stay null."""
    ranks = rows.select(F.col(label).alias("_label")).filter("_label IS NOT NULL").distinct()
    ranks = ranks.withColumn("_rank", F.row_number().over(Window.orderBy("_label")) - 1)
    out = rows.join(F.broadcast(ranks), rows[label] == F.col("_label"), "left")
    return out.select(*[F.col("_rank").alias(label) if c == label else rows[c] for c in rows.columns])


def sentinel_to_null(rows: DataFrame, sentinel: float = -1.0) -> DataFrame:
    return rows.withColumn("features", F.transform("features", lambda x: F.nullif(x, F.lit(sentinel))))


def sensor_columns(logs: DataFrame, first: int = 1, last: int = 242, label: int = 243) -> DataFrame:
    """Features from positions ``first`` to ``last`` (from 0) of ``values``, and the label's value."""
    return logs.withColumn("features", F.slice("values", first + 1, last - first + 1)).withColumn("y", F.get("values", F.lit(label))).drop("values")


def drop_null_class(rows: DataFrame) -> DataFrame:
    return rows.filter("y IS NOT NULL AND y <> 0")


def every_nth(rows: DataFrame, n: int, by: str, order: str) -> DataFrame:
    """Rows 1, n+1, 2n+1, ... of each group ``by``. Rows are numbered by one range sort of all of
    them, less the number of the group's first, so a large group needs no one task."""
    if n == 1:
        return rows
    placed = global_rank(rows, by, order, name="_place")
    firsts = placed.groupBy(F.col(by).alias("_by")).agg(F.min("_place").alias("_first"))
    near = placed.join(firsts, placed[by].eqNullSafe(firsts["_by"]))
    return near.filter((F.col("_place") - F.col("_first")) % n == 0).select(rows.columns)


def null_fractions(rows: DataFrame, by: str = "subject") -> DataFrame:
    """(subject, feature, fraction) of missing values."""
    return rows.select(by, F.posexplode("features").alias("feature", "x")).groupBy(by, "feature").agg(F.avg(F.col("x").isNull().cast("double")).alias("fraction"))


def worst_fractions(rows: DataFrame, by: str = "subject") -> DataFrame:
    """(feature, worst): the largest fraction that some subject lacks."""
    return null_fractions(rows, by).groupBy("feature").agg(F.max("fraction").alias("worst"))


def kept_features(rows: DataFrame, by: str = "subject", most: float = 0.5) -> list[int]:
    """Features of which no subject lacks more than ``most``; one number per feature is collected."""
    worst = worst_fractions(rows, by).filter(F.col("worst") <= most)
    return sorted(r["feature"] for r in worst.select("feature").collect())


def label_arity(rows: DataFrame, label: str = "y") -> DataFrame:
    return rows.agg(F.count_distinct(label).alias("classes"))


def project(rows: DataFrame, features: list[int]) -> DataFrame:
    """The listed features, in the order of the list; an index out of range is an error."""
    width = rows.agg(F.min(F.size("features"))).first()[0] or 0
    wrong = [i for i in features if not 0 <= i < width]
    if wrong:
        raise ValueError(f"features out of range 0..{width - 1}: {wrong}")
    return rows.withColumn("features", F.transform(F.array(*map(F.lit, features)), lambda i: F.get("features", i)))


def per_feature(stats: DataFrame, *names: str) -> DataFrame:
    """One row that holds an array, by feature, of each named statistic: as long as a row is wide,
    so it may be broadcast wherever a row fits in memory."""
    gathered = stats.agg(F.array_sort(F.collect_list(F.struct("feature", *names))).alias("s"))
    return gathered.select(*[F.col("s")[n].alias(f"_{n}") for n in names])


def medians(rows: DataFrame, exact: bool = True) -> DataFrame:
    """(feature, med): the mean of the two middle values if their number is even. Exact ones come from
    refined histograms; the approximate form moves only a bounded summary of each task's values."""
    if exact:
        return order.medians(rows)
    long = rows.select(F.posexplode("features").alias("feature", "x")).filter("x IS NOT NULL")
    return long.groupBy("feature").agg(F.percentile_approx("x", 0.5, 10000).alias("med"))


def impute_median(rows: DataFrame, exact: bool = True) -> DataFrame:
    meds = medians(rows, exact)
    width = rows.select(F.explode(F.sequence(F.lit(0), F.size("features") - 1)).alias("feature")).distinct()
    row = per_feature(width.join(meds, "feature", "left"), "med")
    return rows.join(F.broadcast(row)).withColumn("features", F.zip_with("features", "_med", lambda x, m: F.coalesce(x, m))).drop("_med")


def extremes(rows: DataFrame, *by: str) -> DataFrame:
    """(by..., feature, mn, mx); missing values are skipped, a feature without any has nulls."""
    long = rows.select(*by, F.posexplode("features").alias("feature", "x"))
    return long.groupBy(*by, "feature").agg(F.min("x").alias("mn"), F.max("x").alias("mx"))


def global_ranges(local: DataFrame) -> DataFrame:
    """(feature, mn, mx) over all clients' extremes; 0..0 if no client has any."""
    return local.groupBy("feature").agg(F.coalesce(F.min("mn"), F.lit(0.0)).alias("mn"), F.coalesce(F.max("mx"), F.lit(0.0)).alias("mx"))


def binned_values(rows: DataFrame, bins: int = 5, ranges: DataFrame | None = None, keep: tuple[str, ...] = ("y",)) -> DataFrame:
    """(keep..., feature, bin): a row per value, with plain columns throughout, so that all of it is
    compiled. Ranges are the data's own unless ``ranges(feature, mn, mx)`` gives them; there is one
    per place in a row, so they fit wherever a row does."""
    long = rows.select(*keep, F.posexplode("features").alias("feature", "x"))
    known = F.broadcast((extremes(rows) if ranges is None else ranges).select("feature", "mn", "mx"))
    return long.join(known, "feature", "left").select(*keep, "feature", bin_of(F.col("x"), F.col("mn"), F.col("mx"), bins).alias("bin"))


def binned_pairs(rows: DataFrame, j: int, bins: int = 5, keep: tuple[str, ...] = ("y",)) -> DataFrame:
    """(keep..., feature, bin, bin_j): a row per value with the bin of place ``j`` of its row, which is
    worked out once a row; otherwise as ``binned_values``, over the data's own ranges."""
    known = stored(extremes(rows), "ranges")
    of_j = known.filter(F.col("feature") == j).select(F.col("mn").alias("_mn"), F.col("mx").alias("_mx"))
    near = rows.join(F.broadcast(of_j)).withColumn("bin_j", bin_of(F.get("features", F.lit(j)), F.col("_mn"), F.col("_mx"), bins)).filter("bin_j IS NOT NULL")  # one row
    return binned_values(near, bins, known, (*keep, "bin_j"))


def discretize(rows: DataFrame, bins: int = 5, ranges: DataFrame | None = None) -> DataFrame:
    """Adds ``bins``, the equal-width bin of each feature, and drops ``features``.

    Ranges are the data's own unless ``ranges(feature, mn, mx)`` gives them.
    """
    row = per_feature(extremes(rows) if ranges is None else ranges, "mn", "mx")
    cells = F.transform("features", lambda x, i: bin_of(x, F.get("_mn", i), F.get("_mx", i), bins))
    return rows.join(F.broadcast(row)).withColumn("bins", cells).drop("features", "_mn", "_mx")
