"""Exact order statistics without a sort: histograms refined where the rank lies.

Keys are integers in the order of the values. A round counts the keys by their next bits, only among
those that share the bits found so far, and the cell that holds the rank gives these bits. Tasks
count before anything moves, so cells travel and values do not; a few passes find any rank.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Bits of a round, and of the keys of a digest's order.
STEP, BITS = 15, 60
#: Bits of a round among numbers.
WIDE = 16
#: Rows that are counted at once.
SLICE = 4096


def _cells(counts: DataFrame, wanted: list[tuple], schema: str, *kept: str) -> list:
    """For each (group, prefix, ..., left) of ``wanted`` the cell, among the cells of its group and prefix, in
    which that many keys come before it. There are a few wanted places to a group, one group to a
    place in a row or to a class."""
    upto = F.sum("n").over(Window.partitionBy("group", "prefix").orderBy("cell"))
    places = counts.sparkSession.createDataFrame(wanted, schema)
    near = counts.withColumn("_upto", upto).join(F.broadcast(places), ["group", "prefix"])
    hit = near.filter((F.col("_upto") - F.col("n") <= F.col("left")) & (F.col("left") < F.col("_upto")))
    return hit.select("group", "prefix", "place", "cell", "n", (F.col("left") - F.col("_upto") + F.col("n")).alias("left"), *kept).collect()


def _ordered(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the numbers, NaN last and zeros equal."""
    bits = (x + 0.0).view(np.uint64)
    keys = np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))
    return np.where(np.isnan(x), ~np.uint64(0), keys)


def _numbers(prefixes: dict[int, list[int]] | None, shift: int):
    """Counts, smallest and largest value, by place in a row and cell, of a task's rows."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.column(0).slice(at, SLICE)
                flat = part.flatten()
                width = len(flat) // len(part)
                there = flat.is_valid().to_numpy(zero_copy_only=False)
                x = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
                place = np.tile(np.arange(width), len(part))
                x, place = x[there], place[there]
                keys = _ordered(x)
                if prefixes is not None:
                    above = keys >> np.uint64(shift + WIDE)
                    known = [np.array([(prefixes.get(f) or [-1])[min(i, len(prefixes.get(f) or [-1]) - 1)] for f in range(width)], np.int64).astype(np.uint64) for i in (0, 1)]
                    held = (above == known[0][place]) | (above == known[1][place])
                    x, place, keys = x[held], place[held], keys[held]
                if not len(x):
                    continue
                order = np.lexsort((keys, place))
                x, place, cells = x[order], place[order], keys[order] >> np.uint64(shift)
                first = np.flatnonzero(np.append(True, (cells[1:] != cells[:-1]) | (place[1:] != place[:-1])))
                last = np.append(first[1:], len(x)) - 1
                whole = cells[first]
                columns = [place[first].astype(np.int32), (whole >> np.uint64(WIDE)).astype(np.int64), (whole & np.uint64((1 << WIDE) - 1)).astype(np.int32), last - first + 1, x[first], x[last]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["group", "prefix", "cell", "n", "mn", "mx"])

    return run


def medians(rows: DataFrame) -> DataFrame:
    """(feature, med) of ``rows(features)``: the mean of the two middle values if their number is even.
    Missing values are skipped, a feature without any has no row; NaN is larger than all numbers."""
    spark = rows.sparkSession
    base = rows.select(F.col("features").cast("array<double>").alias("features")).filter("features IS NOT NULL AND size(features) > 0")
    found: dict[tuple[int, int], float] = {}
    wanted: list[tuple[int, int, int, int]] = []
    prefixes = None
    for shift in range(64 - WIDE, -1, -WIDE):
        parts = base.mapInArrow(_numbers(prefixes, shift), "group int, prefix long, cell int, n long, mn double, mx double")
        counts = parts.groupBy("group", "prefix", "cell").agg(F.sum("n").alias("n"), F.min("mn").alias("mn"), F.max("mx").alias("mx"))
        if prefixes is None:
            counts = counts.persist()
            totals = counts.groupBy("group").agg(F.sum("n").alias("n")).collect()
            wanted = [(r["group"], 0, place, at) for r in totals for place, at in enumerate(((r["n"] - 1) // 2, r["n"] // 2))]
        hits = _cells(counts, wanted, "group int, prefix long, place int, left long", "mn", "mx") if wanted else []
        counts.unpersist()
        wanted = []
        for r in hits:
            if r["left"] == 0 or r["mn"] == r["mx"] or math.isnan(r["mn"]) or shift == 0:
                found[r["group"], r["place"]] = r["mn"]
            elif r["left"] == r["n"] - 1:
                found[r["group"], r["place"]] = r["mx"]
            else:
                wanted.append((r["group"], r["prefix"] << WIDE | r["cell"], r["place"], r["left"]))
        if not wanted:
            break
        prefixes = {}
        for group, prefix, *_ in wanted:
            prefixes.setdefault(group, []).append(prefix)
    return spark.createDataFrame([(g, (found[g, 0] + found[g, 1]) / 2) for g in sorted({g for g, _ in found})], "feature int, med double")


def key_of(order: Column) -> Column:
    """The first digits of a text in hexadecimal, as a number."""
    return F.conv(F.substring(order, 1, BITS // 4), 16, 10).cast("long")


def fences_of(keys: DataFrame, ranks: Callable[[int], list[int]]) -> dict[str, list[tuple[int, int]]]:
    """For each group of ``keys(group, key)`` and each place of ``ranks(n)`` that is there: (key, left), the
    key at that place and how many equal ones come before it, or a lower bound of the key that nothing
    lies between, and 0. Places below 0 give a key below all."""
    spark = keys.sparkSession
    fences: dict[str, list[tuple[int, int]]] = {}
    wanted: list[tuple[str, int, int, int]] = []
    for shift in range(BITS - STEP, -1, -STEP):
        cells = keys.select("group", F.shiftright("key", shift + STEP).alias("prefix"), F.shiftright("key", shift).bitwiseAND(F.lit((1 << STEP) - 1)).alias("cell"))
        if wanted:
            open_cells = spark.createDataFrame(sorted({w[:2] for w in wanted}), "group string, prefix long")
            cells = cells.join(F.broadcast(open_cells), ["group", "prefix"])  # a few fences to a group
        counts = cells.groupBy("group", "prefix", "cell").agg(F.count("*").alias("n"))
        if not wanted:
            counts = counts.persist()
            totals = {r["group"]: r["n"] for r in counts.groupBy("group").agg(F.sum("n").alias("n")).collect()}
            wanted = [(g, 0, i, rank) for g, n in totals.items() for i, rank in enumerate(ranks(n)) if 0 <= rank < n]
            fences = {g: [(-1, 0)] * sum(rank < 0 for rank in ranks(n)) for g, n in totals.items()}
        hits = _cells(counts, wanted, "group string, prefix long, place int, left long") if wanted else []
        counts.unpersist()
        wanted = []
        for r in hits:
            cell = r["prefix"] << STEP | r["cell"]
            if r["left"] == 0 or shift == 0:
                fences[r["group"]].append((cell << shift, r["left"]))
            else:
                wanted.append((r["group"], cell, r["place"], r["left"]))
        if not wanted:
            break
    return fences


def sections(rows: DataFrame, order: Column, ranks: Callable[[int], list[int]], by: str | None = None, tie: str = "row_id", name: str = "section") -> DataFrame:
    """Adds the number of fences that a row is not before, in the order of ``order``, a text in
    hexadecimal, and then ``tie``, all rows or each group ``by``. ``ranks(n)`` gives the places, from 0,
    of the first rows behind the fences of n rows; a place that is not there fences nothing off.

    Rows stay where they are; only those whose first digits are a fence's meet, and they are one each
    unless ``tie`` repeats."""
    spark = rows.sparkSession
    group = F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit("")
    keyed = rows.withColumns({"_key": key_of(order), "_group": group})
    fences = fences_of(keyed.select(F.col("_group").alias("group"), F.col("_key").alias("key")), ranks)
    listed = [(g, [{"key": k, "left": left} for k, left in sorted(of)]) for g, of in fences.items()]
    table = spark.createDataFrame(listed, "_group string, _fences array<struct<key: long, left: long>>")
    known = keyed.join(F.broadcast(table), "_group")  # a row per group
    tied = F.exists("_fences", lambda f: (f["key"] == F.col("_key")) & (f["left"] > 0))
    near = Window.partitionBy("_group", "_key").orderBy(order, tie)
    meeting = known.filter(tied).withColumn("_at", F.row_number().over(near) - 1)
    whole = known.filter(~tied).withColumn("_at", F.lit(0)).unionByName(meeting) if any(left for of in fences.values() for _, left in of) else known.withColumn("_at", F.lit(0))
    behind = F.size(F.filter("_fences", lambda f: (F.col("_key") > f["key"]) | ((F.col("_key") == f["key"]) & (F.col("_at") >= f["left"]))))
    return whole.withColumn(name, behind).select(*rows.columns, name)
