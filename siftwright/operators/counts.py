"""Joint count tables of discretized features and labels.

Two ways, with equal results. The native one explodes a row to its features and counts, combined
before the shuffle. For wide rows the block counter adds up codes in numpy within a task and emits
one row per cell, so no table of rows times features exists.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siftwright.functions.shared import stored
from siftwright.operators.prep import binned_pairs, binned_values

#: Rows of more features than this are counted in blocks.
WIDE = 200
#: Rows that the block counter takes at once.
SLICE = 4096


def _by_rows(rows: DataFrame, by: tuple[str, ...], j: int | None) -> DataFrame:
    other = [] if j is None else [F.get("bins", F.lit(j)).alias("bin_j")]
    # the outer form: else Spark infers a filter on the bins and works them out twice
    long = rows.select(*by, "y", *other, F.posexplode_outer("bins").alias("feature", "bin")).filter("bin IS NOT NULL AND y IS NOT NULL")
    if j is None:
        return long.groupBy(*by, "feature", "bin", "y").agg(F.count("*").alias("c"))
    return _pairs(long.filter("bin_j IS NOT NULL"), by, j)


def _pairs(long: DataFrame, by: tuple[str, ...], j: int) -> DataFrame:
    return long.filter(F.col("feature") != j).groupBy(*by, F.col("feature").alias("k"), F.lit(j).alias("j"), F.col("bin").alias("bin_k"), "bin_j", "y").agg(F.count("*").alias("c"))


def _by_blocks(rows: DataFrame, by: tuple[str, ...], j: int | None, bins: int) -> DataFrame:
    """Partial counts by task, summed over tasks. Groups of a slice are coded densely; what a task
    keeps is one array of features by cells for each (client, label) it meets."""
    lead = by[0] if by else None
    base = rows.select(F.col(lead).cast("long").alias("g") if lead else F.lit(0).cast("long").alias("g"), F.col("y").cast("long").alias("y"), "bins").filter("g IS NOT NULL AND y IS NOT NULL AND bins IS NOT NULL")
    cells = bins if j is None else bins * bins

    def run(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                n = part.num_rows
                flat = part.column(2).flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                values = flat.reshape(n, -1).astype(np.int64)
                width = values.shape[1]
                keys, code = np.unique(np.stack([part.column(0).to_numpy(), part.column(1).to_numpy()], 1), axis=0, return_inverse=True)
                code = code.reshape(-1)
                good = values >= 0
                if j is not None:
                    good &= (values[:, j] >= 0)[:, None]
                    good[:, j] = False
                    values = values * bins + values[:, j][:, None]
                place = (code[:, None] * width + np.arange(width)[None]) * cells + values
                counts = np.bincount(place[good], minlength=len(keys) * width * cells).reshape(len(keys), width, cells)
                for key, count in zip(map(tuple, keys.tolist()), counts):
                    held[key] = held[key] + count if key in held else count
        for (g, y), count in held.items():
            feature, cell = np.nonzero(count)
            m = len(feature)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, g)), pa.array(np.full(m, y)), pa.array(feature.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(count[feature, cell])], names=["g", "y", "feature", "cell", "c"])

    part = base.mapInArrow(run, "g long, y long, feature int, cell int, c long")
    total = part.groupBy("g", "y", "feature", "cell").agg(F.sum("c").alias("c"))
    lead_out = [F.col("g").alias(lead)] if lead else []
    if j is None:
        return total.select(*lead_out, "feature", F.col("cell").alias("bin"), "y", "c")
    return total.select(*lead_out, F.col("feature").alias("k"), F.lit(j).alias("j"), (F.col("cell") / bins).cast("int").alias("bin_k"), (F.col("cell") % bins).alias("bin_j"), "y", "c")


def matrix_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of arrays of equal lengths, and whether they are there."""
    flat = column.flatten()
    there = flat.is_valid().to_numpy(zero_copy_only=False)
    return (x.reshape(len(column), -1) for x in (flat.fill_null(0.0).to_numpy(zero_copy_only=False), there))


def ranges_by_blocks(rows: DataFrame) -> DataFrame:
    """(feature, mn, mx) of raw ``features``: tasks keep an array of each and emit a row per feature. NaN
    is larger than all numbers; a feature without values has no row."""

    def run(batches):
        low = high = None
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                x, there = matrix_of(batch.column(0).slice(at, SLICE))
                mn, mx = np.fmin.reduce(np.where(there, x, np.nan)), np.where(there, x, -np.inf).max(0)
                mn = np.where(there.any(0), np.where(np.isnan(mn), np.inf, mn), np.nan)  # inf: only NaN so far; nan: nothing
                low, high = (mn, mx) if low is None else (np.fmin(low, mn), np.maximum(high, mx))
        if low is not None:
            some = np.flatnonzero(~np.isnan(low))
            mn = np.where(np.isinf(low) & np.isnan(high), np.nan, low)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(mn[some]), pa.array(high[some])], names=["feature", "mn", "mx"])

    part = rows.filter("features IS NOT NULL").select(F.col("features").cast("array<double>").alias("features")).mapInArrow(run, "feature int, mn double, mx double")
    return part.groupBy("feature").agg(F.min("mn").alias("mn"), F.max("mx").alias("mx"))


def binned_block(x: np.ndarray, there: np.ndarray, mn: np.ndarray, mx: np.ndarray, bins: int) -> np.ndarray:
    """Bins of a block of rows as ``bin_of`` gives them, -1 where there is no value."""
    step = (mx - mn) / float(bins)
    out = np.zeros(x.shape, np.int64)
    for i in range(1, bins):
        out += x >= mn + float(i) * step
    out = np.where((x >= mx) | np.isnan(x), bins - 1, out)
    return np.where(there, np.where((mn == mx) | np.isnan(mn) & np.isnan(mx), 0, out), -1)


def with_bins(rows: DataFrame, bins: int = 5, ranges: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``bins`` in the place of ``features``, block by block. Ranges, the data's own unless
    given, are a pair of numbers per place in a row, brought to every task."""
    known = {r["feature"]: (r["mn"], r["mx"]) for r in (ranges_by_blocks(rows) if ranges is None else ranges).collect()}
    kept = [f for f in rows.schema.fields if f.name != "features"]
    at = len(kept)

    def run(batches):
        for batch in batches:
            x, there = matrix_of(batch.column(at)) if batch.num_rows else (np.zeros((0, 0)), np.zeros((0, 0), bool))
            mn, mx = (np.array([known[i][side] if i in known else 0.0 for i in range(x.shape[1])]) for side in (0, 1))
            there = there & np.array([i in known for i in range(x.shape[1])], bool)
            out = binned_block(x, there, mn, mx, bins)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, max(out.shape[1], 1), dtype=np.int32)) if out.size else pa.array([0] * (batch.num_rows + 1), pa.int32()), pa.array(out.reshape(-1), pa.int32(), mask=out.reshape(-1) < 0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], lists], names=[*(f.name for f in kept), "bins"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.filter("features IS NOT NULL").select(*[f.name for f in kept], F.col("features").cast("array<double>").alias("features")).mapInArrow(run, f"{schema}, bins array<int>")


def joint_counts(rows: DataFrame, *by: str, bins: int = 5, blocks: bool | None = None) -> DataFrame:
    """(by..., feature, bin, y, c) of ``rows(by..., y, bins)``; missing bins and labels are skipped.
    ``blocks`` picks the way; left open, the width of a row decides. Rows that have ``features``
    and no bins yet are discretized on the way, value by value or in the blocks."""
    if "bins" not in rows.columns:
        if _wide(rows, blocks, "features"):
            return _by_blocks(with_bins(rows.select(*by, "y", "features"), bins), by, None, bins)
        long = binned_values(rows, bins, keep=(*by, "y")).filter("bin IS NOT NULL AND y IS NOT NULL")
        return long.groupBy(*by, "feature", "bin", "y").agg(F.count("*").alias("c"))
    return _by_blocks(rows, by, None, bins) if _wide(rows, blocks) else _by_rows(rows, by, None)


def pair_counts(rows: DataFrame, j: int, *by: str, bins: int = 5, blocks: bool | None = None) -> DataFrame:
    """(by..., k, j, bin_k, bin_j, y, c) of every other feature k with feature ``j``: no join, as
    both bins stand in one row. Rows that have ``features`` and no bins yet are discretized as in
    ``joint_counts``."""
    if "bins" not in rows.columns:
        if _wide(rows, blocks, "features"):
            return _by_blocks(with_bins(rows.select(*by, "y", "features"), bins), by, j, bins)
        return _pairs(binned_pairs(rows, j, bins, (*by, "y")).filter("bin IS NOT NULL AND y IS NOT NULL"), by, j)
    return _by_blocks(rows, by, j, bins) if _wide(rows, blocks) else _by_rows(rows, by, j)


def _wide(rows: DataFrame, blocks: bool | None, column: str = "bins") -> bool:
    if blocks is None:
        first = rows.select(F.size(column).alias("n")).first()
        return bool(first and first["n"] > WIDE)
    return blocks


def probabilities(counts: DataFrame, rows: DataFrame) -> DataFrame:
    """Each client's counts over its number of rows: adds n and p."""
    sizes = rows.groupBy("client").agg(F.count("*").alias("n"))
    return counts.join(sizes, "client").withColumn("p", F.col("c") / F.col("n"))


def complete(probs: DataFrame, unit: tuple[str, ...], clients: int) -> DataFrame:
    """The units whose table all of so many clients sent; one that some client lacks is out."""
    whole = probs.groupBy(*unit).agg(F.count_distinct("client").alias("_n")).filter(F.col("_n") >= clients).select(*unit)
    return probs.join(whole, list(unit), "left_semi")


def combine(probs: DataFrame, clients: int, weighted: bool = False, shape: dict[str, int] | None = None, unit: tuple[str, ...] = ()) -> DataFrame:
    """One table from the clients' tables; a cell a client lacks is zero there.

    Simple: the sum over the number of clients that count. Weighted: by rows; if no client that
    counts has rows, simple. ``clients`` reported; those with a contribution that is not valid are
    left out whole, of the sums as of their number. With ``unit``, only units count that are
    ``complete``. The contributions have a row per cell and client; they are stored, so what makes
    them runs once.
    """
    held = stored(probs.withColumn("_valid", valid(shape)), "contributions")
    each = held.groupBy("client").agg(F.max("n").alias("n"), F.min("_valid").alias("valid"))
    head = each.agg(F.count_if(~F.col("valid")).alias("out"), F.sum(F.when(F.col("valid"), F.col("n"))).alias("rows")).first()
    if head["out"]:
        held = held.join(each.filter("valid").select("client"), "client", "left_semi")
    if unit:
        held = complete(held, unit, clients - head["out"])
    cell = [c for c in probs.columns if c not in ("client", "c", "n", "p")]
    if weighted and head["rows"]:
        return held.groupBy(*cell).agg((F.sum(F.col("p") * F.col("n")) / F.lit(float(head["rows"]))).alias("p"))
    return held.groupBy(*cell).agg((F.sum("p") / F.lit(float(max(clients - head["out"], 1)))).alias("p"))


def valid(shape: dict[str, int] | None = None) -> Column:
    """Whether a row is part of a contribution that counts: it has a client, a number of rows that
    is not negative, a probability, and, where ``shape`` tells a column's size, a cell within it."""
    good = F.col("client").isNotNull() & F.coalesce(F.col("n") >= 0, F.lit(False)) & F.col("p").isNotNull()
    for column, size in (shape or {}).items():
        good &= F.coalesce((F.col(column) >= 0) & (F.col(column) < size), F.lit(False))
    return good


def valid_contributions(probs: DataFrame, shape: dict[str, int] | None = None) -> DataFrame:
    """The rows that are ``valid``."""
    return probs.filter(valid(shape))
