"""Splits, scaling and Gaussian Bayes models of many iterations in passes that they share.

A row is a test row of some iterations and a training row of the others, by fences in each iteration's
seeded order. One pass adds up counts, sums and squares by iteration, class and feature, which scale the
features and give the models; another pass scores every row under the models that it is a test row for.
The number of passes does not depend on that of iterations.
"""

from __future__ import annotations

import math
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftwright.functions.blocks import matrix, summed
from siftwright.functions.expressions import seeded_order
from siftwright.operators.order import fences_of, key_of, sections

#: Rows of a class whose features tell where the sums begin.
SHIFT_ROWS = 256


def test_flags(rows: DataFrame, iterations: int, ratio: float, seed: int, stratified: bool) -> DataFrame:
    """Adds ``tests``, an array that tells for each iteration whether the row is a test row, as ``split``
    with the seeds from ``seed`` on would."""
    orders = [seeded_order(seed + i, "row_id") for i in range(iterations)]
    group = F.coalesce(F.col("y").cast("string"), F.lit("")) if stratified else F.lit("")
    keys = F.array(*[F.struct(F.concat(F.lit(f"{i}|"), group).alias("group"), key_of(o).alias("key")) for i, o in enumerate(orders)])
    fences = fences_of(rows.select(F.explode(keys).alias("k")).select("k.group", "k.key"), lambda n: [math.ceil(ratio * n)])
    if any(left for of in fences.values() for _, left in of):  # rows whose first digits are a fence's: iteration by iteration
        out, names = rows, []
        for i, o in enumerate(orders):
            names.append(f"_section{i}")
            out = sections(out, o, lambda n: [math.ceil(ratio * n)], "y" if stratified else None, name=names[-1])
        return out.withColumn("tests", F.array(*[F.col(n) == 0 for n in names])).drop(*names)
    groups = sorted({g.split("|", 1)[1] for g in fences})
    table = [(g, [fences.get(f"{i}|{g}", []) for i in range(iterations)]) for g in groups]
    listed = [(g, [of[0][0] if of else None for of in each]) for g, each in table]
    known = rows.sparkSession.createDataFrame(listed, "_group string, _fences array<long>")
    near = rows.withColumn("_group", group).join(F.broadcast(known), "_group")  # a row per class
    flags = [F.coalesce(key_of(o) < F.get("_fences", F.lit(i)), F.lit(True)) for i, o in enumerate(orders)]
    return near.withColumn("tests", F.array(*flags)).select(*rows.columns, "tests")


def bayes_iterations(rows: DataFrame, iterations: int, ratio: float = 0.3, seed: int = 0, stratified: bool = False) -> tuple[DataFrame, list[tuple[int, float, float]]]:
    """(iteration, y, pred, c): test rows of each iteration by label and prediction, and the times
    (iteration, fit, predict) in seconds, each iteration's share. Rows without label or features are left
    out."""
    spark = rows.sparkSession
    start = time.time()
    ready = rows.filter("y IS NOT NULL AND features IS NOT NULL").select("row_id", F.col("y").cast("int").alias("y"), F.col("features").cast("array<double>").alias("features"))
    flagged = test_flags(ready, iterations, ratio, seed, stratified).select("y", "features", "tests")
    labels = np.array(sorted(r["y"] for r in ready.select("y").distinct().collect()), np.int64)
    few = ready.select("features").limit(SHIFT_ROWS).collect()
    if not few:
        return spark.createDataFrame([], "iteration int, y int, pred int, c long"), []
    shift = np.array([r["features"] for r in few]).mean(0)
    width, classes = len(shift), len(labels)

    def sums():
        def of(batch: pa.RecordBatch) -> np.ndarray:
            x = matrix(batch.column(1)) - shift
            own = (batch.column(0).to_numpy()[:, None] == labels).astype(np.float64)
            train = ~matrix(batch.column(2)).astype(bool)
            ones = (train[:, :, None] * own[:, None]).reshape(len(x), -1)
            return np.concatenate([ones.sum(0), (ones.T @ x).ravel(), (ones.T @ x**2).ravel()])

        return of

    n, s, q = np.split(summed(flagged, sums), [iterations * classes, iterations * classes * (1 + width)])
    n, s, q = n.reshape(iterations, classes, 1), s.reshape(iterations, classes, width), q.reshape(iterations, classes, width)
    total = np.maximum(n.sum(1, keepdims=True), 1)
    mean = s.sum(1, keepdims=True) / total
    std = np.sqrt(np.maximum(q.sum(1, keepdims=True) / total - mean**2, 0))
    scale = np.where(std == 0, 1.0, std)
    mu = s / np.maximum(n, 1)
    floor = 1e-9 * (std / scale).max(-1, keepdims=True) ** 2
    var = np.maximum(q / np.maximum(n, 1) - mu**2, 0) / scale**2 + floor
    mu = (mu - mean) / scale
    with np.errstate(divide="ignore"):
        prior = np.log(n / total)[..., 0]
    fitted = time.time()

    def scored(batches):
        cells = np.zeros((iterations, classes, classes), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, tests = matrix(batch.column(1)) - shift, matrix(batch.column(2)).astype(bool)
            own = np.searchsorted(labels, batch.column(0).to_numpy())
            for i in range(iterations):
                z = (x[tests[:, i]] - mean[i]) / scale[i]
                cost = [-0.5 * np.log(2 * math.pi * var[i, c]).sum() - ((z - mu[i, c]) ** 2 / (2 * var[i, c])).sum(1) + prior[i, c] if n[i, c, 0] else np.full(len(z), -np.inf) for c in range(classes)]
                np.add.at(cells[i], (own[tests[:, i]], np.argmax(cost, axis=0)), 1)
        i, y, pred = np.nonzero(cells)
        columns = [i.astype(np.int32), labels[y].astype(np.int32), labels[pred].astype(np.int32), cells[i, y, pred]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["iteration", "y", "pred", "c"])

    out = flagged.mapInArrow(scored, "iteration int, y int, pred int, c long").groupBy("iteration", "y", "pred").agg(F.sum("c").alias("c")).collect()
    ended = time.time()
    cells = spark.createDataFrame(out, "iteration int, y int, pred int, c long")
    return cells, [(i, (fitted - start) / iterations, (ended - fitted) / iterations) for i in range(iterations)]
