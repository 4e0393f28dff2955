"""One-vs-rest logistic regression, the intercept penalised as any other weight.

For each class the sum of the losses log(1 + exp(-s w.x)) of all rows, s being 1 for the class and -1
for others and x ending in 1, plus half the squared length of w, is least. All classes go on together: a
step is one pass, whose tasks emit the losses, gradients and second derivatives of all classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftwright.functions.blocks import matrix, summed

#: Second derivatives of so many numbers at most are gathered; with more, their diagonals are.
SECOND = 1 << 22
TOLERANCE = 1e-6


def _ready(rows: DataFrame) -> DataFrame:
    return rows.filter("features IS NOT NULL AND y IS NOT NULL").select(F.col("y").cast("int").alias("y"), F.col("features").cast("array<double>").alias("features"))


def _pass(weights: np.ndarray, labels: np.ndarray, full: bool):
    """Losses, gradients and, where asked for, second derivatives at ``weights``, without the penalty."""

    def of(batch: pa.RecordBatch) -> np.ndarray:
        x = np.hstack([matrix(batch.column(1)), np.ones((batch.num_rows, 1))])
        own = batch.column(0).to_numpy()[:, None] == labels
        z = x @ weights.T
        loss = np.logaddexp(0, np.where(own, -z, z)).sum(0)
        share = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
        slope = ((share - own).T @ x).ravel()
        bend = share * (1 - share)
        second = [(x * b[:, None]).T @ x if full else (x**2 * b[:, None]).sum(0) for b in bend.T]
        return np.concatenate([loss, slope, np.ravel(second)])

    return lambda: of


def _downhill(slope: np.ndarray, second: np.ndarray, moves: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The step that second derivatives give; or, from their diagonal, the one that the last moves and the
    changes of slope that came with them give."""
    if second.ndim == 2:
        return np.linalg.solve(second + np.eye(len(slope)), slope)
    goal, shares = slope.copy(), []
    for step, change in reversed(moves):
        shares.append((step @ goal) / (step @ change))
        goal -= shares[-1] * change
    goal /= second + 1
    for (step, change), share in zip(moves, reversed(shares)):
        goal += (share - (change @ goal) / (step @ change)) * step
    return goal


def fit(rows: DataFrame, iterations: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(labels, weights) of ``rows(y, features)``: a row of weights for each label, the intercept last; of
    two labels only the second has one. No rows, or rows of one label, give no weights."""
    ready = _ready(rows)
    labels = np.array(sorted(r["y"] for r in ready.select("y").distinct().collect()), np.int64)
    first = ready.select(F.size("features").alias("n")).first()
    if len(labels) < 2:
        return labels, np.zeros((0, (first["n"] if first else 0) + 1))
    told = labels[1:] if len(labels) == 2 else labels
    k, width = len(told), first["n"] + 1
    full = k * width * width <= SECOND
    weights = np.zeros((k, width))

    def at(w: np.ndarray):
        total = summed(ready, _pass(w, told, full))
        loss, slope, second = np.split(total, [k, k + k * width])
        return loss + 0.5 * (w**2).sum(1), slope.reshape(k, width) + w, second.reshape((k, width, width) if full else (k, width))

    loss, slope, second = at(weights)
    scale = np.maximum(1.0, np.abs(slope).max(1))
    length = np.ones(k)
    goal = np.zeros_like(weights)
    fresh = np.ones(k, bool)
    moves: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(k)]
    for _ in range(iterations):
        open_ = np.abs(slope).max(1) > TOLERANCE * scale
        if not open_.any():
            break
        for i in np.flatnonzero(open_ & fresh):
            goal[i] = _downhill(slope[i], second[i], moves[i])
            length[i] = 1.0
        tried = np.where(open_[:, None], weights - length[:, None] * goal, weights)
        new_loss, new_slope, new_second = at(tried)
        better = open_ & (new_loss <= loss - 1e-4 * length * (goal * slope).sum(1) + 1e-12 * np.abs(loss))
        for i in np.flatnonzero(better):
            if not full and (tried[i] - weights[i]) @ (new_slope[i] - slope[i]) > 0:
                moves[i] = [*moves[i][-9:], (tried[i] - weights[i], new_slope[i] - slope[i])]
        for old, new in ((weights, tried), (loss, new_loss), (slope, new_slope), (second, new_second)):
            old[better] = new[better]
        fresh = better
        length = np.where(better, 1.0, length / 2)
        if (length[open_] < 1e-9).all():
            break
    return labels, weights


def predict(rows: DataFrame, labels: np.ndarray, weights: np.ndarray) -> DataFrame:
    """(row_id, y, pred): the label whose score is highest, ties to the smallest; the only label if there
    is one, null if there is none. Rows without features are left out."""
    test = rows.filter("features IS NOT NULL").select("row_id", F.col("y").cast("int").alias("y"), F.col("features").cast("array<double>").alias("features"))
    kind = dict(test.dtypes)["row_id"]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            if len(weights):
                z = matrix(batch.column(2)) @ weights[:, :-1].T + weights[:, -1]
                at = (z[:, 0] > 0).astype(int) if len(labels) == 2 else z.argmax(1)
                pred = pa.array(labels[at].astype(np.int32))
            else:
                pred = pa.array([int(labels[0]) if len(labels) else None] * batch.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pred], names=["row_id", "y", "pred"])

    return test.mapInArrow(run, f"row_id {kind}, y int, pred int")


def gradients(rows: DataFrame, labels: np.ndarray, weights: np.ndarray) -> DataFrame:
    """(label, slope): the largest partial derivative, in size, of each label's sum at its weights."""
    told = labels[1:] if len(labels) == 2 else labels
    spark = rows.sparkSession
    known = spark.createDataFrame([(int(c), w.tolist()) for c, w in zip(told, weights)], "label int, w array<double>")
    each = _ready(rows).select("y", F.concat("features", F.array(F.lit(1.0))).alias("x")).join(F.broadcast(known))  # a row per label
    z = F.aggregate(F.zip_with("x", "w", lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)
    away = 1 / (1 + F.exp(-z)) - (F.col("y") == F.col("label")).cast("double")
    terms = each.select("label", "w", away.alias("away"), F.posexplode("x").alias("i", "x"))
    sums = terms.groupBy("label", "i").agg((F.sum(F.col("away") * F.col("x")) + F.max(F.get("w", F.col("i")))).alias("g"))
    return sums.groupBy("label").agg(F.max(F.abs("g")).alias("slope"))
