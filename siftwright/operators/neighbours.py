"""Exact nearest neighbours of one set of vectors in another, with most distances left out.

Some of the training rows are pivots. A training row belongs to its nearest pivot and lies in the
order of pivot and distance from it, split by ranges of both, so a common place is dealt out. Queries
come in blocks of a bounded size to all tasks. A query's neighbours lie no farther than its k-th
nearest among a sample of training rows; by the triangle inequality a run of rows can hold none
of them if the distances of its rows from some pivot are all too far from the query's own. What
is left is measured, and each task keeps k rows for a query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from siftwright.functions.expressions import seeded_order
from siftwright.functions.shared import stored

#: Training rows that bound the distances, pivots among them, bytes of a block of queries with all that
#: a task keeps for them, rows of a run, queries that meet a run at once, and distances that are
#: measured at once.
SAMPLE, PIVOTS, BLOCK_BYTES, RUN, SLICE, PAIRS = 2048, 32, 1 << 25, 128, 4096, 1 << 16

_FOUND = "row_id long, near long, label int, d double, measured long"
_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int64()]
_NAMES = [f.split()[0] for f in _FOUND.split(", ")]


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0.0))


def spread(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows of a sample, each the farthest from those before it."""
    chosen, far = [0], _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(count, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def _placed(pivots: np.ndarray):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                d = _distances(_vectors(batch.column(2)), pivots)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=["near", "label", "features", "cell", "away"])

    return run


def _searched(block, k: int):
    """A task's k nearest rows for each query of the block, and, in a row without query, how many
    distances it has measured. Besides the block, it holds what a slice of queries and a run need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, pivots, bound = block.value
        slices = [slice(a, a + SLICE) for a in range(0, len(ids), SLICE)]
        from_pivots = np.empty((len(ids), len(pivots)))
        for part in slices:
            from_pivots[part] = _distances(queries[part], pivots)
        slack = 1e-6 * (1 + from_pivots.max(initial=0.0))
        limit = bound.copy()
        best_d = np.full((len(ids), k), np.inf)
        best_id = np.full((len(ids), k), np.iinfo(np.int64).max)
        best_label = np.zeros((len(ids), k), np.int32)
        squares = np.einsum("ij,ij->i", queries, queries)
        measured = 0

        def meet(part, near, label, rows, low, high):
            reach = (limit[part] + slack)[:, None]
            open_ = part.start + np.flatnonzero(((from_pivots[part] - reach <= high) & (from_pivots[part] + reach >= low)).all(1))
            if not len(open_):
                return 0
            rough = queries[open_] @ rows.T
            rough *= -2
            rough += squares[open_, None]
            rough += (rows**2).sum(1)[None]
            asked, met = np.nonzero(rough <= ((limit[open_] + slack) ** 2)[:, None])
            for at in range(0, len(asked), PAIRS):
                q, r = open_[asked[at : at + PAIRS]], met[at : at + PAIRS]
                touched = np.unique(q)
                whose = np.concatenate([np.repeat(touched, k), q])
                d = np.concatenate([best_d[touched].ravel(), ((rows[r] - queries[q]) ** 2).sum(1)])
                which, what = np.concatenate([best_id[touched].ravel(), near[r]]), np.concatenate([best_label[touched].ravel(), label[r]])
                order = np.lexsort((which, d, whose))
                first = np.searchsorted(whose[order], touched)
                kept = order[first[:, None] + np.arange(k)]
                best_d[touched], best_id[touched], best_label[touched] = d[kept], which[kept], what[kept]
                limit[touched] = np.minimum(limit[touched], np.sqrt(best_d[touched, -1]))
            return len(open_) * len(rows)

        for batch in batches:
            if not batch.num_rows:
                continue
            near, label, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _vectors(batch.column(2))
            for at in range(0, len(near), RUN):
                span = slice(at, at + RUN)
                away = _distances(rows[span], pivots)
                measured += sum(meet(part, near[span], label[span], rows[span], away.min(0), away.max(0)) for part in slices)
        for part in slices:
            q, place = np.nonzero(np.isfinite(best_d[part]))
            q += part.start
            columns = [ids[q], best_id[q, place], best_label[q, place], best_d[q, place], np.zeros(len(q), np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((None, None, None, None, measured), _TYPES)], names=_NAMES)

    return run


Search = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def prepared(train: DataFrame, k: int = 5) -> Search:
    """A search among ``train(row_id, y, features)``, whose rows are put in order once; see ``nearest``."""
    spark = train.sparkSession
    ready = train.filter("features IS NOT NULL").select(F.col("row_id").cast("long").alias("near"), F.col("y").cast("int").alias("label"), F.col("features").cast("array<double>").alias("features"))
    few = ready.orderBy(seeded_order(0, "near"), "near").limit(SAMPLE).select("features").collect()
    empty = spark.createDataFrame([], _FOUND)
    if not few:
        return lambda test: (empty.drop("measured"), empty.select("measured"))
    sample = np.array([r["features"] for r in few])
    pivots = spread(sample, PIVOTS)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    line = ready.mapInArrow(_placed(pivots), "near long, label int, features array<double>, cell int, away double")
    line = stored(line.repartitionByRange(parts, "cell", "away", "near").sortWithinPartitions("cell", "away").select("near", "label", "features"), "train")
    kept = 8 * (sample.shape[1] + len(pivots)) + 20 * k + 32  # a query, its distances from pivots, its k rows, its id, square and bounds
    most, own = max(1, BLOCK_BYTES // kept), min(k, len(sample)) - 1

    def search(held: list[tuple]) -> DataFrame:
        ids, queries = np.array([h[0] for h in held]), np.array([h[1] for h in held])
        bound = np.full(len(ids), np.inf)
        if len(sample) >= k:
            bound = np.concatenate([np.partition(_distances(queries[a : a + 1024], sample), own, axis=1)[:, own] for a in range(0, len(ids), 1024)])
        block = spark.sparkContext.broadcast((ids, queries, pivots, bound))
        out = stored(line.mapInArrow(_searched(block, k), _FOUND), "found")
        block.destroy()
        return out

    def of(test: DataFrame) -> tuple[DataFrame, DataFrame]:
        found, held = empty, []
        for row in test.filter("features IS NOT NULL").select(F.col("row_id").cast("long"), F.col("features").cast("array<double>")).toLocalIterator():
            held.append(tuple(row))
            if len(held) == most:
                found, held = found.unionByName(search(held)), []
        if held:
            found = found.unionByName(search(held))
        order = Window.partitionBy("row_id").orderBy("d", "near")  # k rows of each task at most
        best = found.filter("row_id IS NOT NULL").withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k)
        return best.select("row_id", "near", "label", "d"), found.agg(F.coalesce(F.sum("measured"), F.lit(0)).alias("measured"))

    return of


def nearest(test: DataFrame, train: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(row_id, near, label, d), the k nearest of ``train(row_id, y, features)`` to each row of
    ``test(row_id, features)`` by squared distance, ties to the smaller row_id; and (measured), the number
    of distances that this took. Rows without features take no part. Features are finite and of one
    length.

    A pass over ``train`` serves as many queries as ``BLOCK_BYTES`` hold; neither side is copied.
    """
    return prepared(train, k)(test)
