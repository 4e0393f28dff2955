"""Pruned nearest neighbours against all distances."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from siftwright.operators import neighbours


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, int(i % 3), [float(a) for a in v]) for i, v in enumerate(x)], "row_id long, y int, features array<double>")


def brute(test, train, k, first):
    d = ((test[:, None] - train[None]) ** 2).sum(-1)
    return {(i, first + int(j)) for i, row in enumerate(d) for j in np.lexsort((np.arange(len(row)), row))[:k]}


@pytest.mark.parametrize("k", [1, 5])
def test_against_all_distances(spark, monkeypatch, k):
    """Few and many blocks of queries, clusters, repeated rows and ties, fewer rows than k."""
    monkeypatch.setattr(neighbours, "RUN", 16)
    monkeypatch.setattr(neighbours, "SAMPLE", 64)
    rng = np.random.default_rng(2)
    spots = rng.normal(size=(6, 4)) * 9
    near = lambda n: np.round(spots[rng.integers(0, 6, n)] + rng.normal(size=(n, 4)), 1)
    train = np.concatenate([near(400), np.repeat(near(1), 30, 0), rng.integers(0, 3, (60, 4))])
    test = np.concatenate([near(40), train[:10], rng.integers(0, 3, (15, 4)), np.full((1, 4), 500.0)])
    for block in (1 << 25, 900):
        monkeypatch.setattr(neighbours, "BLOCK_BYTES", block)
        best, measured = neighbours.nearest(table(spark, test), table(spark, train, 1000), k)
        assert {(r["row_id"], r["near"]) for r in best.collect()} == brute(test, train, k, 1000)
        assert 0 < measured.first()[0] < len(test) * len(train)
    few, _ = neighbours.nearest(table(spark, test), table(spark, train[:3], 1000), k)
    assert few.count() == len(test) * min(3, k)


def test_most_distances_are_left_out(spark):
    rng = np.random.default_rng(1)
    spots = rng.normal(size=(40, 16)) * 5
    x = spots[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 16)) / 2
    best, measured = neighbours.nearest(table(spark, x[:300]), table(spark, x[300:], 300))
    assert best.count() == 1500 and measured.first()[0] < 300 * 2700 / 5


def test_no_rows(spark):
    some, none = table(spark, np.ones((4, 2))), table(spark, np.ones((4, 2))).limit(0)
    assert neighbours.nearest(none, some)[0].count() == 0
    best, measured = neighbours.nearest(some, none)
    assert best.count() == 0 and measured.count() == 0


def test_slices_of_queries(spark, monkeypatch):
    """A query's rows do not depend on which others meet a run with it."""
    monkeypatch.setattr(neighbours, "SLICE", 7)
    rng = np.random.default_rng(4)
    test, train = rng.integers(0, 4, (60, 3)), rng.integers(0, 4, (300, 3))
    best, _ = neighbours.nearest(table(spark, test), table(spark, train, 1000))
    assert {(r["row_id"], r["near"]) for r in best.collect()} == brute(test, train, 5, 1000)


def test_a_task_holds_little_beside_its_block():
    """Unit vectors without structure, where no distance is left out: a run meets all queries."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(21000, 64))
    x /= np.sqrt((x**2).sum(1))[:, None]
    queries, rows, pivots = x[:20000], x[20000:], x[20000:20032]
    block = SimpleNamespace(value=(np.arange(20000), queries, pivots, np.full(20000, 1.2)))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, 64, dtype=np.int32)), pa.array(rows.ravel()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(1000)), pa.array(np.zeros(1000, np.int32)), lists], names=["near", "label", "features"])
    tracemalloc.start()
    found = sum(b.num_rows for b in neighbours._searched(block, 5)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found > 90000 and peak < 30 << 20
