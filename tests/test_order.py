"""Ranks from refined histograms against sorted values."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwright.functions.expressions import seeded_order
from siftwright.operators import order


def shuffled(spark, run):
    """Bytes that jobs of ``run`` write to shuffles."""
    def total():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    run()
    return total() - before


def medians_of(spark, columns):
    rows = spark.createDataFrame([(list(map(lambda x: None if x is None else float(x), r)),) for r in zip(*columns)], "features array<double>").repartition(3)
    return {r["feature"]: r["med"] for r in order.medians(rows).collect()}


def median(values):
    values = sorted((x for x in values if x is not None), key=lambda x: (math.isnan(x), x))
    return (values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2 if values else None


def test_medians(spark, monkeypatch):
    """Close, equal, signed, tiny, huge and missing values, zeros of both signs, NaN, features without any."""
    monkeypatch.setattr(order, "SLICE", 64)
    rng = np.random.default_rng(1)
    n = 501
    columns = [
        rng.normal(size=n).tolist(), (1 + rng.integers(0, 9, n) * 2.0**-52).tolist(), [5.0] * n, (-np.exp(rng.normal(0, 200, n))).tolist(), [None if i % 2 else float(i) for i in range(n)],
        [None] * n, [0.0 if i % 2 else -0.0 for i in range(n)], [math.nan if i % 3 else 1.0 for i in range(n)], [math.nan if i % 7 == 0 else -float(i) for i in range(n)], [float(i % 2) for i in range(n - 1)] + [None],
    ]
    got = medians_of(spark, columns)
    for f, values in enumerate(columns):
        want = median(values)
        assert (f not in got) if want is None else got[f] == want or math.isnan(got[f]) and math.isnan(want), f
    assert medians_of(spark, [[3.0]]) == {0: 3.0} and medians_of(spark, [[3.0, 4.0]]) == {0: 3.5}
    assert order.medians(spark.createDataFrame([], "features array<double>")).count() == 0


@pytest.mark.parametrize("by", [None, "y"])
def test_sections(spark, monkeypatch, by):
    rows = spark.range(700).select(F.col("id").alias("row_id"), F.when(F.col("id") % 11 != 0, F.col("id") % 3).alias("y")).repartition(5)
    ranks = lambda n: [-1, 0, n // 5, n // 5, n // 2, n - 1, n, n + 3]
    for digits in (60, 8):  # with two digits many rows meet at the fences
        monkeypatch.setattr(order, "BITS", digits)
        monkeypatch.setattr(order, "STEP", 15 if digits == 60 else 4)
        out = order.sections(rows, seeded_order(3, "row_id"), ranks, by).collect()
        groups = {}
        for r in out:
            groups.setdefault(r["y"] if by else 0, []).append((hashlib.md5(f"3:{r['row_id']}".encode()).hexdigest(), r["row_id"], r["section"]))
        assert len(out) == 700
        for of in groups.values():
            for place, (_, _, section) in enumerate(sorted(of)):
                assert section == sum(rank <= place for rank in ranks(len(of)))
    assert order.sections(rows.limit(0), seeded_order(3, "row_id"), ranks, by).count() == 0


def test_values_do_not_move(spark):
    rows = spark.range(0, 200_000, 1, 4).select(F.col("id").alias("row_id"), F.array(*[F.rand(i) for i in range(4)]).alias("features"))
    moved = shuffled(spark, lambda: order.medians(rows).collect())
    fenced = shuffled(spark, lambda: order.sections(rows, seeded_order(1, "row_id"), lambda n: [n // 3]).groupBy("section").count().collect())
    assert moved < 6_400_000 / 2 and fenced < 200_000 * 40 / 4
