"""The block-wise ways give what the plain ones give."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwright.operators import counts as C, pairs, prep, select


def holed(spark, seed, n, width, classes=3, clients=3):
    """Rows of dependent bins with holes; client 0 has no values of the last feature."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 5, (n, 3))
    bins = (base[:, rng.integers(0, 3, width)] + rng.integers(0, 2, (n, width))) % 5
    rows = [
        (i, None if i % 31 == 0 else i % clients, None if i % 17 == 0 else int((base[i].sum() + i) % classes), [None if rng.random() < 0.1 or f == width - 1 and i % clients == 0 else int(b) for f, b in enumerate(r)])
        for i, r in enumerate(bins)
    ]
    return spark.createDataFrame(rows, "row_id long, client long, y int, bins array<int>")


@pytest.mark.parametrize("width", [5, 16, 37])
@pytest.mark.parametrize("combined", [None, "simple", "weighted"])
def test_all_pairs_equal_rounds(spark, monkeypatch, width, combined):
    monkeypatch.setattr(pairs, "SLICE", 50)
    monkeypatch.setattr(pairs, "HELD", 10_000)
    rows = holed(spark, width, 400, width)
    if combined:
        rows = rows.filter("client IS NOT NULL")
    quick, slow = (select.jmi(rows, 6, combined=combined, all_pairs=way).collect() for way in (True, False))
    assert [(r["rank"], r["feature"]) for r in quick] == [(r["rank"], r["feature"]) for r in slow]
    assert [r["score"] for r in quick] == pytest.approx([r["score"] for r in slow], abs=1e-9)
    got = pairs.information_matrix(rows, width, combined=combined)
    assert got.count() == got.select("k", "j").distinct().count() and got.filter("k > j").count() == 0
    if combined:
        assert got.filter(F.col("j") == width - 1).filter("k < j").count() == 0  # client 0 lacks these tables


def test_no_rows_and_too_wide(spark):
    rows = holed(spark, 1, 10, 4)
    assert select.jmi(rows.limit(0), 3).count() == 0 and pairs.information_matrix(rows.limit(0), 4).count() == 0
    with pytest.raises(ValueError):
        pairs.information_matrix(rows, pairs.PAIRS + 1)


def raw(spark):
    rng = np.random.default_rng(4)
    odd = lambda f, x: None if rng.random() < 0.1 else math.nan if f == 2 and rng.random() < 0.1 else 7.0 if f == 3 else math.nan if f == 4 else x
    rows = [(i % 3, i % 2, [None if f == 5 else odd(f, float(x)) for f, x in enumerate(rng.integers(-40, 40, 8) / 8)]) for i in range(300)]
    return spark.createDataFrame([*rows, (1, 1, None)], "client int, y int, features array<double>")


def test_raw_rows_by_blocks(spark, monkeypatch):
    """Missing values, NaN, constant features and such without values."""
    monkeypatch.setattr(C, "SLICE", 40)
    rows = raw(spark)
    told = lambda df: sorted(map(str, map(tuple, df.collect())))
    assert told(C.ranges_by_blocks(rows)) == told(prep.extremes(rows).filter("mn IS NOT NULL"))
    long, block = C.joint_counts(rows, "client", blocks=False), C.joint_counts(rows, "client", blocks=True)
    assert told(long) == told(block.select(long.columns))
    given = spark.createDataFrame([(f, -1.0, 2.0) for f in range(8)], "feature int, mn double, mx double")
    whole = C.with_bins(rows, 5, given)
    assert told(whole) == told(prep.discretize(rows.filter("features IS NOT NULL"), 5, given).select(whole.columns))
    assert C.joint_counts(rows.limit(0), blocks=True).count() == 0


def test_wide_rows_are_not_exploded(spark):
    """Ten thousand columns: no row per value in the plan, and the counts add up."""
    rows = spark.range(40).select((F.col("id") % 2).cast("int").alias("y"), F.transform(F.sequence(F.lit(0), F.lit(9999)), lambda i: ((i * 7 + F.col("id") * 13) % 101).cast("double")).alias("features"))
    counts = C.joint_counts(rows)
    plan = counts._jdf.queryExecution().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
    assert counts.agg(F.sum("c")).first()[0] == 40 * 10_000
