"""Logistic regression by its slopes, iterations in shared passes against one by one."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from siftwright.functions import blocks
from siftwright.operators import evaluate, iterations, logistic


def table(spark, n, width, classes, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)) * rng.integers(1, 4, width)
    y = (x @ rng.normal(size=(width, classes)) + rng.gumbel(size=(n, classes)) * 2).argmax(1)
    return spark.createDataFrame([(i, int(c) * 3 - 1, v.tolist()) for i, (c, v) in enumerate(zip(y, x))], "row_id long, y int, features array<double>").repartition(5)


@pytest.mark.parametrize("classes, full", [(3, True), (3, False), (2, True)])
def test_logistic_slopes_are_zero(spark, monkeypatch, classes, full):
    """By SQL, at the weights returned: the derivative of every weight and of the intercept, penalty
    included."""
    if not full:
        monkeypatch.setattr(logistic, "SECOND", 1)
    rows = table(spark, 400, 4, classes)
    labels, weights = logistic.fit(rows)
    assert len(weights) == (classes if classes > 2 else 1)
    data = rows.toPandas()
    con = duckdb.connect()
    con.register("t", pd.DataFrame({"r": data["row_id"], "y": data["y"], "x": data["features"].map(lambda v: [*v, 1.0])}))
    for label, w in zip(labels[-len(weights):], weights):
        got = con.execute(f"WITH w AS (SELECT unnest(range(5)) AS i, unnest({w.tolist()}::DOUBLE[]) AS w), z AS (SELECT r, y, x, 1 / (1 + exp(-list_dot_product(x::DOUBLE[], {w.tolist()}::DOUBLE[]))) - (y = {label})::INT AS a FROM t), s AS (SELECT unnest(range(5)) AS i, unnest(x)::DOUBLE * a AS g FROM z) SELECT max(abs(g + w)) FROM (SELECT i, sum(g) AS g FROM s GROUP BY i) JOIN w USING (i)").fetchone()[0]
        assert got < 1e-3, (label, got)
    assert max(r["slope"] for r in logistic.gradients(rows, labels, weights).collect()) < 1e-3
    right = logistic.predict(rows, labels, weights).filter("y = pred").count()
    assert right > 0.6 * 400


def test_logistic_of_one_label_and_no_rows(spark):
    one = table(spark, 20, 2, 3).filter("y = 2")
    labels, weights = logistic.fit(one)
    assert {r["pred"] for r in logistic.predict(one, labels, weights).collect()} == {2}
    assert {r["pred"] for r in logistic.predict(one, *logistic.fit(one.limit(0))).collect()} == {None}


@pytest.mark.parametrize("stratified", [False, True])
def test_iterations_in_shared_passes(spark, stratified):
    rows = table(spark, 300, 3, 3)
    cells, times = iterations.bayes_iterations(rows, 4, 0.3, 7, stratified)
    want = {}
    for i in range(4):
        for r in evaluate.gaussian_bayes(evaluate.scale(evaluate.split(rows, 0.3, 7 + i, stratified))).collect():
            want[i, r["y"], r["pred"]] = want.get((i, r["y"], r["pred"]), 0) + 1
    assert {(r["iteration"], r["y"], r["pred"]): r["c"] for r in cells.collect()} == want
    assert len(times) == 4 and all(a > 0 and b > 0 for _, a, b in times)
    matrix = evaluate.metrics(cells, times).collect()
    for r in matrix:
        one = spark.createDataFrame([(y, p, c) for (i, y, p), c in want.items() if i == r["iteration"]], "y int, pred int, c long")
        grid = evaluate.confusion(one.selectExpr("y", "pred", "explode(sequence(1, c)) AS _").drop("_"), rows)
        report = {x["label"]: x["f1"] for x in evaluate.class_report(grid).collect()}
        assert (r["macro_f1"], r["weighted_f1"]) == pytest.approx((report["macro"], report["weighted"]))


def test_jobs_do_not_grow_with_iterations(spark):
    rows = table(spark, 200, 3, 3)
    tracker = spark.sparkContext.statusTracker()

    def jobs(n):
        spark.sparkContext.setJobGroup(f"iterations {n}", "")
        iterations.bayes_iterations(rows, n)
        return len(tracker.getJobIdsForGroup(f"iterations {n}"))

    few, many = jobs(2), jobs(12)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert many <= few + 4  # one more round of cells at most


def test_sums_by_tree(spark):
    def count():
        return lambda batch: np.array([batch.num_rows, sum(batch.column(0).to_pylist())], float)

    assert blocks.summed(spark.range(0, 1000, 1, 40), count).tolist() == [1000, 499500]
    assert blocks.summed(spark.range(0), count) is None


def test_times_of_fitting_and_predicting(spark):
    told = evaluate.summary(evaluate.loop(table(spark, 120, 3, 2), "lr", 2, features=[0, 1])).first()
    assert told["iterations"] == 2 and told["mean_fit_seconds"] > 0 and told["mean_predict_seconds"] > 0
