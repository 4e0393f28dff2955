"""Classifiers on selected columns, and their metrics."""

from __future__ import annotations

import math
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from siftwright.functions.expressions import seeded_order
from siftwright.functions.shared import stored
from siftwright.operators import logistic
from siftwright.operators.iterations import bayes_iterations
from siftwright.operators.neighbours import prepared
from siftwright.operators.order import sections
from siftwright.operators.prep import per_feature, project


def split(rows: DataFrame, ratio: float = 0.3, seed: int = 0, stratified: bool = False) -> DataFrame:
    """Adds ``is_test``: the first ceil(ratio * n) rows in a seeded random order, of all rows or of
    each class. Rows do not move."""
    parts = sections(rows, seeded_order(seed, "row_id"), lambda n: [math.ceil(ratio * n)], "y" if stratified else None)
    return parts.withColumn("is_test", F.col("section") == 0).drop("section")


def scale(rows: DataFrame) -> DataFrame:
    """Features with the training rows' mean 0 and population deviation 1; a constant feature is
    only shifted. ``rows`` has is_test."""
    long = rows.filter("NOT is_test").select(F.posexplode("features").alias("feature", "x"))
    stats = long.groupBy("feature").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    row = per_feature(stats, "mean", "std")
    both = F.arrays_zip("features", "_mean", "_std")
    scaled = F.transform(both, lambda v: (v["features"] - v["_mean"]) / F.when(v["_std"] == 0, 1.0).otherwise(v["_std"]))
    return rows.join(F.broadcast(row)).withColumn("features", scaled).drop("_mean", "_std")


Predictor = Callable[[DataFrame], DataFrame]


def fit_gaussian_bayes(train: DataFrame) -> Predictor:
    """The model, a row per class, travels to every task."""
    long = train.select("y", F.posexplode("features").alias("feature", "x"))
    by_class = long.groupBy("y", "feature").agg(F.avg("x").alias("mu"), F.var_pop("x").alias("v"))
    floor = 1e-9 * (long.groupBy("feature").agg(F.var_pop("x").alias("v")).agg(F.max("v")).first()[0] or 0.0)
    total = train.count()
    prior = train.groupBy("y").agg(F.log(F.count("*") / F.lit(max(total, 1))).alias("prior"))
    model = by_class.groupBy("y").agg(F.array_sort(F.collect_list(F.struct("feature", "mu", (F.col("v") + floor).alias("v")))).alias("m"))
    model = stored(model.join(prior, "y").agg(F.collect_list(F.struct("y", "prior", "m")).alias("_model")), "model")

    def score(c):
        terms = F.zip_with("features", c["m"], lambda x, m: -0.5 * F.log(2 * math.pi * m["v"]) - (x - m["mu"]) * (x - m["mu"]) / (2 * m["v"]))
        return F.struct((-F.aggregate(terms, c["prior"], lambda s, t: s + t)).alias("cost"), c["y"].alias("y"))

    return lambda test: test.join(F.broadcast(model)).select("row_id", "y", F.array_min(F.transform("_model", score))["y"].alias("pred"))  # one row


def fit_nearest_neighbours(train: DataFrame, k: int = 5) -> Predictor:
    search = prepared(train, k)

    def predict(test: DataFrame) -> DataFrame:
        best, _ = search(test)
        votes = best.groupBy("row_id", "label").agg(F.count("*").alias("n"))
        pred = votes.groupBy("row_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("v")).select("row_id", F.col("v.label").alias("pred"))
        return test.select("row_id", "y").join(pred, "row_id")

    return predict


def _assembled(rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return rows.select("row_id", F.col("y").cast("double").alias("label"), array_to_vector("features").alias("vector"))


def fit_random_forest(train: DataFrame, trees: int = 100, seed: int = 0) -> Predictor:
    from pyspark.ml.classification import RandomForestClassifier

    ready = stored(_assembled(train), "assembled")  # fitting passes over it many times
    model = RandomForestClassifier(featuresCol="vector", numTrees=trees, seed=seed).fit(ready)
    return lambda test: model.transform(_assembled(test)).select("row_id", F.col("label").cast("int").alias("y"), F.col("prediction").cast("int").alias("pred"))


def fit_logistic_regression(train: DataFrame, iterations: int = 1000) -> Predictor:
    """One against the rest, with a penalty of unit strength on all weights and the intercept."""
    labels, weights = logistic.fit(stored(train.select("y", "features"), "train"), iterations)
    return lambda test: logistic.predict(test, labels, weights)


def _both(fit: Callable[..., Predictor], rows: DataFrame, *args) -> DataFrame:
    return fit(rows.filter("NOT is_test"), *args)(rows.filter("is_test"))


def gaussian_bayes(rows: DataFrame) -> DataFrame:
    """(row_id, y, pred) of the test rows of ``rows(row_id, y, features, is_test)``, as the following."""
    return _both(fit_gaussian_bayes, rows)


def nearest_neighbours(rows: DataFrame, k: int = 5) -> DataFrame:
    """The majority among the k nearest training rows, ties to the smallest label."""
    return _both(fit_nearest_neighbours, rows, k)


def random_forest(rows: DataFrame, trees: int = 100, seed: int = 0) -> DataFrame:
    return _both(fit_random_forest, rows, trees, seed)


def logistic_regression(rows: DataFrame, iterations: int = 1000) -> DataFrame:
    return _both(fit_logistic_regression, rows, iterations)


def confusion(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """(y, pred, c) for all pairs of ``labels(y)``, zeros included; labels are a few rows."""
    known = labels.select("y").filter("y IS NOT NULL").distinct()
    all_of = known.agg(F.collect_list("y").alias("all"))
    grid = known.join(F.broadcast(all_of)).select("y", F.explode("all").alias("pred"))
    seen = predictions.groupBy("y", "pred").agg(F.count("*").alias("c"))
    return grid.join(seen, ["y", "pred"], "left").select("y", "pred", F.coalesce("c", F.lit(0)).alias("c"))


def class_report(matrix: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) per class and for the macro and weighted means."""
    tp = F.when(F.col("y") == F.col("pred"), F.col("c")).otherwise(0)
    cells = matrix.select(F.explode(F.array(F.struct(F.col("y").alias("l"), F.lit(0).alias("p"), F.col("c").alias("s"), tp.alias("t")), F.struct(F.col("pred").alias("l"), F.col("c").alias("p"), F.lit(0).alias("s"), F.lit(0).alias("t")))).alias("x")).select("x.*")
    per = cells.groupBy("l").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("s").alias("support"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    per = per.select(F.col("l").cast("string").alias("label"), ratio(F.col("t"), F.col("p")).alias("precision"), ratio(F.col("t"), F.col("support")).alias("recall"), "support")
    per = per.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("label", "precision", "recall", "f1", "support")
    names = ("precision", "recall", "f1")
    macro = per.agg(*[F.avg(c).alias(c) for c in names], F.sum("support").alias("support")).select(F.lit("macro").alias("label"), *names, "support")
    mean = per.agg(*[ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in names], F.sum("support").alias("s")).select(F.lit("weighted").alias("label"), *names, F.col("s").alias("support"))
    return per.unionByName(macro).unionByName(mean)


def accuracy_micro(predictions: DataFrame) -> DataFrame:
    """(accuracy, precision_micro, recall_micro, f1_micro): every row has one label and one
    prediction, so errors are as often false positives as false negatives."""
    right = F.avg((F.col("y") == F.col("pred")).cast("double"))
    return predictions.agg(*[right.alias(c) for c in ("accuracy", "precision_micro", "recall_micro", "f1_micro")])


MODELS = {"gnb": fit_gaussian_bayes, "knn": fit_nearest_neighbours, "rf": fit_random_forest, "lr": fit_logistic_regression}


def _known(model: str) -> Callable[..., Predictor]:
    if model not in MODELS:
        raise ValueError(f"unknown model: {model}")
    return MODELS[model]


def loop(rows: DataFrame, model: str = "gnb", iterations: int = 3, ratio: float = 0.3, seed: int = 0, features: list[int] | None = None) -> DataFrame:
    """A row per iteration: (iteration, accuracy, precision_micro, recall_micro, f1_micro, macro_f1,
    weighted_f1, fit_seconds, predict_seconds), over splits with seeds that follow each other, scaled by
    their training rows. With ``features``, over these columns and plain splits, as the selection is to be
    judged; without, over all columns and splits within each class.

    The Gaussian model's iterations share their passes, and their times evenly."""
    fit = _known(model)
    used = rows if features is None else project(rows, features)
    if model == "gnb":
        return metrics(*bayes_iterations(used, iterations, ratio, seed, features is None))
    each, times = None, []
    for i in range(iterations):
        start = time.time()
        scaled = stored(scale(split(used, ratio, seed + i, features is None)), "scaled")
        predictor = fit(scaled.filter("NOT is_test"))
        fitted = time.time()
        cells = stored(predictor(scaled.filter("is_test")).groupBy(F.lit(i).alias("iteration"), "y", "pred").agg(F.count("*").alias("c")), "predictions")
        times.append((i, fitted - start, time.time() - fitted))
        each = cells if each is None else each.unionByName(cells)
    return metrics(each, times)


def metrics(cells: DataFrame, times: list[tuple[int, float, float]]) -> DataFrame:
    """The rows of ``loop`` from the iterations' counts (iteration, y, pred, c); a label that is absent
    where it is looked for counts as 0."""
    right = F.sum(F.when(F.col("y") == F.col("pred"), F.col("c")).otherwise(0))
    told = cells.groupBy("iteration").agg((right / F.sum("c")).alias("accuracy"))
    own = cells.groupBy("iteration", F.col("y").alias("l")).agg(F.sum("c").alias("s"), right.alias("t"))
    named = cells.groupBy("iteration", F.col("pred").alias("l")).agg(F.sum("c").alias("p"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    f1 = ratio(2 * F.coalesce("t", F.lit(0)), F.coalesce("s", F.lit(0)) + F.coalesce("p", F.lit(0)))
    means = own.join(named, ["iteration", "l"], "full").withColumn("f1", f1).groupBy("iteration").agg(F.avg("f1").alias("macro_f1"), ratio(F.sum(F.col("f1") * F.coalesce("s", F.lit(0))), F.sum("s")).alias("weighted_f1"))
    took = cells.sparkSession.createDataFrame(times, "iteration int, fit_seconds double, predict_seconds double")
    return told.join(means, "iteration").join(F.broadcast(took), "iteration").select("iteration", *[F.col("accuracy").alias(c) for c in ("accuracy", "precision_micro", "recall_micro", "f1_micro")], "macro_f1", "weighted_f1", "fit_seconds", "predict_seconds")  # a row per iteration


def summary(each: DataFrame) -> DataFrame:
    """(iterations, mean_accuracy, std_accuracy, mean_fit_seconds, mean_predict_seconds) of ``loop``."""
    return each.agg(F.count("*").alias("iterations"), F.avg("accuracy").alias("mean_accuracy"), F.stddev_pop("accuracy").alias("std_accuracy"), F.avg("fit_seconds").alias("mean_fit_seconds"), F.avg("predict_seconds").alias("mean_predict_seconds"))


def iterate(rows: DataFrame, model: str = "gnb", iterations: int = 3, ratio: float = 0.3, seed: int = 0, stratified: bool = False) -> DataFrame:
    """(iterations, mean_accuracy, std_accuracy) over splits with seeds that follow each other."""
    fit = _known(model)
    if model == "gnb":
        each = metrics(*bayes_iterations(rows, iterations, ratio, seed, stratified))
    else:
        each = None
        for i in range(iterations):
            one = _both(fit, scale(split(rows, ratio, seed + i, stratified))).agg(F.avg((F.col("y") == F.col("pred")).cast("double")).alias("accuracy"))
            each = one if each is None else each.unionByName(one)
    return each.agg(F.count("*").alias("iterations"), F.avg("accuracy").alias("mean_accuracy"), F.stddev_pop("accuracy").alias("std_accuracy"))
