import os

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from siftwright.operators import counts as C, evaluate, information as I, prep, select, sites, telemetry
from siftwright.sources import files


def matrix(spark, rows):
    return spark.createDataFrame([(i, r[0], list(r[1])) for i, r in enumerate(rows)], "row_id long, y int, features array<double>")


@pytest.mark.parametrize("x, want", [(-1, 0), (0, 0), (1.999, 0), (2, 1), (5, 2), (8, 4), (9.999, 4), (10, 4), (11, 4)])
def test_edges(spark, x, want):
    ranges = spark.createDataFrame([(0, 0.0, 10.0)], "feature int, mn double, mx double")
    assert prep.discretize(matrix(spark, [(0, [float(x)])]), 5, ranges).first()["bins"] == [want]


def test_point_range_null_and_hundredths(spark):
    rows = matrix(spark, [(0, [3.0, i / 100]) for i in range(11)] + [(0, [None, None])])
    got = [r["bins"] for r in prep.discretize(rows, 5).orderBy("row_id").collect()]
    assert [b[1] for b in got] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 4, None]
    assert {b[0] for b in got[:-1]} == {0} and got[-1][0] is None


def binned(spark, rows):
    return spark.createDataFrame([(i, i % 2, y, x) for i, (x, y) in enumerate(rows)], "row_id long, client long, y int, bins array<int>")


def scores(counts, unit=("feature",), x=("bin",)):
    return {r[0]: r["mi"] for r in I.mutual_information(I.shares(counts, *unit), unit, x).collect()}


def test_information_goldens(spark):
    xor = binned(spark, [([0, 0], 0), ([0, 1], 1), ([1, 0], 1), ([1, 1], 0)])
    assert scores(C.joint_counts(xor)) == {0: 0.0, 1: 0.0}
    assert scores(C.pair_counts(xor, 1), ("k", "j"), ("bin_k", "bin_j"))[0] == pytest.approx(1)
    copy = binned(spark, [([0, 2, 0], 0), ([1, 2, 1], 1), ([0, 2, 1], 0), ([1, 2, 0], 1)])
    assert scores(C.joint_counts(copy))[0] == pytest.approx(1) and scores(C.joint_counts(copy))[1] == 0
    assert [r["feature"] for r in select.jmi(copy, 3).collect()] == [0, 1, 2]
    assert [r["feature"] for r in select.jmi(copy, 9).collect()] == [0, 1, 2]


def test_blocks_equal_rows(spark):
    rows = binned(spark, [([i % 5, (i * 7) % 4, None if i % 3 else 1], i % 3) for i in range(200)])
    for make in (lambda b: C.joint_counts(rows, "client", blocks=b), lambda b: C.pair_counts(rows, 1, "client", blocks=b)):
        a, b = make(True), make(False)
        assert sorted(map(tuple, a.select(b.columns).collect())) == sorted(map(tuple, b.collect()))


def test_labels_travel_to_the_rows(spark):
    """However large a table is, its rows stay where they are as their labels become ranks."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(0, 1000, 1, 4).select(F.col("id").alias("row_id"), F.get(F.array(F.lit("R"), F.lit("A"), F.lit("N"), F.lit(None)), (F.col("id") % 4).cast("int")).alias("y"))
        out = prep.relabel(rows.withColumn("was", F.spark_partition_id())).withColumn("at", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(out) == 1000 and all(r["was"] == r["at"] for r in out)
    assert all(r["y"] == (2, 0, 1, None)[r["row_id"] % 4] for r in out)


def test_pairs_of_raw_rows(spark):
    """Pairs of rows that are not discretized yet, value by value and in blocks."""
    rows = spark.createDataFrame([(i % 2, None if i % 11 == 0 else i % 3, [None if i % 7 == 0 else i / 3, -float(i * 5 % 13), None, 2.0]) for i in range(150)], "client long, y int, features array<double>")
    for j in (0, 1, 2, 3, 4):
        want = sorted(map(tuple, C.pair_counts(prep.discretize(rows), j, "client", blocks=False).collect()))
        names = ["client", "k", "j", "bin_k", "bin_j", "y", "c"]
        for blocks in (False, None, True) if j < 4 else (False, None):
            assert sorted(map(tuple, C.pair_counts(rows, j, "client", blocks=blocks).select(names).collect())) == want
        assert bool(want) == (j not in (2, 4))
    one = C.pair_counts(rows, 0)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, C.pair_counts(prep.discretize(rows), 0, blocks=False).collect()))
    assert C.pair_counts(rows.limit(0), 0).count() == 0
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "transform(" not in plan and "zip_with" not in plan


@pytest.mark.parametrize("occupied, cells", [((0, 1, 4), (0, 0, 2)), ((0, 2, 4), (0, 1, 2)), ((0, 2, 3), (0, 2, 2)), ((0, 3, 4), (0, 2, 2)), ((0, 1, 3, 4), (0, 1, 3, 3)), ((0, 1, 2, 4), (0, 1, 2, 3))])
def test_gap_merge(spark, occupied, cells):
    counts = spark.createDataFrame([(0, b, i, 1) for i, b in enumerate(occupied)], "feature int, bin int, y int, c long")
    assert [r["bin"] for r in I.merge_gaps(counts).orderBy("y").collect()] == list(cells)


def test_combine(spark):
    probs = spark.createDataFrame([("a", 1, 0, 0, 0, 1.0), ("b", 3, 0, 0, 0, 1 / 3), ("b", 3, 0, 1, 1, 2 / 3)], "client string, n long, feature int, bin int, y int, p double")
    of = lambda w: {r["bin"]: r["p"] for r in C.combine(probs, 2, w).collect()}
    assert of(False) == pytest.approx({0: 2 / 3, 1: 1 / 3}) and of(True) == pytest.approx({0: 0.5, 1: 0.5})
    none = probs.withColumn("n", F.lit(0))
    assert {r["bin"]: r["p"] for r in C.combine(none, 2, True).collect()} == pytest.approx({0: 2 / 3, 1: 1 / 3})
    assert C.valid_contributions(probs.withColumn("n", F.lit(-1))).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 500), st.integers(1, 9), st.floats(0, 1))
def test_quotas(total, clients, unevenness):
    sizes = sites.quotas(total, clients, unevenness)
    assert sum(sizes) == total and len(sizes) == clients and min(sizes) >= 0
    assert sites.quotas(10, 4, 0) == [3, 3, 2, 2]


def test_sites(spark):
    rows = matrix(spark, [(i % 3, [0.0]) for i in range(10)])
    sizes = lambda df: sorted(r["count"] for r in df.groupBy("client").count().collect())
    assert sizes(sites.iid(rows, 4)) == [2, 2, 2, 2]
    shards = sites.label_shards(rows, 2)
    assert sizes(shards) == [4, 4] and shards.agg(F.max("row_id")).first()[0] == 7
    assert sizes(sites.label_blocks(rows, [1, 2, 7])) == [1, 2, 7]
    assert sorted(r["place"] for r in sites.global_rank(rows, "row_id").collect()) == list(range(10))
    with pytest.raises(ValueError):
        sites.assign(rows, "none", 2)
    assert sites.iid(rows.limit(0), 4).count() == 0


def test_agreement(spark):
    of = lambda *f: spark.createDataFrame([(x,) for x in f], "feature int")
    assert select.agreement(of(1, 2, 3, 4), of(3, 4, 5)).first()["tpr"] == 0.5
    assert select.agreement(of(1, 2, 3, 4), of(3, 4, 5), 8).first()["tpr"] == 0.25
    with pytest.raises(ValueError):
        select.agreement(of(), of())


def test_files(spark, tmp_path):
    (tmp_path / "S3-a.dat").write_text("0 1 -1 2\n1 5 6 0\n")
    logs = files.read_sensor_logs(spark, str(tmp_path / "S*-*.dat"))
    assert {r["subject"] for r in logs.collect()} == {3}
    rows = prep.drop_null_class(prep.sentinel_to_null(prep.sensor_columns(logs, 1, 2, 3)))
    assert [r["features"] for r in rows.collect()] == [[1.0, None]]
    (tmp_path / "sel.txt").write_text("7\n\n 3\n")
    assert [tuple(r) for r in files.read_selection(spark, str(tmp_path / "sel.txt")).collect()] == [(1, 7), (2, 3)]
    assert files.selection_name("d", "federated", 5, "JMI") == "d_federated_selected_top5_JMI_feature_indices.txt"


def test_errors_and_scaling(spark):
    rows = matrix(spark, [(0, [1.0, 5.0]), (1, [3.0, 5.0])]).withColumn("is_test", F.lit(False))
    assert [r["features"] for r in evaluate.scale(rows).orderBy("row_id").collect()] == [[-1.0, 0.0], [1.0, 0.0]]
    with pytest.raises(ValueError):
        prep.project(rows, [2])
    with pytest.raises(ValueError):
        select.select(rows, "other", 1)
    left = lambda *x: spark.range(1).select(telemetry.other_time(*map(F.lit, x))).first()[0]
    assert left(10.0, 3.0, 2.0, 1.0, 1.0, 1.0) == 2 and left(1.0, 3.0, 2.0, 1.0, 0.5, 0.25) == -0.75


def test_unequal_files(spark, tmp_path):
    (tmp_path / "d").write_text("1 2\n3 4\n5 6\n")
    (tmp_path / "l").write_text("1\n0\n")
    with pytest.raises(ValueError, match="3 lines of data, 2 labels"):
        files.read_matrix(spark, str(tmp_path / "d"), str(tmp_path / "l"))


def test_lines_are_numbered_over_splits_and_files(spark, tmp_path):
    """Many splits, and files whose sizes do not follow their names."""
    folder = tmp_path / "f"
    folder.mkdir()
    lines = [str(i) for i in range(5000)]
    (folder / "part-0").write_text("\n".join(lines[:100]) + "\n")
    (folder / "part-1").write_text("\n".join(lines[100:]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = files.numbered_lines(spark, str(folder)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["line_no"], r["value"]) for r in got) == [(i, x) for i, x in enumerate(lines)]


def test_pair_that_a_client_lacks_is_out(spark):
    """Feature 2 would be chosen, but client 1 has none of its values."""
    rows = [(i, i % 2, (i // 2) % 2, [(i // 4) % 2, (i // 2 + i // 4) % 2, (i // 2) % 2 if i % 2 == 0 else None]) for i in range(64)]
    table = spark.createDataFrame(rows, "row_id long, client long, y int, bins array<int>")
    assert 2 in [r["feature"] for r in select.jmi(table, 3).collect()]
    probs = C.probabilities(C.pair_counts(table, 0, "client"), table)
    assert {r["k"] for r in C.complete(probs, ("k", "j"), 2).select("k").distinct().collect()} == {1}
    chosen = [r["feature"] for r in select.jmi(table, 3, combined="simple").collect()]
    assert chosen[0] == 2 or 2 not in chosen  # it may start, by its own table, but no pair holds it


def test_contributions_that_do_not_count(spark):
    """A client whose table is out of shape, or without rows, leaves the sums and the divisor."""
    rows = [("a", 1, 0, 0, 0, 1.0), ("b", 3, 0, 0, 0, 0.5), ("b", 3, 0, 1, 1, 0.5), ("c", 4, 0, 0, 0, 0.5), ("c", 4, 0, 9, 0, 0.5), ("d", -1, 0, 0, 0, 1.0)]
    probs = spark.createDataFrame(rows, "client string, n long, feature int, bin int, y int, p double")
    of = lambda w: {r["bin"]: r["p"] for r in C.combine(probs, 4, w, {"bin": 5}).collect()}
    assert of(False) == pytest.approx({0: 0.75, 1: 0.25}) and of(True) == pytest.approx({0: 0.625, 1: 0.375})


def test_values_are_binned_as_rows_are(spark):
    rows = spark.createDataFrame([(i % 3, i % 2, [float(i), None if i % 5 == 0 else float(i * i % 17), 3.0]) for i in range(60)], "client int, y int, features array<double>")
    long, wide = C.joint_counts(rows, "client"), C.joint_counts(prep.discretize(rows), "client")
    assert sorted(map(tuple, long.collect())) == sorted(map(tuple, wide.select(long.columns).collect()))


def test_first_report_wins(spark):
    from siftwright.streaming import rollups

    rows = [(3, "2024-01-01 00:00:05", 1, "a", 5.0), (2, "2024-01-01 00:00:01", 1, "a", 7.0), (1, "2024-01-01 00:00:01", 2, "a", 1.0), (4, "2024-01-01 00:00:01", 1, "b", 2.0), (5, "2024-01-01 00:00:00", 9, "a", 9.0)]
    reports = spark.createDataFrame(rows, "id long, ts string, client long, round string, seconds double").withColumn("ts", F.col("ts").cast("timestamp"))
    known = spark.createDataFrame([(1,), (2,)], "client long")
    got = {(r["round"], r["client"]): (r["id"], r["seconds"]) for r in rollups.first_reports(reports, known, "seconds").collect()}
    assert got == {("a", 1): (2, 7.0), ("a", 2): (1, 1.0), ("b", 1): (4, 2.0)}


@pytest.mark.parametrize("model", ["rf", "lr", "knn", "gnb"])
def test_models_on_held_out_rows(spark, model):
    """Two classes that a line divides but for some noise: each model tells them on held-out rows."""
    import numpy as np

    x = np.random.default_rng(3).normal(size=(600, 4))
    rows = matrix(spark, [(int(a[0] + a[1] > 0), a.tolist()) for a in x])
    out = evaluate.loop(rows, model, 1, 0.3, features=[0, 1, 2]).first()
    assert out["accuracy"] >= 0.88 and out["macro_f1"] >= 0.88 and out["fit_seconds"] > 0 and out["predict_seconds"] > 0, out


def test_release(spark):
    from siftwright.functions import shared

    kept = shared.stored(spark.range(5).toDF("id"), "five")
    folder = kept.inputFiles()[0].removeprefix("file:").replace("///", "/").rsplit("/", 1)[0]
    assert kept.count() == 5 and os.path.isdir(folder)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared.shared_dir(spark))
    spark.range(5).checkpoint()
    held = sc.getCheckpointDir().removeprefix("file:").replace("///", "/")
    assert os.listdir(held)
    shared.release(spark)
    assert not os.path.exists(folder) and not os.listdir(held)
    assert spark.range(7).checkpoint().count() == 7


def test_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from siftwright.functions import shared

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="x"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(far)


def test_profile(spark):
    """Records that lack something go whole; each time is the slowest client's."""
    rows = [("a", 1.0, 2.0, 3.0, 4.0), ("a", None, None, 1.0, 1.0), ("a", 9.0, 9.0, None, 9.0), ("b", 0.5, 5.0, 1.0, 9.0), (None, 50.0, 50.0, 50.0, 50.0), ("", 50.0, 50.0, 50.0, 50.0), ("c", 70.0, 70.0, 70.0, None)]
    records = spark.createDataFrame(rows, "client string, load double, pre double, compute double, comm double")
    server = spark.createDataFrame([("agg", 1.0), ("mi", 2.0), ("mi", 0.5)], "phase string, seconds double")
    span = spark.createDataFrame([(20.0,)], "span double")
    assert tuple(telemetry.profile(records, server, span).first()) == (1.0, 5.0, 4.0, 9.0, 1.0, 2.5, 19.0, -2.5)
    assert tuple(telemetry.profile(records.limit(0), server.limit(0), span).first()) == (0, 0, 0, 0, 0, 0, 20.0, 20.0)
    energy = spark.createDataFrame([("a", 1, 1, 1.0, 0.5), ("a", 1, 2, 3.0, None), ("b", 1, 1, None, 9.0), ("b", 0, 3, 2.0, 0.25), (None, 9, 9, 9.0, 9.0)], "client string, ts long, id long, kwh double, co2_kg double")
    assert tuple(telemetry.total_energy(telemetry.last_energy(energy), 0.5, 0.125).first()) == (2, 5.5, 0.375)
