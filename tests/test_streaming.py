"""Messages that come late, twice or in disorder, batches that are replayed, counts that are withdrawn."""

import pytest
from pyspark.sql import functions as F

from siftwright.functions.shared import folders, fresh_path
from siftwright.operators import counts as C, information as I
from siftwright.streaming import replay, rounds, tables


def messages(spark, rows):
    """(id, seconds, round, client, pairs, batch)"""
    return spark.createDataFrame(rows, "id long, t long, round long, client long, pairs array<int>, batch int").withColumn("ts", F.timestamp_seconds("t")).drop("t")


def test_first_reports_under_a_watermark(spark):
    rows = [(1, 10, 0, 1, [], 0), (2, 20, 0, 2, [], 0), (2, 20, 0, 2, [], 0), (3, 110, 1, 1, [], 1), (4, 15, 0, 1, [], 1), (5, 320, 3, 1, [], 2), (6, 30, 0, 3, [], 2), (7, 40, 0, 4, [], 3), (8, 330, 3, 2, [], 3), (9, 900, 9, 1, [], 4), (10, 890, 9, 1, [], 5), (11, 895, 9, 9, [], 5)]
    first = replay.Changes(spark, fresh_path(spark, "first"), "round", "client")
    clients = spark.createDataFrame([(1,), (2,), (3,), (4,)], "client long")
    progress = replay.replayed(messages(spark, rows), lambda s: rounds.first_reports(s, clients, "100 seconds"), first.write, "append")
    got = {(r["round"], r["client"]): r["id"] for r in first.state().collect()}
    assert got == {(0, 1): 1, (0, 2): 2, (1, 1): 3, (3, 1): 5, (0, 3): 6, (3, 2): 8, (9, 1): 9}  # 7 is late, 9 is nobody's client
    assert replay.late_rows(progress) == 1
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert kept[-1] < len(got)  # what can have no further duplicates is forgotten


def test_rounds_close(spark):
    """Round 0 by its last client, 1 and 2 by their limit with what had come, 4 stays open; what comes after a
    round has closed, twice, or over the limit does not count."""
    rows = [
        (1, 5, 0, 1, [1, 2], 0), (2, 6, 0, 1, [3], 0), (3, 105, 1, 1, [1, 2], 0), (4, 7, 0, 2, [2, 3], 1), (5, 8, 0, 2, [1], 1), (6, 155, 1, 2, [1], 1),
        (7, 106, 1, 7, [1], 1), (8, 300, 3, 1, [1], 2), (9, 120, 1, 2, [1, 2], 3), (10, 305, 3, 2, [1], 3), (11, 310, 3, 1, [9], 4), (12, 401, 4, 1, None, 4), (13, 250, 2, 1, [1], 4),
    ]
    closed = replay.Changes(spark, fresh_path(spark, "closed"), "round")
    replay.replayed(messages(spark, rows), lambda s: rounds.closed_rounds(s, [1, 2], 100_000, 50_000, "100 seconds"), closed.write, "append", store=rounds.STORE)
    got = {r["round"]: (r["complete"], r["clients"], list(r["excluded"])) for r in closed.state().collect()}
    assert got == {0: (True, 2, [1, 3]), 1: (False, 1, [1, 2]), 2: (False, 1, [1]), 3: (True, 2, [])}
    assert spark.conf.get(replay.PROVIDER, None) in (None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")


def test_changes_replayed_and_compacted(spark):
    of = lambda *rows: spark.createDataFrame(list(rows), "k string, v int")
    state = lambda: {r["k"]: r["v"] for r in log.state().collect()}
    log = replay.Changes(spark, fresh_path(spark, "log"), "k")
    assert log.state() is None and log.last() is None
    log.write(of(("a", 1), ("b", 1)), 0)
    log.write(of(("a", 2), ("c", None)), 1)
    want = {"a": 2, "b": 1, "c": None}
    assert state() == want
    log.write(of(("a", 2), ("c", None)), 1)
    assert state() == want
    log.compact()
    log.write(of(("b", 9)), 0)  # before the snapshot
    assert state() == want and log.snapshot() == 1
    log.write(of(("b", 5)), 2)
    log.compact()
    assert state() == want | {"b": 5} and log.snapshot() == 2
    log.write(of(("d", 1)), 3)
    log.compact()
    assert state() == want | {"b": 5, "d": 1} and folders(spark, f"{log.path}/batches") == ["3"] and folders(spark, f"{log.path}/snapshots") == ["2", "3"]


def test_changes_are_compacted_on_the_way(spark, monkeypatch):
    monkeypatch.setattr(replay, "EVERY", 3)
    log = replay.Changes(spark, fresh_path(spark, "log"), "k")
    for n in range(10):
        log.write(spark.createDataFrame([("last", n), (f"k{n}", n)], "k string, v int"), n)
    assert log.snapshot() == 7 and {r["k"]: r["v"] for r in log.state().collect()} == {"last": 9, **{f"k{n}": n for n in range(10)}}


def test_running_counts_in_update_mode(spark):
    """Each batch gives changed keys only, and the state is that of all rows."""
    from siftwright.streaming import rollups

    rows = spark.createDataFrame([(i % 2, i % 3, [i % 5], i // 20) for i in range(60)], "client long, y int, bins array<int>, batch int")
    sizes, log = [], replay.Changes(spark, fresh_path(spark, "log"), "client", "feature", "bin", "y")

    def keep(batch, number):
        log.write(batch.filter("y = 0") if number == 1 else batch, number)  # a batch that broke off
        log.write(batch, number)
        sizes.append(batch.count())

    replay.replayed(rows.unionByName(spark.createDataFrame([(5, 5, [4], 3)], rows.schema)), rollups.running_counts, keep, "update")
    want = C.joint_counts(rows.drop("batch"), "client").collect()
    assert sorted((r["client"], r["feature"], r["bin"], r["y"], r["c"]) for r in log.state().filter("client < 5").collect()) == sorted(map(tuple, want))
    assert sizes[-1] == 1


def test_count_store(spark):
    rows = spark.createDataFrame([(i % 3, f"y{i * i % 4}", [i % 5, None if i % 7 == 0 else i % 2], i // 30) for i in range(90)], "client long, y string, bins array<int>, part int")
    store = tables.CountStore(spark, fresh_path(spark, "store"))
    assert store.information().count() == 0 and store.version() == -1

    def same(union):
        counts = C.joint_counts(union, "client").collect()
        got = store.by_client().select("client", "feature", "bin", "y", "c").collect()
        assert sorted(map(tuple, got)) == sorted((r["client"], r["feature"], r["bin"], r["y"], r["c"]) for r in counts)
        told, want = ({r["feature"]: r["mi"] for r in x.collect()} for x in (store.information(), I.mutual_information(I.shares(C.joint_counts(union), "feature"))))
        assert told == pytest.approx(want)
        assert {r["client"]: r["n"] for r in store.sizes().collect()} == {r["client"]: r["count"] for r in union.groupBy("client").count().collect()}
        p = {(r["feature"], r["bin"], r["y"]): r["p"] for r in C.combine(store.probabilities(), union.select("client").distinct().count(), True).collect()}
        assert sum(v for k, v in p.items() if k[0] == 0) == pytest.approx(1)

    for part in range(3):
        assert store.add(f"part {part}", rows.filter(F.col("part") == part))
    same(rows)
    before = store.version()
    assert not store.add("part 1", rows.filter("part = 1")) and store.version() == before
    assert store.withdraw("1 leaves", 1) and not store.withdraw("1 leaves", 1)
    same(rows.filter("client <> 1"))
    assert store.replace("2 again", 2, rows.filter("part = 0"))
    same(rows.filter("client = 0 OR client = 2 AND part = 0"))
    assert store.add("1 is back", rows.filter("client = 1"))
    same(rows.filter("client <> 2 OR part = 0"))
    assert len(folders(spark, f"{store.path}/clients")) == 2
    assert [r["name"] for r in store.ledger().orderBy("name").collect()] == ["1 is back", "1 leaves", "2 again", "part 0", "part 1", "part 2"]


def test_a_broken_commit_leaves_the_last_version(spark):
    rows = spark.createDataFrame([(1, "a", [0]), (1, "b", [1])], "client long, y string, bins array<int>")
    store = tables.CountStore(spark, fresh_path(spark, "store"))
    store.add("one", rows)
    store.by_client().withColumn("c", F.lit(9)).write.parquet(f"{store.path}/clients/1")  # no ledger followed
    assert store.version() == 0 and {r["c"] for r in store.by_client().collect()} == {1}
    assert store.add("two", rows) and {r["c"] for r in store.by_client().collect()} == {2}
