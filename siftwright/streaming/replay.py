"""Streams of messages that arrive in batches, and tables that batches are merged into."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from siftwright.functions.shared import delete, folders, fresh_path

#: Batches after which a keyed table is compacted.
EVERY = 32
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def replayed(messages: DataFrame, make: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], mode: str, batch: str = "batch", store: str | None = None) -> list[dict]:
    """Lets ``messages`` arrive batch by batch, by the number in column ``batch``, and runs the
    streaming query ``make(stream)`` over each as it comes: the query ends with its input and goes
    on from its checkpoint with the next, as after a restart. Returns the progress of all runs.

    The numbers are few; a batch is written, and read, by as many tasks as it has files."""
    spark = messages.sparkSession
    arrived, offsets, staged = (fresh_path(spark, f"replay-{x}") for x in ("arrived", "offsets", "staged"))
    messages.write.partitionBy(batch).parquet(staged)
    whole = spark.read.parquet(staged)
    told: list[dict] = []
    for number in sorted(r[0] for r in whole.select(batch).distinct().collect()):
        whole.filter(F.col(batch) == number).drop(batch).write.parquet(f"{arrived}/{number}")
        stream = spark.readStream.schema(whole.drop(batch).schema).option("recursiveFileLookup", "true").parquet(arrived)
        told += run(make(stream), sink, mode, offsets, store).recentProgress
    return told


def run(stream: DataFrame, sink: Callable[[DataFrame, int], None], mode: str, offsets: str, store: str | None = None) -> StreamingQuery:
    """Runs a stream into ``sink(batch, number)`` until its input is in; ``store`` names the class that
    keeps its state, if not the session's."""
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER, None)
    if store:
        conf.set(PROVIDER, store)
    try:
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", offsets).trigger(availableNow=True).foreachBatch(sink)
        query = writer.queryName(f"q{uuid.uuid4().hex}").start()
        query.awaitTermination()
        return query
    finally:
        if store and before is None:
            conf.unset(PROVIDER)
        elif store:
            conf.set(PROVIDER, before)


def late_rows(progress: list[dict]) -> int:
    """Rows that stateful operators have let go because the watermark had passed them."""
    return sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"])


class Changes:
    """A keyed table that takes the changed rows of each batch, and the same ones again as often as a
    batch is replayed.

    A batch is a folder named by its number, written whole or not at all for readers; the table's
    state is each key's row of the largest number. ``compact``, which every so many batches call, writes
    the state as a snapshot, which stands for all batches up to its number; such a batch, replayed, is let
    go. What the snapshot before it stood for is deleted then: a reader has until the next one.
    """

    def __init__(self, spark: SparkSession, path: str, *keys: str):
        self.spark, self.path, self.keys = spark, path, keys

    def write(self, batch: DataFrame, number: int) -> None:
        last = self.snapshot()
        if number > last:
            batch.write.mode("overwrite").parquet(f"{self.path}/batches/{number}")
            if self.keys and number - last > EVERY:
                self.compact()

    def snapshot(self) -> int:
        return max((int(n) for n in folders(self.spark, f"{self.path}/snapshots")), default=-1)

    def state(self) -> DataFrame | None:
        """The last row of each key; none before the first batch."""
        last = self.snapshot()
        parts = [(last, f"{self.path}/snapshots/{last}")] if last >= 0 else []
        parts += [(int(n), f"{self.path}/batches/{n}") for n in folders(self.spark, f"{self.path}/batches") if int(n) > last]
        rows = None
        for number, path in sorted(parts):
            part = self.spark.read.parquet(path).withColumn("_batch", F.lit(number))
            rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            return None
        values = [c for c in rows.columns if c not in (*self.keys, "_batch")]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*values), "_batch").alias("_v"))
        return newest.select(*self.keys, "_v.*")

    def last(self) -> DataFrame | None:
        """The rows of the last batch alone."""
        known = [int(n) for n in folders(self.spark, f"{self.path}/batches")]
        return self.spark.read.parquet(f"{self.path}/batches/{max(known)}") if known else None

    def compact(self) -> None:
        known, before = [int(n) for n in folders(self.spark, f"{self.path}/batches")], self.snapshot()
        if known and max(known) > before:
            self.state().write.mode("overwrite").parquet(f"{self.path}/snapshots/{max(known)}")
            for what, numbers in (("batches", [n for n in known if n <= before]), ("snapshots", [int(n) for n in folders(self.spark, f"{self.path}/snapshots") if int(n) < before])):
                for n in numbers:
                    delete(self.spark, f"{self.path}/{what}/{n}")
