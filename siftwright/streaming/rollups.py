"""The same roll-ups over streams of rows or reports, as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftwright.functions.shared import fresh_path
from siftwright.operators.information import mutual_information, shares
from siftwright.streaming.replay import Changes, run


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream, whether the table is a file or a folder of files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}*.parquet")


def drained(stream: DataFrame, *keys: str, then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The state of a keyed aggregation once all of a stream's input is in. Each batch gives the rows
    it changes, which are merged by batch number, so a batch that is replayed changes nothing. With
    ``then``, each batch makes that of the state so far, and what the last one made is returned."""
    spark = stream.sparkSession
    changes = Changes(spark, fresh_path(spark, "changes"), *keys)
    made = Changes(spark, fresh_path(spark, "made"))

    def keep(batch: DataFrame, number: int) -> None:
        changes.write(batch, number)
        if then:
            made.write(then(changes.state()), number)

    run(stream, keep, "update", fresh_path(spark, "offsets"))
    return made.last() if then else changes.state()


def running_counts(rows: DataFrame) -> DataFrame:
    """Joint counts per client as discretized rows arrive; the state is the grid of cells."""
    long = rows.select("client", "y", F.posexplode("bins").alias("feature", "bin")).filter("bin IS NOT NULL AND y IS NOT NULL")
    return long.groupBy("client", "feature", "bin", "y").agg(F.count("*").alias("c"))


def refreshed_information(counts: DataFrame) -> DataFrame:
    """Information per feature from the state of ``running_counts``, all clients together."""
    return mutual_information(shares(counts.groupBy("feature", "bin", "y").agg(F.sum("c").alias("c")), "feature"))


def parsed(messages: DataFrame, schema: str, payload: str = "props") -> DataFrame:
    """The fields of JSON messages as columns; one that does not parse has nulls."""
    return messages.withColumn("_m", F.from_json(payload, schema)).select(*[c for c in messages.columns if c != payload], "_m.*")


def as_messages(rows: DataFrame, *fields: str, payload: str = "props") -> DataFrame:
    """``rows`` with the fields as one JSON message in the place of them; a field that is null is left out of
    it. ``parsed`` is the way back."""
    return rows.select(*[c for c in rows.columns if c not in fields], F.to_json(F.struct(*fields)).alias(payload))


def first_reports(reports: DataFrame, clients: DataFrame, *fields: str) -> DataFrame:
    """(client, round, id, fields...): the first report, by time and then id, of each known client in
    each round, whatever the order in which reports arrive. The state is a row per client and round."""
    known = reports.join(clients, "client", "left_semi")
    first = F.min(F.struct("ts", "id", *fields)).alias("_first")
    return known.groupBy("client", "round").agg(first).select("client", "round", *[F.col("_first")[c].alias(c) for c in ("id", *fields)])


def complete_rounds(first: DataFrame, expected: int) -> DataFrame:
    got = first.groupBy("round").agg(F.count_distinct("client").alias("clients"))
    return got.withColumn("complete", F.col("clients") >= expected)
