"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftwright.functions.shared import fresh_path, shared_dir, stored

__all__ = ["crc_of", "cut", "fresh_path", "keep_texts", "map_texts", "parallelism", "shared_dir", "stored", "table", "whole_runs"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materializes ``df`` in the shared folder, so that a lost executor costs no recomputation."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_of(col: str) -> Column:
    """crc32 of an id written as text: the folds of the operators that learn hang on it."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def map_texts(docs: DataFrame, make: Callable[[], Callable[[Iterable[str | None]], list[pa.Array]]], fields: str) -> DataFrame:
    """doc_id and what each text gives, without a shuffle.

    ``make()`` runs once a task; what it returns takes the texts of a batch and returns a column
    for each of ``fields``. Ids pass through Arrow untouched, whatever their type, nulls included.
    """
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, {fields}"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        work = make()
        for batch in batches:
            columns = work(value.as_py() for value in batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def keep_texts(docs: DataFrame, make: Callable[[], Callable[[str | None], bool]]) -> DataFrame:
    """The rows of ``docs`` whose text a task's predicate accepts; all columns stay as they are."""

    def run(batches):
        keep = make()
        for batch in batches:
            at = batch.schema.get_field_index("text")
            yield batch.filter(pa.array([keep(value.as_py()) for value in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def whole_runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole runs: rows that are equal in their first ``keys`` columns (integers, none
    null) and stand together stay together. A run is held until the next one begins."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(i).to_numpy() for i in range(keys)], 1)
        if held and any(held[-1].column(i)[-1].as_py() != columns[0, i] for i in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        starts = np.flatnonzero((columns[1:] != columns[:-1]).any(1)) + 1
        if len(starts):
            last = int(starts[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)
