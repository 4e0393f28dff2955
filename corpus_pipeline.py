"""A corpus pipeline: what it keeps of ``documents``, packed into batches.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftwright.llm import language_id, near_dedup, packing, quality, secret_scan
from siftwright.llm.common import stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    A null or empty text is scored as padding, like any other. Rows are judged one by one, so those
    that repeat or have no id need no care; a score of exactly a half is kept. No rows give none.
    """
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear.

    A text that is null or has no letter has no language and goes; so does a tie. Rows are judged one
    by one. No rows, or none with a label, give none.
    """
    return language_id.accepted(docs, language_id.dictionaries(docs))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: shingles of five words, similarity 0.8.

    Rows whose text is null, empty or without words stay, all of them. No rows give none.

    It is the row with the smallest doc_id, a null one last. Rows are told apart by numbers of
    their own, stored with them, so rows that repeat an id, or have none, are kept or dropped each
    for itself.
    """
    rows = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "pipeline-rows")
    own = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))
    dropped = near_dedup.near_duplicates(rows.select(own.alias("doc_id"), "text")).filter("NOT kept").select(F.col("doc_id.row").alias("_row"))
    return rows.join(dropped, "_row", "left_anti").select(docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced by a mark; a null text stays null."""
    clean = secret_scan.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A place in a batch for each document, null and empty texts (of length 0) included."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_dedup", dedup_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: Learned models decide in the first two stages, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
