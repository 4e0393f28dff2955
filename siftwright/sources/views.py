"""The labelled matrices that the registered queries work on: (row_id, client, y, features)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Clients that rows are dealt to by a key of theirs.
CLIENTS = 4
LI_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with their label; vectors that are null take no part."""
    return table(spark, sf_dir, "embeddings").filter("embedding IS NOT NULL AND label IS NOT NULL").select(
        F.col("vec_id").alias("row_id"), (F.col("vec_id") % CLIENTS).alias("client"), F.col("label").cast("int").alias("y"), F.col("embedding").cast("array<double>").alias("features")
    )


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five numbers of a line, with its return flag as the label, and no row id."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % CLIENTS).alias("client"), F.col("l_returnflag").alias("y"), F.array(*[F.col(c).cast("double") for c in LI_FEATURES]).alias("features")
    )


EMB_SQL = f"""emb AS (SELECT vec_id AS row_id, vec_id % {CLIENTS} AS client, label AS y, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS features FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
el AS (SELECT row_id, client, y, unnest(range(0, len(features))) AS feature, unnest(features) AS x FROM emb)"""
LI_SQL = f"""li AS (SELECT l_suppkey % {CLIENTS} AS client, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS y, [{', '.join(f'CAST({c} AS DOUBLE)' for c in LI_FEATURES)}] AS features FROM lineitem),
el AS (SELECT client, y, unnest(range(0, 5)) AS feature, unnest(features) AS x FROM li)"""
