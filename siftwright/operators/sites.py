"""Assignment of rows to clients."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from siftwright.functions.expressions import seeded_order
from siftwright.functions.shared import stored
from siftwright.operators.order import sections


def global_rank(rows: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """Numbers rows from 0 in a global order that must be total.

    Rows are range-partitioned and sorted once; a task's rows follow those of the tasks before it,
    so only the tasks' counts are put together, and no task sees all rows.
    """
    spark = rows.sparkSession
    spread = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    line = stored(spread.withColumn("_id", F.monotonically_increasing_id()), "ranked")
    line = line.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = line.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return line.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_at") + F.col("_before")).drop("_id", "_part", "_at", "_before", "_n")


def assigned(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """``rows`` with the client that ``owners(row_id, client)`` names; others are left out."""
    return rows.drop("client").join(owners.select("row_id", "client"), "row_id")


def iid(rows: DataFrame, clients: int, seed: int = 0) -> DataFrame:
    """Equal shares in a seeded random order; what does not divide gets no client and is left out. Rows
    do not move: fences in the order tell their clients."""
    shares = lambda n: [n // clients * i for i in range(1, clients + 1)]
    return sections(rows, seeded_order(seed, "row_id"), shares, name="client").withColumn("client", F.col("client").cast("long")).filter(F.col("client") < clients)


def label_shards(rows: DataFrame, clients: int, owners: list[int] | None = None, seed: int = 0) -> DataFrame:
    """Two label-sorted shards per client. Rows that do not fill the shards, the last by row_id,
    are left out before the sort. ``owners`` names each shard's client; else a seed deals them."""
    if owners is None:
        owners = np.random.default_rng(seed).permutation(np.repeat(np.arange(clients), 2)).tolist()
    size = rows.count() // (2 * clients)
    if not size:
        return rows.limit(0).withColumn("client", F.lit(0).cast("long"))
    whole = global_rank(rows, "row_id").filter(F.col("place") < size * 2 * clients).drop("place")
    ranked = global_rank(whole, "y", "row_id").withColumn("shard", F.floor(F.col("place") / size).cast("int"))
    return ranked.withColumn("client", F.get(F.array(*map(F.lit, owners)), F.col("shard")).cast("long")).drop("place", "shard")


def quotas(total: int, clients: int, unevenness: float = 0.5, seed: int = 0) -> list[int]:
    """Rows of each client, which sum to ``total``: equal ones if unevenness is 0, else shares
    drawn around 1, rounded by largest remainder."""
    if clients < 1:
        raise ValueError("clients must be positive")
    if unevenness <= 0 or clients == 1:
        return [total // clients + (i < total % clients) for i in range(clients)]
    floor = 0.0 if total < clients else 0.01
    weights = np.random.default_rng(seed).uniform(max(floor, 1 - unevenness), 1 + unevenness, clients)
    exact = weights / weights.sum() * total
    base = np.floor(exact).astype(int)
    for i in np.argsort(base - exact, kind="stable")[: total - base.sum()]:
        base[i] += 1
    return base.tolist()


def label_blocks(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """Contiguous blocks of the label order, of the given sizes; every row is assigned."""
    ends = np.cumsum(sizes).tolist()
    ranked = global_rank(rows, "y", "row_id")
    before = sum((F.col("place") >= e).cast("long") for e in ends[:-1]) if len(ends) > 1 else F.lit(0).cast("long")
    return ranked.withColumn("client", before).drop("place")


def by_subject(rows: DataFrame) -> DataFrame:
    """A client per subject, in sorted order; rows without subject have none and are left out."""
    known = global_rank(rows.select("subject").filter("subject IS NOT NULL").distinct(), "subject", name="client")
    return rows.join(known, "subject")


def assign(rows: DataFrame, strategy: str, clients: int, unevenness: float = 0.0, seed: int = 0) -> DataFrame:
    if strategy == "subject":
        return by_subject(rows)
    if strategy == "iid":
        return iid(rows, clients, seed)
    if strategy == "non-iid":
        return label_blocks(rows, quotas(rows.count(), clients, unevenness, seed)) if unevenness > 0 else label_shards(rows, clients, seed=seed)
    raise ValueError(f"unknown strategy: {strategy}")


def dispersion(rows: DataFrame) -> DataFrame:
    """(client, label, c) over all clients and labels, zeros included. Clients and labels are
    distinct sets of a few rows, so their grid is small."""
    seen = rows.groupBy("client", F.col("y").cast("string").alias("label")).agg(F.count("*").alias("c"))
    labels = seen.select("label").distinct().agg(F.collect_list("label").alias("all"))
    grid = seen.select("client").distinct().join(F.broadcast(labels)).select("client", F.explode("all").alias("label"))
    return grid.join(seen, ["client", "label"], "left").select("client", "label", F.coalesce("c", F.lit(0)).alias("c"))
