"""Count tables that grow and shrink by contributions, without a look at old rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftwright.functions.shared import delete, folders
from siftwright.operators.information import mutual_information, shares

CELL = ("feature", "bin", "y")


def summed(*tables: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """The tables' sum by key; what sums to nothing is left out."""
    rows = None
    for table in tables:
        part = table.select(*keys, F.col(value).cast("long").alias(value))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(*keys).agg(F.sum(value).alias(value)).filter(F.col(value) != 0)


class CountStore:
    """Joint counts by client, their sum over clients, and the clients' numbers of rows, as tables in
    a folder, with a ledger of the contributions taken in.

    Each change makes a new version of the tables, out of the last one and the contribution alone, and
    then of the ledger, whose writing commits it. A contribution whose name the ledger holds is let go,
    so one that is sent again, or a batch that is replayed, changes nothing. A version is as large as
    the grid of clients, features, bins and classes, however many rows were counted; the last two are
    kept. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def version(self) -> int:
        return max((int(v) for v in folders(self.spark, f"{self.path}/ledger")), default=-1)

    def _read(self, what: str, schema: str) -> DataFrame:
        version = self.version()
        if version < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.path}/{what}/{version}")

    def ledger(self) -> DataFrame:
        """(name, client): the contributions taken in; client is null unless one was changed."""
        return self._read("ledger", "name string, client long")

    def by_client(self) -> DataFrame:
        return self._read("clients", "client long, feature int, bin int, y string, c long")

    def pooled(self) -> DataFrame:
        return self._read("pooled", "feature int, bin int, y string, c long")

    def sizes(self) -> DataFrame:
        return self._read("sizes", "client long, n long")

    def _commit(self, name: str, client: int | None, clients: DataFrame, pooled: DataFrame, sizes: DataFrame) -> None:
        version = self.version() + 1
        entry = self.spark.createDataFrame([(name, client)], "name string, client long")
        for what, table in (("clients", clients), ("pooled", pooled), ("sizes", sizes), ("ledger", self.ledger().unionByName(entry))):
            table.write.mode("overwrite").parquet(f"{self.path}/{what}/{version}")
        for what in ("ledger", "clients", "pooled", "sizes"):
            delete(self.spark, f"{self.path}/{what}/{version - 2}")

    def taken(self, name: str) -> bool:
        return bool(self.ledger().filter(F.col("name") == name).head(1))

    def add(self, name: str, rows: DataFrame) -> bool:
        """Counts ``rows(client, y, bins)`` in; false if a contribution of that name has been."""
        if self.taken(name):
            return False
        counts, sizes = contribution(rows)
        self._commit(
            name, None, summed(self.by_client(), counts, keys=("client", *CELL), value="c"), summed(self.pooled(), counts, keys=CELL, value="c"),
            summed(self.sizes(), sizes, keys=("client",), value="n"),
        )
        return True

    def withdraw(self, name: str, client: int) -> bool:
        """Takes a client's counts out of the sum, by its table."""
        return self._changed(name, client, None)

    def replace(self, name: str, client: int, rows: DataFrame) -> bool:
        """Puts ``rows`` in the place of all that a client has contributed."""
        return self._changed(name, client, rows.filter(F.col("client") == client))

    def _changed(self, name: str, client: int, rows: DataFrame | None) -> bool:
        if self.taken(name):
            return False
        other, own = self.by_client().filter(F.col("client") != client), self.by_client().filter(F.col("client") == client)
        pooled, sizes = [self.pooled(), own.withColumn("c", -F.col("c"))], [self.sizes().filter(F.col("client") != client)]
        clients = [other]
        if rows is not None:
            counts, n = contribution(rows)
            clients, pooled, sizes = [*clients, counts], [*pooled, counts], [*sizes, n]
        self._commit(
            name, client, summed(*clients, keys=("client", *CELL), value="c"), summed(*pooled, keys=CELL, value="c"), summed(*sizes, keys=("client",), value="n")
        )
        return True

    def information(self) -> DataFrame:
        """Information per feature, of all clients that are in."""
        return mutual_information(shares(self.pooled(), "feature"))

    def probabilities(self) -> DataFrame:
        """The clients' tables as ``combine`` takes them: (client, feature, bin, y, c, n, p)."""
        return self.by_client().join(self.sizes(), "client").withColumn("p", F.col("c") / F.col("n"))


def contribution(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Joint counts by client of ``rows(client, y, bins)``, and the clients' numbers of rows."""
    long = rows.select(F.col("client").cast("long").alias("client"), F.col("y").cast("string").alias("y"), F.posexplode_outer("bins").alias("feature", "bin")).filter("bin IS NOT NULL AND y IS NOT NULL")
    return long.groupBy("client", *CELL).agg(F.count("*").alias("c")), rows.groupBy(F.col("client").cast("long").alias("client")).agg(F.count("*").alias("n"))
