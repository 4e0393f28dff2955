"""Roll-ups of run telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def client_phases(reports: DataFrame) -> DataFrame:
    """(client, phase, seconds) summed; reports without client or phase are dropped."""
    return reports.filter("client IS NOT NULL AND phase IS NOT NULL").groupBy("client", "phase").agg(F.sum(F.coalesce("seconds", F.lit(0.0))).alias("seconds"))


def slowest(phases: DataFrame) -> DataFrame:
    """(phase, seconds): the largest over clients."""
    return phases.groupBy("phase").agg(F.max("seconds").alias("seconds"))


def client_records(records: DataFrame) -> DataFrame:
    """(client, load, pre, compute, comm) summed over each client's ``records`` of these columns. A record
    that lacks its client, compute or comm is dropped whole; load or pre that it lacks count as 0."""
    whole = records.filter("CAST(client AS STRING) <> '' AND compute IS NOT NULL AND comm IS NOT NULL")
    return whole.groupBy("client").agg(*[F.sum(F.coalesce(c, F.lit(0.0))).alias(c) for c in ("load", "pre", "compute", "comm")])


def other_time(total: Column, compute: Column, comm: Column, pre: Column, agg: Column, mi: Column) -> Column:
    """What the clients' phases leave of a run's time, at least 0, less the server's own; this may be
    negative."""
    return F.greatest(F.lit(0.0), total - compute - comm - pre) - (agg + mi)


def profile(records: DataFrame, server: DataFrame, span: DataFrame) -> DataFrame:
    """One row of a run's times: (load, pre, compute, comm, agg, mi, total, others).

    The first four are those of the slowest client, each by itself, and 0 without clients. agg and mi are
    the sums of ``server(phase, seconds)``, 0 if there are none. ``total`` is the run's ``span(span)`` in seconds
    without loading, and ``others`` what is left of it.
    """
    slow = client_records(records).agg(*[F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in ("load", "pre", "compute", "comm")])
    own = server.agg(*[F.coalesce(F.sum(F.when(F.col("phase") == c, F.col("seconds"))), F.lit(0.0)).alias(c) for c in ("agg", "mi")])
    rows = slow.join(F.broadcast(own)).join(F.broadcast(span))  # a row each
    rows = rows.withColumn("total", F.coalesce("span", F.lit(0.0)) - F.col("load"))
    others = other_time(*[F.col(c) for c in ("total", "compute", "comm", "pre", "agg", "mi")])
    return rows.select("load", "pre", "compute", "comm", "agg", "mi", "total", others.alias("others"))


def last_energy(reports: DataFrame) -> DataFrame:
    """(client, kwh, co2_kg) of each client's last report that has its client and energy; later ids win
    ties in time. A report without co2_kg counts as none."""
    good = reports.filter("client IS NOT NULL AND kwh IS NOT NULL")
    last = F.max_by(F.struct("kwh", F.coalesce("co2_kg", F.lit(0.0)).alias("co2_kg")), F.struct("ts", "id"))
    return good.groupBy("client").agg(last.alias("_l")).select("client", "_l.kwh", "_l.co2_kg")


def total_energy(last: DataFrame, server_kwh: float = 0.0, server_co2_kg: float = 0.0) -> DataFrame:
    """(clients, kwh, co2_kg): the clients' and the server's together."""
    of = lambda c, own: (F.coalesce(F.sum(c), F.lit(0.0)) + own).alias(c)
    return last.agg(F.count("*").alias("clients"), of("kwh", server_kwh), of("co2_kg", server_co2_kg))
