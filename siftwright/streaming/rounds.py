"""Rounds in which clients report: first reports under a watermark, and rounds that close."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def first_reports(reports: DataFrame, clients: DataFrame, delay: str) -> DataFrame:
    """The first report to arrive of each known client in each round, of a stream ``reports(round,
    client, ts, ...)``.

    A report is late, and goes, once another of a time more than ``delay`` after its own has come
    in an earlier batch. Of a client's reports in a round the one of the first batch stays; its
    reports of one batch should be equal. State is kept for a client and round until no report
    within ``delay`` of the first can come, so a round must not be longer than that.
    """
    known = reports.join(clients.select("client").distinct(), "client", "left_semi")
    return known.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["round", "client"])


#: The store that keyed state with timers needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Rounds(StatefulProcessor):
    """Keeps, for an open round, the pairs of each client that has reported."""

    def __init__(self, expected: list[int], round_ms: int, limit_ms: int):
        self.expected, self.round_ms, self.limit_ms = set(expected), round_ms, limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.reported = handle.getMapState("reported", "client long", "pairs array<int>")
        self.closed = handle.getValueState("closed", "closed boolean")

    def _closing(self, number: int) -> pd.DataFrame:
        """The round's row. A pair is out unless every expected client has sent it."""
        sent = {k[0]: set(v[0]) for k, v in self.reported.iterator()}
        all_pairs = set().union(*sent.values()) if sent else set()
        whole = set.intersection(*(sent.get(c, set()) for c in self.expected))
        self.reported.clear()
        self.closed.update((True,))
        return pd.DataFrame({"round": [number], "complete": [len(sent) == len(self.expected)], "clients": [len(sent)], "excluded": [sorted(all_pairs - whole)]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        (number,) = key
        deadline = number * self.round_ms + self.limit_ms
        if self.closed.exists() or deadline <= timerValues.getCurrentWatermarkInMs():
            return
        if deadline not in list(self.handle.listTimers()):
            self.handle.registerTimer(deadline)
        batch = pd.concat(rows).sort_values(["ts", "id"])
        for at, client, pairs in zip(batch["ts"], batch["client"], batch["pairs"]):
            if client in self.expected and at.timestamp() * 1000 <= deadline and not self.reported.containsKey((client,)):
                self.reported.updateValue((client,), (list(pairs),))
        if sum(1 for _ in self.reported.keys()) == len(self.expected):
            yield self._closing(number)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        if not self.closed.exists():
            yield self._closing(key[0])
        self.closed.clear()

    def close(self) -> None:
        pass


def closed_rounds(messages: DataFrame, expected: list[int], round_ms: int, limit_ms: int, delay: str) -> DataFrame:
    """(round, complete, clients, excluded) for each round of a stream ``messages(id, ts, round,
    client, pairs)`` as it closes: when all ``expected`` clients have reported, or when the watermark
    passes ``limit_ms`` from the round's start, ``round * round_ms``. Only a client's first message
    in a round counts, by batch and then time, and only if it was sent within the limit and is not
    late. ``excluded`` are the pairs that some expected client has not sent by then.

    State is kept until the round's limit passes; what comes after that is let go, and a round of
    which nothing came before has no row. Needs the store ``STORE``."""
    ready = messages.filter("round IS NOT NULL AND client IS NOT NULL").select("id", "ts", "round", "client", F.coalesce("pairs", F.array().cast("array<int>")).alias("pairs"))
    return ready.withWatermark("ts", delay).groupBy("round").transformWithStateInPandas(
        statefulProcessor=_Rounds(expected, round_ms, limit_ms), outputStructType="round long, complete boolean, clients long, excluded array<int>", outputMode="Append", timeMode="EventTime",
    )
