"""Feature selection: MIM and greedy JMI, pooled or from clients' tables.

Ties, to nine decimals, go to the lowest feature. JMI is sequential; its scores come from one pass
over all pairs, or, for wide rows, from one aggregation per round with the last feature chosen.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from siftwright.operators import counts as C
from siftwright.operators.information import mutual_information, shares
from siftwright.operators.pairs import PAIRS, information_matrix

PAIR = ("k", "j")


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """(rank, feature, score); the window is over the k rows that remain."""
    best = scores.select("feature", F.col("mi").alias("score")).withColumn("_r", F.round("score", 9)).orderBy(F.desc("_r"), "feature").limit(k)
    return best.select(F.row_number().over(Window.orderBy(F.desc("_r"), "feature")).alias("rank"), "feature", "score")


def _scores(rows: DataFrame, bins: int, combined: str | None, clients: int) -> DataFrame:
    if combined is None:
        return mutual_information(shares(C.joint_counts(rows, bins=bins), "feature"))
    probs = C.probabilities(C.joint_counts(rows, "client", bins=bins), rows)
    return mutual_information(C.combine(probs, clients, combined == "weighted"))


def _pair_scores(rows: DataFrame, j: int, bins: int, combined: str | None, clients: int) -> DataFrame:
    if combined is None:
        table = shares(C.pair_counts(rows, j, bins=bins), *PAIR)
    else:
        probs = C.probabilities(C.pair_counts(rows, j, "client", bins=bins), rows)
        table = C.combine(probs, clients, combined == "weighted", unit=PAIR)
    return mutual_information(table, PAIR, ("bin_k", "bin_j"))


def _clients(rows: DataFrame, combined: str | None) -> int:
    return rows.select("client").distinct().count() if combined else 0


def mim(rows: DataFrame, k: int, bins: int = 5, combined: str | None = None) -> DataFrame:
    """The k features of most information. Pooled, features without information count too; from
    clients' tables ("simple" or "weighted") they do not, so fewer than k may come."""
    scores = _scores(rows, bins, combined, _clients(rows, combined))
    return top_k(scores.filter("mi > 0") if combined else scores, k)


def greedy(single: dict[int, float], pairs_with: Callable[[int], dict[int, float]], k: int, positive: bool) -> list[tuple[int, int, float]]:
    """(rank, feature, score): the feature of most information, then k - 1 times the one whose pairs
    with those chosen sum to most. ``pairs_with(j)`` gives the information of pairs with j; a feature
    without one is out. With ``positive``, nothing is chosen unless some feature has information."""
    out: list[tuple[int, int, float]] = []
    if not single or positive and max(single.values()) <= 0:
        return out
    best = max(single, key=lambda f: (round(single[f], 9), -f))
    out.append((1, best, float(single[best])))
    total = {f: 0.0 for f in single if f != best}
    while len(out) < k and total:
        pairs = pairs_with(out[-1][1])
        total = {f: s + pairs[f] for f, s in total.items() if f in pairs}
        if not total:
            break
        best = max(total, key=lambda f: (round(total[f], 9), -f))
        out.append((len(out) + 1, best, float(total.pop(best))))
    return out


def jmi(rows: DataFrame, k: int, bins: int = 5, combined: str | None = None, all_pairs: bool | None = None) -> DataFrame:
    """Greedy joint mutual information over ``rows(client?, y, bins)``: (rank, feature, score).

    Each round adds the pairs' information with the last choice to every candidate's sum. From
    clients' tables, a candidate whose pair table some client lacks is out, and nothing is
    selected if no feature has information.

    Rows of up to ``pairs.PAIRS`` features give all pairs' information in one pass, a number for each
    on the driver; for wider ones each round is an aggregation with the last choice. ``all_pairs``
    picks the way.
    """
    spark = rows.sparkSession
    width = (rows.select(F.size("bins").alias("n")).first() or {"n": 0})["n"]
    if all_pairs or all_pairs is None and width <= PAIRS:
        table: dict[int, dict[int, float]] = {}
        for r in information_matrix(rows, width, bins, combined).collect() if width > 0 else []:
            table.setdefault(r["k"], {})[r["j"]] = r["mi"]
            table.setdefault(r["j"], {})[r["k"]] = r["mi"]
        out = greedy({f: of[f] for f, of in sorted(table.items()) if f in of}, lambda j: table[j], k, bool(combined))
    else:
        rows = rows.persist()
        clients = _clients(rows, combined)
        single = {r["feature"]: r["mi"] for r in _scores(rows, bins, combined, clients).collect()}
        out = greedy(single, lambda j: {r["k"]: r["mi"] for r in _pair_scores(rows, j, bins, combined, clients).collect()}, k, bool(combined))
        rows.unpersist()
    return spark.createDataFrame(out, "rank int, feature int, score double")


def select(rows: DataFrame, method: str, k: int, bins: int = 5, combined: str | None = None) -> DataFrame:
    ways = {"MIM": mim, "JMI": jmi}
    if method.upper() not in ways:
        raise ValueError(f"unknown method: {method}")
    return ways[method.upper()](rows, k, bins, combined)


def candidates(features: DataFrame, selected: DataFrame) -> DataFrame:
    return features.select("feature").join(selected, "feature", "left_anti")


def agreement(ideal: DataFrame, evaluated: DataFrame, k: int = 0) -> DataFrame:
    """(overlap, k, tpr): shared features over k, or over the number of ideal ones if k is 0.
    If that is 0 too, it is an error."""
    ideal = ideal.select("feature").distinct()
    size = k or ideal.count()
    if not size:
        raise ValueError("no ideal features and no k")
    both = ideal.intersect(evaluated.select("feature"))
    return both.agg(F.count("*").alias("overlap")).select("overlap", F.lit(size).cast("long").alias("k"), (F.col("overlap") / size).alias("tpr"))
