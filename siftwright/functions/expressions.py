"""Column expressions and the same expressions as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Probabilities at or below this count as zero.
TINY = 1e-12


def bin_of(x: Column, mn: Column, mx: Column, bins: int) -> Column:
    """Equal-width bin of ``x``: left-closed intervals, the last one closed, values outside
    clamped, one bin if the range is a point; null stays null and NaN goes to the last bin.

    Edges are ``mn + i * step`` with ``step = (mx - mn) / bins``, in this order of operations, so
    that values on an edge fall where a linear space of edges puts them.
    """
    step = (mx - mn) / F.lit(float(bins))
    above = F.lit(0)
    for i in range(1, bins):
        above = above + F.when(x >= mn + F.lit(float(i)) * step, 1).otherwise(0)
    return F.when(x.isNull() | mn.isNull(), None).when(mn == mx, 0).when(x >= mx, bins - 1).otherwise(above).cast("int")


def bin_sql(x: str, mn: str, mx: str, bins: int) -> str:
    above = " + ".join([f"(CASE WHEN {x} >= {mn} + {float(i)} * (({mx} - {mn}) / {float(bins)}) THEN 1 ELSE 0 END)" for i in range(1, bins)] or ["0"])
    return f"CAST(CASE WHEN {x} IS NULL OR {mn} IS NULL THEN NULL WHEN {mn} = {mx} THEN 0 WHEN {x} >= {mx} THEN {bins - 1} ELSE {above} END AS BIGINT)"


def seeded_order(seed: int, col: str) -> Column:
    """A reproducible random order of rows: sort by this, then by ``col``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(col).cast("string")))
