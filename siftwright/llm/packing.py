"""Packing into optimal length buckets.

One aggregation makes the global histogram of lengths. Dynamic programming over it chooses the
bucket boundaries that minimise padding, and token-budget batches form inside each bucket: as many
documents as fit the budget when each is padded to the bucket's boundary.

The histogram is bounded: lengths up to ``EXACT`` count singly, longer ones in cells of relative
width 1 / (EXACT / 2), so the driver holds at most EXACT / 2 cells for each further doubling. A cell
carries its longest length, and only cells' longest lengths are boundaries: the padding is minimal
up to a length of EXACT, and beyond it within one part in EXACT / 2 of the padded tokens.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from siftwright.llm.common import stored

EXACT = 1 << 16
#: Padded tokens of a batch, and the number of buckets.
TOKEN_BUDGET, BUCKETS = 8192, 12
#: Mean documents of a chunk, the unit in which documents of a bucket are numbered; one of more than
#: LARGE times as many is split.
CHUNK_ROWS, LARGE = 10_000, 4

WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def on_grid(n: Column) -> Column:
    """The smallest grid point that is not below a length."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(n, F.lit(1)))) - (EXACT.bit_length() - 2))
    return F.when(n <= EXACT, n).otherwise((F.ceil(n / step) * step).cast("long"))


def boundaries(cells: list[tuple[int, int, int]], buckets: int) -> list[int]:
    """Boundaries of at most ``buckets`` buckets that minimise padding.

    cells: (longest length, documents, their tokens), by length. A bucket's boundary is its longest
    length; its padding is boundary times documents less tokens. Of equal choices the one with
    fewer buckets, then the lower boundaries, wins.

    The best start of a bucket does not fall as its end rises, so each half of the ends searches
    its part of the starts only.
    """
    if not cells:
        return []
    at, count, tokens = (np.array(x, dtype=np.float64) for x in zip(*cells))
    c, t = np.concatenate([[0.0], np.cumsum(count)]), np.concatenate([[0.0], np.cumsum(tokens)])
    n, back = len(cells), []
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    finals = []
    for k in range(1, min(buckets, n) + 1):
        new, came = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
        todo = [(k, n, k - 1, n - 1)]
        while todo:
            low, high, first, last = todo.pop()
            if low > high:
                continue
            j = (low + high) // 2
            i = slice(first, min(last, j - 1) + 1)
            cost = best[i] + at[j - 1] * (c[j] - c[i]) - (t[j] - t[i])
            came[j] = first + int(np.argmin(cost))
            new[j] = cost[came[j] - first]
            todo += [(low, j - 1, first, int(came[j])), (j + 1, high, int(came[j]), last)]
        back.append(came)
        finals.append(new[n])
        best = new
    k, j, out = int(np.argmin(finals)), n, []
    while j > 0:
        out.append(int(at[j - 1]))
        j = int(back[k][j])
        k -= 1
    return out[::-1]


def pack(docs: DataFrame, length: Column | None = None, budget: int = TOKEN_BUDGET, buckets: int = BUCKETS) -> DataFrame:
    """Assigns each row of ``docs(doc_id, text)`` a place in a batch.

    Returns doc_id, n_tokens, bucket (from 0, by length), boundary (padded length), batch_id (a
    global number), slot (from 0), pad (boundary less n_tokens). ``length`` defaults to the number
    of words. A null or empty text has length 0 and is packed like any other. A text longer than
    the budget has a batch of its own and stays whole. Within a bucket the order is that of a hash
    of the id, so a batch mixes sources; rows that repeat an id and a length, or have no id, are
    interchangeable, and where they are many they are spread by their place in the input. An empty
    table gives an empty table.
    """
    n = length if length is not None else word_count(F.col("text"))
    place = F.monotonically_increasing_id().alias("place")
    sized = stored(docs.select("doc_id", n.alias("n_tokens"), place).withColumn("grid", on_grid(F.col("n_tokens"))), "lengths")
    cells = sorted(tuple(r)[1:] for r in sized.groupBy("grid").agg(F.max("n_tokens"), F.count("*"), F.sum("n_tokens")).collect())
    bounds = boundaries(cells, buckets) or [0]
    caps = [max(1, budget // max(1, b)) for b in bounds]
    held = [sum(c for g, c, _ in cells if low < g <= b) for low, b in zip([-1, *bounds], bounds)]
    batches = [0, *np.cumsum([-(-h // cap) for h, cap in zip(held, caps)]).tolist()]
    chunks = max(1, -(-sum(held) // CHUNK_ROWS))

    bucket = sum((F.col("n_tokens") > b).cast("int") for b in bounds[:-1]) if len(bounds) > 1 else F.lit(0)
    of = lambda values: F.get(F.array(*[F.lit(v).cast("long") for v in values]), F.col("bucket"))
    placed = sized.select("doc_id", "n_tokens", bucket.alias("bucket"), F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(chunks)).alias("chunk"), "place")
    large = placed.groupBy("bucket", "chunk").agg(F.count("*").alias("rows")).filter(F.col("rows") > LARGE * CHUNK_ROWS)
    if large.isEmpty():
        placed = placed.withColumn("part", F.lit(0).cast("long"))
    else:
        parts = large.select("bucket", "chunk", F.ceil(F.col("rows") / CHUNK_ROWS).alias("parts"))
        placed = placed.join(parts, ["bucket", "chunk"], "left").withColumn("part", F.pmod("place", F.coalesce("parts", F.lit(1).cast("long"))))
    unit = ["bucket", "chunk", "part"]
    before = Window.partitionBy("bucket").orderBy("chunk", "part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*unit).agg(F.count("*").alias("rows"))
    offsets = counts.select(*unit, F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy(*unit).orderBy("doc_id", "n_tokens", "place")) - 1)
    joined = ranked.join(offsets, unit).withColumn("rank", F.col("rank") + F.col("before"))
    return joined.select(
        "doc_id", "n_tokens", "bucket", of(bounds).alias("boundary"),
        (of(batches[:-1]) + F.floor(F.col("rank") / of(caps))).alias("batch_id"),
        F.pmod(F.col("rank"), of(caps)).alias("slot"),
        (of(bounds) - F.col("n_tokens")).alias("pad"),
    )
