"""Approximate nearest neighbours over shifted space-filling curves.

Each curve turns all vectors by a rotation of its own, keeps a few coordinates, shifts the grid,
and orders the vectors along a Hilbert curve. The order is cut into key ranges; a query looks at a
window of its neighbours in each order, range by range. What the windows hold is scored on the
original vectors, merged and reranked.

Nearness is the inner product. Vectors get one more coordinate that makes them equally long, so
that the nearest by distance are the nearest by product.

How many curves there are and how wide a window is are fitted: a few queries are answered exactly,
over all rows, and the cheapest choice whose windows hold the wanted share of their neighbours is
taken. Vectors of low inner dimension need narrow windows, which get narrower as the table grows;
vectors without any structure need wide ones, whatever the index.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from siftwright.llm.common import parallelism, stored, table

#: Numbers of orders to choose from, coordinates of each, bits of a coordinate.
CURVES, DIMS, BITS, SEED = (3, 6, 12, 24), 4, 10, 3
#: Share of the fitted queries' neighbours that windows must hold.
RECALL = 0.95
#: Vectors (expected) that key ranges and windows are fitted on, and queries answered exactly.
SAMPLE, SAMPLE_QUERIES = 32_768, 64
#: Comparisons that cost as much as moving a vector to one more order.
COPY = 200
#: Vectors of a key range and queries compared with it at once, at most; vectors of one at least.
BLOCK, QUERIES, FEW = 8192, 4096, 256


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each row of non-negative grid cells.

    The usual transform: undo the excess work of each bit from the top, Gray-encode, then
    interleave the bits of all coordinates.
    """
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[:, i] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(high, low, swap)
            if i:
                x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[:, n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= turn[:, None]
    key = np.zeros(len(x), dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | x[:, i] >> b & 1
    return key


class Curves:
    """The orders: rotations and shifts drawn from a seed. The first coordinate may be the one
    that evens out lengths, so it is part of what is turned."""

    def __init__(self, dims: int, longest: float):
        rng = np.random.default_rng(SEED)
        self.longest, kept = longest or 1.0, min(DIMS, dims + 1)
        self.turns = [np.linalg.qr(rng.normal(size=(dims + 1, kept)))[0] for _ in range(max(CURVES))]
        self.shifts = rng.random((max(CURVES), kept))
        #: Coordinates of a unit vector in so many dimensions spread like this.
        self.spread = 3.0 / np.sqrt(dims + 1)

    def keys(self, vectors: np.ndarray, curve: int, query: bool) -> np.ndarray:
        v = np.zeros((len(vectors), vectors.shape[1] + 1))
        norm = np.linalg.norm(vectors, axis=1)
        if query:
            v[:, :-1] = vectors / norm[:, None]
        else:
            v[:, :-1] = vectors / self.longest
            v[:, -1] = np.sqrt(np.maximum(0, 1 - (norm / self.longest) ** 2))
        span = 1 << BITS
        at = (v @ self.turns[curve] / self.spread + 1) / 2 * (span - 1) + self.shifts[curve]
        return hilbert(np.clip(np.floor(at), 0, span - 1), BITS)


@dataclass
class Fit:
    """An index: the number of curves, half the width of a window as a share of all rows, and for
    each curve the keys of the sample, in order, the bounds of its ranges and the parts of each."""

    curves: int
    half: float
    share: float
    sample: list[np.ndarray] = field(repr=False)
    bounds: list[np.ndarray] = field(repr=False)
    parts: list[np.ndarray] = field(repr=False)

    def window(self, curve: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last range of each query's window."""
        ordered = self.sample[curve]
        middle = np.clip(_quantile(ordered, keys), self.half, 1 - self.half)
        ends = [np.floor((middle + d) * (len(ordered) - 1)).astype(np.int64) for d in (-self.half, self.half)]
        low, high = (np.searchsorted(self.bounds[curve], ordered[np.clip(e, 0, len(ordered) - 1)], "right") for e in ends)
        own = np.searchsorted(self.bounds[curve], keys, "right")
        low = np.where(middle <= self.half, 0, np.minimum(low, own))  # rows may lie beyond the sample's ends
        return low, np.where(middle >= 1 - self.half, len(self.bounds[curve]), np.maximum(high, own))


def _quantile(ordered: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return (np.searchsorted(ordered, keys, "left") + np.searchsorted(ordered, keys, "right")) / (2 * len(ordered))


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>) of the rows that take part: ids and vectors that are not
    null, finite throughout, and not zero. A vector shorter than the longest is filled with zeros."""
    base = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id IS NOT NULL AND embedding IS NOT NULL")
    finite = base.filter(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0))
    dims = finite.agg(F.max(F.size("embedding"))).first()[0] or 0
    filled = F.concat("embedding", F.array_repeat(F.lit(0.0), F.lit(dims) - F.size("embedding")))
    return finite.select("vec_id", F.transform(filled, lambda x: x + F.lit(0.0)).alias("embedding"))  # no negative zeros


def _vectors(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _some(rows: DataFrame, salt: int, share: float) -> DataFrame:
    """A share of the rows, by a hash of their points."""
    return rows.filter(F.pmod(F.xxhash64("point", F.lit(salt)), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30)))


def nearest_of(points: DataFrame, asked: np.ndarray, own: np.ndarray, k: int) -> DataFrame:
    """(query, vector): the k points nearest to each of a few vectors, over all rows; ``own`` has
    their points. Each task keeps the k best of each."""

    def run(batches):
        best = [(np.zeros(0), np.zeros((0, asked.shape[1])))] * len(asked)
        for batch in batches:
            ids, near = batch.column(0).to_numpy(), _vectors(batch.column(1))
            scores = asked @ near.T
            scores[own[:, None] == ids[None]] = -np.inf
            for q in range(len(asked)):
                top = np.argpartition(-scores[q], min(k, len(ids)) - 1)[:k] if len(ids) else []
                score, vector = np.concatenate([best[q][0], scores[q][top]]), np.concatenate([best[q][1], near[top]])
                order = np.argsort(-score)[:k]
                best[q] = score[order], vector[order]
        query = np.repeat(np.arange(len(asked), dtype=np.int32), [len(b[0]) for b in best])
        score, vector = np.concatenate([b[0] for b in best]), np.concatenate([b[1] for b in best])
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(score), pa.array(list(vector), pa.list_(pa.float64()))], names=["query", "score", "vector"])

    found = points.select("point", "embedding").mapInArrow(run, "query int, score double, vector array<double>").filter(F.col("score") > float("-inf"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
    return found.withColumn("place", place).filter(F.col("place") <= k).select("query", "vector")


def fit(points: DataFrame, k: int, recall: float = RECALL) -> tuple[Curves, Fit]:
    """Fits the index on a sample of about SAMPLE points and about SAMPLE_QUERIES queries of
    ``points(point, embedding, asked)``, and the exact neighbours of those. Costs are of comparisons
    and of copies. If no windows hold enough, they hold all; in any case they hold more rows than k."""
    head = points.agg(F.count("*").alias("n"), F.count_if("asked").alias("q"), F.max(F.size("embedding")).alias("dims"), F.sqrt(F.max(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))).alias("longest")).first()
    total, queries = head["n"], head["q"]
    curves = Curves(head["dims"] or 1, head["longest"] or 1.0)
    some = _vectors(_some(points, 1, SAMPLE / max(1, total)).select("embedding").toArrow().column(0))
    ask = _some(points.filter("asked"), 2, SAMPLE_QUERIES / max(1, queries)).select("point", "embedding").toArrow()
    asked = _vectors(ask.column(1))
    sample = [np.sort(curves.keys(some, c, False)) if some.shape[0] else np.zeros(1, dtype=np.int64) for c in range(max(CURVES))]
    count, half = CURVES[0], 0.5
    if len(asked):
        near = nearest_of(points, asked, ask.column(0).to_numpy(), k).toArrow()
        if near.num_rows:
            of, vectors = near.column(0).to_numpy(), _vectors(near.column(1))
            place = np.stack([_quantile(sample[c], curves.keys(vectors, c, False)) for c in range(max(CURVES))])
            middle = np.stack([_quantile(sample[c], curves.keys(asked, c, True))[of] for c in range(max(CURVES))])
            halves = np.geomspace(2 / len(sample[0]), 0.5, 60)
            held = np.stack([np.abs(place - np.clip(middle, h, 1 - h)) <= h for h in halves])  # half, curve, pair
            best = np.inf
            for n in CURVES:
                enough = np.flatnonzero(held[:, :n].any(1).mean(1) >= recall)
                h = halves[enough[0]] if len(enough) else 0.5
                if n * (2 * h * queries + COPY) < best:
                    best, count, half = n * (2 * h * queries + COPY), n, float(h)
    half = min(0.5, max(half, 2 * k / max(1, total)))  # never fewer rows than are asked for
    ranges = int(min(np.ceil(max(total / BLOCK, min(total / FEW, 2 * parallelism(points.sparkSession) / count))), len(sample[0]) / 8)) or 1
    bounds = [s[np.arange(1, ranges) * len(s) // ranges] for s in sample[:count]]
    mass = [np.bincount(np.searchsorted(b, s, "right"), minlength=ranges) / len(s) for b, s in zip(bounds, sample)]
    return curves, Fit(count, half, min(1.0, 2 * half) * count, sample[:count], bounds, [np.maximum(1, np.ceil(m * total / (2 * BLOCK))).astype(np.int64) for m in mass])


def search(rows: DataFrame, k: int = 20, every: int = 20, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every``, the k
    nearest other rows that its windows hold, all of them if there are fewer; nearest first, ties
    to the smaller vec_id.

    Rows with a null id, or a vector that is null, zero or has a null or non-finite component, take
    no part; a vector shorter than the longest counts as filled with zeros. Equal vectors are one
    class, searched once; a class keeps the k + 1 smallest of its ids, and no other member can be
    among a query's k nearest. So a vector that a third of all rows repeat costs no more than
    another. Scores are sums in double precision in the order of the components. Rows that repeat
    an id are vectors of their own. An empty table gives none.
    """
    spark = rows.sparkSession
    base = usable(rows)
    parts = parallelism(spark)
    kind = "float" if dict(rows.dtypes)["embedding"] == "array<float>" else "double"  # what travels to the orders
    first = Window.partitionBy("embedding").orderBy("vec_id")
    few = base.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1)
    classes = few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
    asked = base.filter(F.col("vec_id") % every == 0).select("embedding").distinct().withColumn("asked", F.lit(True))
    points = stored(classes.join(asked, "embedding", "left").select(F.monotonically_increasing_id().alias("point"), "embedding", "members", F.coalesce("asked", F.lit(False)).alias("asked")), "points")
    curves, index = fit(points, k, recall)
    chunks = max(1, -(-int(points.filter("asked").count() * min(1.0, 2 * index.half)) // QUERIES))

    def placed(batches):
        """Each vector in its range of each order; each query in all ranges of its windows."""
        for batch in batches:
            vectors, ask = _vectors(batch.column(2)), np.asarray(batch.column(3).to_numpy(zero_copy_only=False), dtype=bool)
            small, point = batch.column(2).cast(pa.list_(pa.float32() if kind == "float" else pa.float64())), batch.column(0).to_numpy()
            at, of = np.arange(len(vectors)), np.flatnonzero(ask)
            for c in range(index.curves):
                own = np.searchsorted(index.bounds[c], curves.keys(vectors, c, False), "right")
                yield rows_of(batch, small, c, at, own, point % index.parts[c][own], False)
                if len(of):
                    low, high = index.window(c, curves.keys(vectors[of], c, True))
                    ends = np.concatenate([[0], np.cumsum(index.parts[c])])
                    n = ends[high + 1] - ends[low]
                    cell = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ends[low], n)
                    block = np.searchsorted(ends, cell, "right") - 1
                    yield rows_of(batch, small, c, np.repeat(of, n), block, cell - ends[block], True)

    def rows_of(batch, vectors, curve, at, block, part, query):
        take = pa.array(at)
        flags = [pa.array(np.full(len(at), curve, dtype=np.int32)), pa.array(block.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(np.full(len(at), query))]
        return pa.RecordBatch.from_arrays([*flags, *(x.take(take) for x in (batch.column(0), batch.column(1), vectors))], names=["curve", "block", "part", "query", "point", "first", "vector"])

    start = points.select("point", F.col("members")[0].cast("long").alias("first"), "embedding", "asked")
    line = start.mapInArrow(placed, f"curve int, block int, part int, query boolean, point long, first long, vector array<{kind}>")
    line = stored(line, "orders")
    spread = lambda flag, chunk: line.filter(flag).withColumn("chunk", chunk).groupBy("curve", "block", "part", "chunk")
    data = spread("NOT query", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    ask = spread("query", F.pmod(F.xxhash64("point"), F.lit(chunks)).cast("int"))

    def compare(mine: pa.Table, asking: pa.Table) -> pa.Table:
        out = {"query": [], "point": [], "first": [], "score": []}
        if mine.num_rows and asking.num_rows:
            ids, first, near = mine.column("point").to_numpy(), mine.column("first").to_numpy(), _vectors(mine.column("vector"))
            longest = np.linalg.norm(near, axis=1).max()
            for at in range(0, asking.num_rows, 256):
                part = asking.slice(at, 256)
                vectors = _vectors(part.column("vector"))
                scores = vectors @ near.T
                keep = min(k + 1, len(ids))
                least = np.partition(scores, len(ids) - keep, axis=1)[:, len(ids) - keep]
                for q, vector, row, low in zip(part.column("point").to_pylist(), vectors, scores, least):
                    top = np.flatnonzero(row >= low - 1e-9 * np.linalg.norm(vector) * longest)
                    exact = np.cumsum(near[top] * vector, axis=1)[:, -1]  # in the order of the components
                    order = np.lexsort((first[top], -exact))[:keep]
                    out["query"].append(np.full(len(order), q))
                    out["point"].append(ids[top[order]])
                    out["first"].append(first[top[order]])
                    out["score"].append(exact[order])
        empty = [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
        return pa.table({"query": np.concatenate(empty[0] + out["query"]), "point": np.concatenate(empty[0] + out["point"]), "first": np.concatenate(empty[0] + out["first"]), "score": np.concatenate(empty[1] + out["score"])})

    found = data.cogroup(ask).applyInArrow(compare, "query long, point long, first long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "first")
    merged = found.repartition(parts, "query").groupBy("query", "point").agg(F.max("score").alias("score"), F.min("first").alias("first"))
    short = merged.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).select("query", "point")

    # the scores that are returned come from one expression, whatever range or curve found a pair
    left = points.select(F.col("point").alias("query"), F.col("embedding").alias("q"))
    scored = short.join(left, "query").join(points.select("point", "members", F.col("embedding").alias("v")), "point")
    near = scored.select("query", product("q", "v").alias("score"), F.explode("members").alias("vec_id"))
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).filter(F.col("n") <= k + 1)
    lists = near.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("near"))
    asking = base.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding").join(points.select("embedding", F.col("point").alias("query")), "embedding")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return asking.join(lists, "query").select("query_id", F.posexplode(others).alias("pos", "x")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))


def product(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
