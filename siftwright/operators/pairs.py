"""The information of all features and pairs of features in one pass over the rows.

A slice of rows is a matrix of ones, a column for each bin of each feature; the product of its
transpose with itself holds the joint counts of all pairs. Tasks add up such products for each
client and class and emit them in tiles of features, which are summed by tree; a tile's tables then
meet in one task, which turns them into information. Rows move nowhere, and a round of a greedy
selection needs no job.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from siftwright.functions.expressions import TINY

#: Features of a tile; rows of a product; bytes of sums that a task holds; parts that are summed first.
TILE, SLICE, HELD, FAN = 16, 4096, 1 << 26, 16
#: Rows of more features than this have too many pairs for one pass.
PAIRS = 256

_TILES = "client long, y long, tile int, part int, cells binary"
_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
_NAMES = [f.split()[0] for f in _TILES.split(", ")]


def _corners(width: int) -> list[tuple[int, int]]:
    """The first features of each tile's rows and columns; a pair is in one tile."""
    starts = range(0, width, TILE)
    return [(a, b) for a in starts for b in starts if a <= b]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(_TYPES), _TYPES)], names=_NAMES)


def _products(width: int, bins: int):
    corners = _corners(width)

    def run(batches):
        part = TaskContext.get().partitionId()
        held: dict[tuple[int, int], np.ndarray] = {}

        def tiles() -> Iterator[pa.RecordBatch]:
            for (client, y), total in held.items():
                cut = lambda a: slice(a * bins, min(a + TILE, width) * bins)
                yield _batch([(client, y, i, part, total[cut(a), cut(b)].tobytes()) for i, (a, b) in enumerate(corners)])
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                some = batch.slice(at, SLICE)
                keys = np.stack([some.column(0).to_numpy(), some.column(1).to_numpy()], 1)
                values = some.column(2).flatten().fill_null(-1).to_numpy(zero_copy_only=False).reshape(len(keys), width)
                each, code = np.unique(keys, axis=0, return_inverse=True)
                for i, key in enumerate(map(tuple, each.tolist())):
                    own = values[code.reshape(-1) == i]
                    ones = (own[:, :, None] == np.arange(bins)).reshape(len(own), width * bins).astype(np.float32)
                    product = np.rint(ones.T @ ones).astype(np.int64)
                    held[key] = held[key] + product if key in held else product
                    if len(held) * product.nbytes > HELD:
                        yield from tiles()
        yield from tiles()

    return run


def _summed(batches):
    """Sums of what stands together with equal client, class, tile and part."""
    key, total = None, None
    for batch in batches:
        out = []
        for *own, cells in zip(*(c.to_pylist() for c in batch.columns)):
            more = np.frombuffer(cells, np.int64)
            if own == key:
                total = total + more
            else:
                if key is not None:
                    out.append((*key, total.tobytes()))
                key, total = own, more
        yield _batch(out)
    if key is not None:
        yield _batch([(*key, total.tobytes())])


def _information(tables: np.ndarray) -> np.ndarray:
    """Information in bits of tables (..., cells, classes) of probabilities."""
    px, py = tables.sum(-1, keepdims=True), tables.sum(-2, keepdims=True)
    good = (tables > TINY) & (px > TINY) & (py > TINY)
    total = np.where(good, tables * np.log2(np.where(good, tables / np.where(good, px * py, 1.0), 1.0)), 0.0).sum((-1, -2))
    return np.where(total > TINY, total, 0.0)


def _scored(width: int, bins: int, sizes: dict[int, int] | None, weighted: bool):
    """Information of a tile's pairs, and of single features on the diagonal, from its tables by client
    and class; pairs that a client lacks have none."""
    corners = _corners(width)

    def scores(tile: int, tables: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
        a, b = corners[tile]
        rows, columns = min(TILE, width - a), min(TILE, width - b)
        classes = sorted({y for _, y in tables})
        whole = np.zeros((rows, columns, bins * bins, len(classes)))
        missing = np.zeros((rows, columns), bool)
        for client in sizes or {0: 0}:
            counts = np.stack([tables.get((client, y), np.zeros((rows * bins, columns * bins))) for y in classes], -1)
            counts = counts.reshape(rows, bins, columns, bins, -1).transpose(0, 2, 1, 3, 4).reshape(rows, columns, bins * bins, -1)
            missing |= counts.sum((-1, -2)) == 0
            if sizes is None:
                whole += counts
            elif weighted:
                whole += counts / sum(sizes.values())
            else:
                whole += counts / sizes[client] / len(sizes)
        if sizes is None:
            whole = whole / np.maximum(whole.sum((-1, -2), keepdims=True), 1)
        mi = _information(whole)
        k, j = np.meshgrid(np.arange(a, a + rows), np.arange(b, b + columns), indexing="ij")
        kept = (k < j) & ~missing
        out = [k[kept], j[kept], mi[kept]]
        if a == b:  # alone, a feature's table is on the diagonal of its pair with itself
            own = np.arange(rows)
            alone = whole[own, own].reshape(rows, bins, bins, -1)[:, np.arange(bins), np.arange(bins)]
            some = alone.sum((-1, -2)) > 0
            out = [np.concatenate([x, y[some]]) for x, y in zip(out, (own + a, own + a, _information(alone)))]
        return pa.RecordBatch.from_arrays([pa.array(out[0].astype(np.int32)), pa.array(out[1].astype(np.int32)), pa.array(out[2])], names=["k", "j", "mi"])

    def run(batches):
        tile, tables = None, {}
        for batch in batches:
            for client, y, at, _, cells in zip(*(c.to_pylist() for c in batch.columns)):
                if at != tile:
                    if tile is not None:
                        yield scores(tile, tables)
                    tile, tables = at, {}
                a, b = corners[at]
                shaped = np.frombuffer(cells, np.int64).reshape(min(TILE, width - a) * bins, min(TILE, width - b) * bins)
                tables[client, y] = tables[client, y] + shaped if (client, y) in tables else shaped
        if tile is not None:
            yield scores(tile, tables)

    return run


def information_matrix(rows: DataFrame, width: int, bins: int = 5, combined: str | None = None) -> DataFrame:
    """(k, j, mi) for all pairs k < j of features of ``rows(client?, y, bins)``, and for single features
    as k = j. Pooled, or from clients' tables ("simple" or "weighted"), where a pair that some client
    lacks has no row. Missing bins and labels are skipped, and rows without client where these count.
    """
    if width > PAIRS:
        raise ValueError(f"{width} features have too many pairs for one pass")
    lead = F.col("client").cast("long") if combined else F.lit(0).cast("long")
    base = rows.select(lead.alias("client"), F.col("y").cast("long").alias("y"), F.col("bins").cast("array<int>").alias("bins")).filter("client IS NOT NULL AND y IS NOT NULL AND bins IS NOT NULL")
    sizes = {r["client"]: r["count"] for r in rows.filter("client IS NOT NULL").groupBy(lead.alias("client")).count().collect()} if combined else None
    parts = base.mapInArrow(_products(width, bins), _TILES)
    near = parts.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).repartition("tile", "client", "y", "part").sortWithinPartitions("tile", "client", "y", "part").mapInArrow(_summed, _TILES)
    line = near.repartition(min(math.comb(-(-width // TILE) + 1, 2), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "tile").sortWithinPartitions("tile", "client", "y")
    return line.mapInArrow(_scored(width, bins, sizes, combined == "weighted"), "k int, j int, mi double")
