"""Near-duplicate detection on word shingles with SetSketch registers.

A sketch holds, for each of its registers, the smallest of the set's exponential values on an
exponential scale, truncated to 16 bits. Registers of a union are the larger of the two sets'
registers, so sketches merge; two sets agree in a register about as often as their similarity.

Documents with equal sets are one class. Bands of registers bring classes together. Within a band
the registers of pairs give the joint maximum-likelihood estimate of their similarity; pairs whose
estimate is not far below the threshold join their classes to a cluster. The full sets of each
cluster are then compared, each pair once whatever the number of bands it shares, and the links
that hold join classes to components.

A large cluster, which may be no more than much that many texts share, is narrowed first: of each set
the rarest shingles, so many that linked sets have one of them in common, say which sets stay
together. What is large then is compared within blocks, and only the sets that this has not joined to
most others meet all.

Tasks emit no pairs but what pairs join: of a group of n members at most n - 1 rows, (smallest,
member) for each member of a joined set. A band or cluster too large for one task is dealt out as
blocks.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftwright.llm.common import cut, map_texts, parallelism, stored, table, whole_runs

REGISTERS, BAND, BASE, SEED = 128, 4, 1.001, 5
BANDS = REGISTERS // BAND
#: An estimate of a link's similarity is below its threshold by more than this in fewer than one
#: case in a million (its deviation is about 0.035).
SLACK = 0.18
#: Pairs with fewer equal registers are let go without an estimate: a link has so few in fewer than
#: one case in ten thousand million, however the sets' sizes differ.
EQUAL_SLACK = 0.28
#: Classes of a band that first meet in one task.
BLOCK = 512
#: Classes of a block where blocks meet each other: as many blocks as keep all tasks busy, but of
#: no fewer classes than the first, no more than the second, and about so many shingles at most.
FEW, MANY, MANY_SHINGLES = 128, 1024, 1_000_000
#: Members of a cluster that is narrowed before its sets are compared; share of a cluster's members that
#: have a common shingle, as one in so many.
LARGE, RARITY = 1024, 50
#: Cells of a matrix that counts common shingles at once.
CELLS = 4_000_000
_TOP = (1 << 16) - 1


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, split at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles_of(text: str | None, width: int) -> np.ndarray:
    """The set of a text's shingles as sorted 64-bit hashes. A text of fewer words than ``width``
    has its whole sequence as one shingle; one without words has none."""
    words = words_of(text)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(h) - width + 1
    mixed = h[:n].copy()
    for k in range(1, width):
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed += h[k : k + n]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def _digest(hashes: np.ndarray) -> int | None:
    """Names a set of hashes; null if it is empty."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "big", signed=True) if len(hashes) else None


@lru_cache(maxsize=1)
def permutations() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(SEED).integers(0, 1 << 32, (2, REGISTERS), dtype=np.uint32)
    return draw[0] | np.uint32(1), draw[1]


def sketch_of(hashes: np.ndarray) -> np.ndarray:
    """Registers of a set of one or more hashes; their upper halves are permuted, which numpy does
    in vector registers."""
    a, b = permutations()
    upper = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(upper), 1024):
        values = a[:, None] * upper[None, at : at + 1024]
        values += b[:, None]
        np.minimum(least, values.min(1), out=least)
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(exponential) / math.log(BASE)), 0, _TOP).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def _slope(x: np.ndarray, y: np.ndarray, u: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Slope at ``j`` of the log-likelihood of the numbers of registers that are larger, smaller
    and equal; u is the first set's share of the two sizes."""
    more, less = (x > y).sum(1), (x < y).sum(1)
    c, v = (BASE - 1) / BASE, 1 - u

    def chance(z, dz):
        z = np.clip(z, 1e-12, 1)
        return -np.log1p(-z * c) / math.log(BASE), c * dz / ((1 - z * c) * math.log(BASE))

    (p, dp), (q, dq) = chance(u - v * j, -v), chance(v - u * j, -u)
    return more * dp / p + less * dq / q - (REGISTERS - more - less) * (dp + dq) / np.maximum(1 - p - q, 1e-12)


def estimated(x: np.ndarray, y: np.ndarray, size_x: np.ndarray, size_y: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs of sets from their registers (a row per pair) and
    sizes: where the likelihood's slope changes sign."""
    u = size_x / (size_x + size_y)
    low, high = np.zeros(len(u)), np.minimum(u / (1 - u), (1 - u) / u)
    for _ in range(24):
        mid = (low + high) / 2
        up = _slope(x, y, u, mid) > 0
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    return (low + high) / 2


def hopeful(x: np.ndarray, y: np.ndarray, size_x: np.ndarray, size_y: np.ndarray, least: float) -> np.ndarray:
    """Which pairs may have a similarity of ``least``: those whose estimate is ``least`` less
    SLACK or more, which the slope there tells. Cheap counts of equal registers come first."""
    out = (x == y).sum(1) >= (least - EQUAL_SLACK) * REGISTERS
    out &= np.minimum(size_x, size_y) >= (least - SLACK) * np.maximum(size_x, size_y)
    at = np.flatnonzero(out)
    u = size_x[at] / (size_x[at] + size_y[at])
    out[at] = _slope(x[at], y[at], u, np.full(len(at), least - SLACK)) >= 0
    return out


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, digest (of the set; null if empty), sketch, for each row."""

    def make():
        def work(texts):
            sizes, digests, sketches = [], [], []
            for text in texts:
                s = shingles_of(text, width)
                sizes.append(len(s))
                digests.append(_digest(s))
                sketches.append(sketch_of(s).astype(">u2").tobytes() if len(s) else None)
            return [pa.array(sizes, pa.int64()), pa.array(digests, pa.int64()), pa.array(sketches, pa.binary())]

        return work

    return map_texts(docs, make, "n_shingles long, digest long, sketch binary")


def banded(classes: DataFrame) -> DataFrame:
    """(key, node): a row for each class and band."""
    values = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sketch"), i * 2 * BAND + 1, F.lit(2 * BAND))))
    return classes.select("node", F.explode(values).alias("key"))


def _registers(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=">u2").reshape(-1, REGISTERS)


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return up
        parent = up


def connected(run: np.ndarray, part: np.ndarray, meets: np.ndarray | None, reg: np.ndarray, n: np.ndarray, least: float) -> np.ndarray:
    """Labels of rows: members of a run that plausible estimates join have the same.

    Rows of a run stand together; rows of one ``part`` are joined from the start. With ``meets``
    (two Booleans a row: is on the left, is on the right) only such pairs are compared. Row i meets
    row i + d, for all i at once; pairs already joined are passed over.
    """
    _, first, back = np.unique(part, return_index=True, return_inverse=True)
    parent = first[back]
    at, d = np.arange(len(run)), 0
    while True:
        d += 1
        at = at[at < len(run) - d]
        at = at[run[at] == run[at + d]]
        if not len(at):
            return parent
        i = at[parent[at] != parent[at + d]]
        if meets is not None:
            i = i[(meets[i, 0] & meets[i + d, 1]) | (meets[i, 1] & meets[i + d, 0])]
        if not len(i):
            continue
        i = i[hopeful(reg[i], reg[i + d], n[i], n[i + d], least)]
        for x in i.tolist():
            y = x + d
            while parent[x] != x:
                x = int(parent[x])
            while parent[y] != y:
                y = int(parent[y])
            parent[max(x, y)] = min(x, y)
        if len(i):
            parent = _roots(parent)


def _runs_of(key: pa.Table) -> np.ndarray:
    """Numbers the runs of equal rows."""
    columns = np.stack([c.to_numpy() for c in key.columns], 1)
    return np.concatenate([[0], np.cumsum((columns[1:] != columns[:-1]).any(1))])


def blocks_of(n: Column, parts: int, shingles: Column | None = None) -> Column:
    """Number of blocks of a group of ``n`` members: a group of k blocks is k (k + 1) / 2 tasks' work
    and k + 1 copies of its rows, so k grows with the group only until all tasks have work, and
    beyond that only to bound a task's memory."""
    k = F.least(n / FEW, F.lit(math.sqrt(2 * parts)))
    k = F.greatest(k, n / MANY, *([shingles / MANY_SHINGLES] if shingles is not None else []))
    return F.greatest(F.lit(1), F.ceil(k)).cast("int")


def in_pairs(members: DataFrame, group: str) -> DataFrame:
    """``members(group, node, blocks, ...)`` with block, low, high: each member once for each pair of
    blocks of its group that its own block is in."""
    placed = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("low"), F.greatest("block", o).alias("high")))
    dealt = placed.withColumn("pair", F.explode(pairs)).withColumns({"low": F.col("pair.low"), "high": F.col("pair.high")}).drop("pair", "blocks")
    return dealt.repartition(group, "low", "high").sortWithinPartitions(group, "low", "high")


def outsiders_meet(members: DataFrame, group: str, parts: int) -> DataFrame:
    """``members(group, node, component, ...)`` with low, high and block, so that of each group those outside
    of the component that holds most of it meet one another and all others: a member of block ``low`` is to be
    compared with those of block ``high``. The others, in blocks below 0, are copied as often as the outsiders
    fill blocks, not as often as the group does. Groups of one component are left out."""
    homes = members.groupBy(group, "component").agg(F.count("*").alias("n")).groupBy(group).agg(F.max_by("component", F.struct("n", "component")).alias("home"), F.max("n").alias("inside"), F.sum("n").alias("n"))
    known = cut(homes.filter("n > inside").select(group, "home", blocks_of(F.col("inside"), parts).alias("homes"), blocks_of(F.col("n") - F.col("inside"), parts).alias("outs")))
    inner = F.col("component") == F.col("home")
    block = F.when(inner, -1 - F.pmod(F.xxhash64("node"), F.col("homes"))).otherwise(F.pmod(F.xxhash64("node"), F.col("outs"))).cast("int")
    pair = lambda low, high: F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"))
    outs, insides = F.sequence(F.lit(0), F.col("outs") - 1), F.sequence(F.lit(0), F.col("homes") - 1)
    of_inner = F.transform(outs, lambda o: pair(o, F.col("block")))
    of_outer = F.concat(F.transform(insides, lambda h: pair(F.col("block"), -1 - h)), F.transform(outs, lambda o: pair(F.least("block", o), F.greatest("block", o))))
    placed = members.join(known, group).withColumns({"block": block, "_inner": inner})
    dealt = placed.withColumn("pair", F.explode(F.when(F.col("_inner"), of_inner).otherwise(of_outer)))
    return dealt.withColumns({"low": F.col("pair.low"), "high": F.col("pair.high")}).drop("pair", "home", "homes", "outs", "_inner")


def plausible(bands: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """(node, cluster): classes joined by pairs that share a band and whose estimate is not far
    below ``least``; ``bands(key, node, a, n)`` has the members of bands with several.

    First each band's members meet in blocks of about BLOCK, its smallest member ``a`` in all of
    them. Then, in larger bands that still hold several clusters, the members outside of the largest meet all.
    """
    parts = parallelism(bands.sparkSession)
    sides = classes.select("node", "sketch", "n_shingles")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("int")
    own = F.array(F.pmod(F.xxhash64("node"), blocks).cast("int"))
    dealt = bands.select("key", "node", F.explode(F.when(F.col("node") == F.col("a"), F.sequence(F.lit(0), blocks - 1)).otherwise(own)).alias("block"))
    met = dealt.join(sides, "node").repartition("key", "block").sortWithinPartitions("key", "block").select("key", "block", "node", "sketch", "n_shingles")

    def meet(batches):
        for t in whole_runs(batches, 2):
            node, n = t.column(2).to_numpy(), t.column(4).to_numpy()
            yield _stars(node, connected(_runs_of(t.select([0, 1])), np.arange(len(node)), None, _registers(t.column(3)), n, least))

    edges = cut(met.mapInArrow(meet, "a long, b long").distinct())
    labels = components(edges)

    large = bands.filter(F.col("n") > BLOCK).select("key", "node", "n").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = large.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
    rest = cut(large.join(several, "key", "left_semi").select("key", "node", "component"))
    if rest.isEmpty():
        return labels
    dealt = outsiders_meet(rest, "key", parts).join(sides, "node").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    across = dealt.select("key", "low", "high", "block", "node", "component", "sketch", "n_shingles")

    def meet_across(batches):
        for t in whole_runs(batches, 3):
            low, high, block, node, part, n = (t.column(i).to_numpy() for i in (1, 2, 3, 4, 5, 7))
            run = _runs_of(t.select([0, 1, 2]))
            parts_of = np.unique(np.stack([run, part], 1), axis=0, return_inverse=True)[1].ravel()
            yield _stars(node, connected(run, parts_of, np.stack([block == low, block == high], 1), _registers(t.column(6)), n, least))

    more = cut(across.mapInArrow(meet_across, "a long, b long").distinct())
    return components(edges.unionByName(more))


def _stars(node: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    """(a, b): the smallest node of each label with each of its others."""
    _, back = np.unique(label, return_inverse=True)
    least = np.full(int(back.max()) + 1 if len(back) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, back, node)
    others = least[back] != node
    return pa.RecordBatch.from_arrays([pa.array(least[back][others]), pa.array(node[others])], names=["a", "b"])


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets of distinct hashes.

    Hashes that one set alone has are left out; the others are the columns of a matrix of zeros and
    ones, of which some are multiplied at a time.
    """
    sizes = np.array([len(s) for s in sets])
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = count[column] > 1
    row, column = row[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.int64)
    width = max(64, CELLS // len(sets))
    for at in range(0, int((count > 1).sum()), width):
        a, b = np.searchsorted(column, [at, at + width])
        ones = np.zeros((len(sets), width), dtype=np.float32)
        ones[row[a:b], column[a:b] - at] = 1
        out += np.rint(ones @ ones.T).astype(np.int64)
    np.fill_diagonal(out, sizes)
    return out


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Labels of sets: those that links join have the same. Links are pairs of a set on the left and
    a set on the right (Booleans; a set may be both) with 100 * intersection >= percent * union."""
    size = np.array([len(s) for s in sets])
    label = np.arange(len(sets))
    if len(sets) == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return label * (100 * common < percent * (size.sum() - common))
    common = common_counts(sets)
    near = 100 * common >= percent * (size[:, None] + size[None] - common)
    near &= (left[:, None] & right[None]) | (right[:, None] & left[None])
    fresh = np.ones(len(sets), dtype=bool)
    for i in range(len(sets)):
        edge = np.array([i]) if fresh[i] else []
        fresh[i] = False
        while len(edge):
            edge = np.flatnonzero(near[edge].any(0) & fresh)
            fresh[edge] = False
            label[edge] = i
    return label


def _in_blocks(sets: DataFrame, *more: str) -> DataFrame:
    """Adds the slot, of about LARGE members, that each member of a cluster is in."""
    sizes = sets.groupBy("cluster").agg(F.count("*").alias("_n"))
    slot = F.pmod(F.xxhash64("node"), F.ceil(F.col("_n") / LARGE)).cast("int")
    return sets.join(cut(sizes), "cluster").withColumn("slot", slot).select("cluster", "slot", "_n", "node", "set", *more)


def _common(slots: DataFrame) -> DataFrame:
    """(cluster, common): hashes that one in RARITY of a cluster's members has, the rarest first. Tasks count
    within a slot and leave out what is rare there, so that a cluster has few; any order would do."""

    def count(batches):
        for t in whole_runs(batches, 2):
            cluster, sets = t.column(0).to_numpy(), t.column(2).to_pylist()
            runs = np.flatnonzero(np.diff(_runs_of(t.select([0, 1])), prepend=-1, append=-1)).tolist()
            for a, b in zip(runs[:-1], runs[1:]):
                values, n = np.unique(np.frombuffer(b"".join(sets[a:b]), dtype=np.uint64), return_counts=True)
                some = n >= max(2, (b - a) / RARITY)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(some.sum(), cluster[a])), pa.array(values[some].view(np.int64)), pa.array(n[some])], names=["cluster", "hash", "n"])

    dealt = slots.select("cluster", "slot", "set").repartition("cluster", "slot").sortWithinPartitions("cluster", "slot")
    counts = dealt.mapInArrow(count, "cluster long, hash long, n long").groupBy("cluster", "hash").agg(F.sum("n").alias("n"))
    sizes = slots.select("cluster", "_n").distinct()
    kept = counts.join(sizes, "cluster").filter(F.col("n") * RARITY >= F.col("_n"))
    hashes = F.transform(F.array_sort(F.collect_list(F.struct("n", "hash"))), lambda x: x["hash"])
    return kept.groupBy("cluster").agg(hashes.alias("common"))


def _rarest(slots: DataFrame, common: DataFrame, percent: int) -> DataFrame:
    """(cluster, token, node): of each set of n hashes the first n - ceil(percent / 100 * n) + 1, rare ones
    before common ones. Linked sets have at least so much in common that the first common hash of the two is
    among these of both."""
    heads = slots.select("cluster", "slot").distinct().join(common, "cluster", "left").select("cluster", "slot", F.lit(None).cast("long").alias("node"), F.lit(None).cast("binary").alias("set"), "common")
    rows = slots.select("cluster", "slot", "node", "set", F.lit(None).cast("array<long>").alias("common")).unionByName(heads)
    dealt = rows.repartition("cluster", "slot").sortWithinPartitions("cluster", "slot", F.col("node").asc_nulls_first())

    def first_of(batches):
        for t in whole_runs(batches, 2):
            common = np.zeros(0, np.uint64)
            out: list[tuple[int, int, np.ndarray]] = []
            for cluster, node, own, head in zip(*(t.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if node is None:
                    common = np.array(head or [], np.int64).view(np.uint64)
                    order = np.argsort(common)
                    continue
                own = np.frombuffer(own, np.uint64)
                at = np.searchsorted(common[order], own)
                place = np.zeros(len(own), np.int64)
                if len(common):
                    at = order[np.minimum(at, len(common) - 1)]
                    place = np.where(common[at] == own, at + 1, 0)
                count = len(own) - -(-percent * len(own) // 100) + 1
                out.append((cluster, node, own[np.lexsort((own, place))[:count]]))
            sizes = [len(x[2]) for x in out]
            columns = [np.repeat([x[0] for x in out], sizes).astype(np.int64), np.concatenate([x[2] for x in out] or [np.zeros(0, np.uint64)]).view(np.int64), np.repeat([x[1] for x in out], sizes).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cluster", "token", "node"])

    return dealt.mapInArrow(first_of, "cluster long, token long, node long")


def narrowed(sets: DataFrame, percent: int) -> DataFrame:
    """``sets(cluster, blocks, node, set)`` with its large clusters split where no link can be; members
    that can have none are left out."""
    sizes = sets.groupBy("cluster").agg(F.count("*").alias("_n"))
    large = cut(sizes.filter(F.col("_n") > LARGE).select("cluster"))
    if large.isEmpty():
        return sets
    slots = stored(_in_blocks(sets.join(large, "cluster", "left_semi")), "slots")
    tokens = stored(_rarest(slots, _common(slots), percent), "rarest")
    several = tokens.groupBy("cluster", "token").agg(F.min("node").alias("a"), F.count("*").alias("n")).filter("n > 1").select("cluster", "token", "a")
    edges = tokens.join(several, ["cluster", "token"]).filter("node <> a").select("a", F.col("node").alias("b")).distinct()
    labels = components(edges)
    parts = slots.select("node", "set").join(labels, "node").select(F.col("component").alias("cluster"), "node", "set")
    blocks = parts.groupBy("cluster").agg(blocks_of(F.count("*"), parallelism(sets.sparkSession), F.sum(F.octet_length("set") / 8)).alias("blocks"))
    split = parts.join(cut(blocks), "cluster").select("cluster", "blocks", "node", "set")
    return stored(sets.join(large, "cluster", "left_anti").unionByName(split), "sets")


def _compared(dealt: DataFrame, percent: int) -> DataFrame:
    """Stars (a, b) of what links join among the members (cluster, low, high, block, node, set) of each pair
    of blocks; a member of block low meets those of block high."""

    def compare(batches):
        for t in whole_runs(batches, 3):
            low, high, block, node = (t.column(i).to_numpy() for i in (1, 2, 3, 4))
            hashes = t.column(5).to_pylist()
            bounds = np.flatnonzero(np.diff(_runs_of(t.select([0, 1, 2])), prepend=-1, append=-1)).tolist()
            label = np.arange(len(node))
            for a, b in zip(bounds[:-1], bounds[1:]):
                own = [np.frombuffer(x, dtype=np.uint64) for x in hashes[a:b]]
                label[a:b] = a + linked(own, block[a:b] == low[a:b], block[a:b] == high[a:b], percent) if b - a > 1 else a
            yield _stars(node, label)

    columns = dealt.select("cluster", "low", "high", "block", "node", "set")
    return columns.repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high").mapInArrow(compare, "a long, b long")


def verified(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between the members of each cluster of ``sets(cluster, blocks, node, set)``,
    verified on the full sets; of each group of members that are compared, stars of what they join.

    The members of a large cluster first meet within their slots, its smallest member in all of them.
    Then those outside of the component that holds most of it meet one another and all others: these are
    copied as often as the former fill slots, not as often as the cluster does."""
    sizes = sets.groupBy("cluster").agg(F.count("*").alias("_n"), F.min("node").alias("_a"))
    large = cut(sizes.filter(F.col("_n") > LARGE))
    few = in_pairs(sets.join(large.select("cluster"), "cluster", "left_anti"), "cluster").select("cluster", "low", "high", "block", "node", "set")
    edges = _compared(few, percent)
    if large.isEmpty():
        return edges
    edges = cut(edges)
    slots = stored(_in_blocks(sets.join(large.select("cluster"), "cluster", "left_semi")), "slots")
    every = F.sequence(F.lit(0), F.ceil(F.col("_n") / LARGE).cast("int") - 1)
    own = F.when(F.col("node") == F.col("_a"), every).otherwise(F.array("slot"))
    met = slots.join(large.select("cluster", "_a"), "cluster").withColumn("block", F.explode(own)).withColumns({"low": F.col("block"), "high": F.col("block")})
    first = cut(_compared(met, percent).distinct())

    placed = slots.select("cluster", "node").join(components(first), "node", "left").select("cluster", "node", F.coalesce("component", "node").alias("component"))
    dealt = outsiders_meet(cut(placed), "cluster", parallelism(sets.sparkSession)).select("cluster", "low", "high", "block", "node")
    more = _compared(dealt.join(slots.select("node", "set"), "node"), percent)
    return edges.unionByName(first).unionByName(more)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges(a, b)`` reaches.

    Each round joins every node to the smallest of its neighbours, and that one's, and goes on with
    the edges between what is then joined; so the rounds grow with the logarithm of a component's
    size, a star takes one, and each has fewer edges. Rounds are checkpointed; the minimum is
    combined before it is shuffled, so a node with very many edges gathers in no task.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    left, labels = cut(both(edges.select("a", "b"))), None
    while True:
        joined = left.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("up"))
        further = joined.select(F.col("a").alias("up"), F.col("up").alias("top"))
        joined = cut(joined.join(further, "up").select("a", "top"))
        if labels is None:
            labels = joined.select(F.col("a").alias("node"), F.col("top").alias("component"))
        else:
            labels = cut(labels.join(joined, labels["component"] == joined["a"], "left").select("node", F.coalesce("top", "component").alias("component")))
        ends = left.join(joined, "a").select(F.col("top").alias("x"), F.col("b").alias("a")).join(joined, "a")
        left = cut(ends.filter("x <> top").select(F.col("x").alias("a"), F.col("top").alias("b")).distinct())
        if left.isEmpty():
            return labels


def links(docs: DataFrame, width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(rows, labels): ``rows(doc_id, n_shingles, node)`` for each row of ``docs`` and
    ``labels(node, component)`` for classes that are linked; node is a class of equal sets.
    """
    rows = stored(sketched(docs, width), "sketches")
    one = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "n_shingles", "sketch")).alias("x")
    classes = stored(rows.filter("digest IS NOT NULL").groupBy(F.col("digest").alias("node")).agg(one).select("node", F.col("x.doc_id").alias("first"), "x.n_shingles", "x.sketch"), "classes")
    bands = banded(classes)
    counts = bands.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("a")).filter("n > 1")
    clusters = plausible(cut(bands.join(counts, "key")), classes, percent / 100)
    edges = cut(verified(narrowed(_sets(docs, classes, clusters, width), percent), percent))
    return rows.select("doc_id", "n_shingles", F.col("digest").alias("node")), components(edges)


def _sets(docs: DataFrame, classes: DataFrame, clusters: DataFrame, width: int) -> DataFrame:
    """(cluster, blocks, node, set) of the classes that are in clusters, stored; the only pass that
    moves texts. Classes of which no row has an id are found by their sets' digests."""
    members = classes.select("node", F.col("first").alias("doc_id"), "n_shingles").join(clusters.withColumnRenamed("component", "cluster"), "node")
    blocks = blocks_of(F.count("*"), parallelism(docs.sparkSession), F.sum("n_shingles")).alias("blocks")
    first = cut(members.join(members.groupBy("cluster").agg(blocks), "cluster").drop("n_shingles"))
    schema = "cluster long, blocks int, node long, set binary"

    def hashed(batches):
        """Of rows that repeat an id, those whose set is the class's."""
        for batch in batches:
            keep, sets = [], []
            for node, text in zip(batch.column(2), batch.column(3)):
                own = shingles_of(text.as_py(), width)
                keep.append(_digest(own) == node.as_py())
                sets.append(own.tobytes())
            whole = pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(sets, pa.binary())], names=["cluster", "blocks", "node", "set"])
            yield whole.filter(pa.array(keep, pa.bool_()))

    def named(batches):
        for batch in batches:
            sets = [shingles_of(text.as_py(), width) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(map(_digest, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "set"])

    known = docs.select("doc_id", "text").filter("doc_id IS NOT NULL").join(first, "doc_id").select("cluster", "blocks", "node", "text").mapInArrow(hashed, schema)
    nameless = docs.filter("doc_id IS NULL").select("text").mapInArrow(named, "node long, set binary")
    others = nameless.join(first.filter("doc_id IS NULL").select("cluster", "blocks", "node"), "node").select("cluster", "blocks", "node", "set")
    found = known.unionByName(others)
    # rows that repeat an id and a text, or that have no id, give a class more than once
    return stored(found.groupBy("cluster", "blocks", "node").agg(F.min("set").alias("set")), "sets")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs(doc_id, text)``.

    component_id is the smallest doc_id that the row reaches over links; one row of each component
    is kept: that with this id. A text that is null, empty or without words has no shingles and is
    linked with nothing. Rows that repeat an id are documents of their own that share a name, and
    are kept or dropped together. A row without id counts for its set's links but names no
    component; unless its set is shared, its component is null; it is kept only then.
    """
    rows, labels = links(docs, width, percent)
    grouped = rows.join(labels, "node", "left").withColumn("group", F.coalesce("component", "node"))
    names = cut(grouped.filter("group IS NOT NULL").groupBy("group").agg(F.min("doc_id").alias("component_id")))  # cut, so that Spark can split a large group's rows in the join
    out = grouped.join(names, "group", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


def _sql(width: int, percent: int) -> str:
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {width} THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - {width - 2}), lambda i: array_to_string(ws[i:i + {width - 1}], ' '))) END AS s FROM w),
g AS (SELECT md5(array_to_string(list_sort(s), chr(10)) || len(s)) AS c, min(doc_id) AS node, any_value(s) AS s FROM sets WHERE len(s) > 0 GROUP BY 1),
x AS (SELECT node, len(s) AS n, unnest(s) AS h FROM g),
pairs AS (SELECT a.node AS a, b.node AS b FROM x a JOIN x b ON a.h = b.h AND a.node < b.node GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT node AS a, node AS b FROM g UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
c AS (SELECT a AS node, min(b) AS component_id FROM reach GROUP BY a)
SELECT sets.doc_id, len(sets.s) AS n_shingles, coalesce(component_id, sets.doc_id) AS component_id, sets.doc_id = coalesce(component_id, sets.doc_id) AS kept
FROM sets LEFT JOIN g ON len(sets.s) > 0 AND g.c = md5(array_to_string(list_sort(sets.s), chr(10)) || len(sets.s)) LEFT JOIN c USING (node)"""


ORACLE_SQL = _sql(4, 80)
