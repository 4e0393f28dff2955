"""A trie over the prefixes of conversations, from mergeable partial tries.

Turns are sorted by conversation and dealt out by ranges of that order, so a conversation of any
length may span tasks and each task holds about as many turns as any other. A turn is a digest of
its role and text; no text moves. A node is named by a polynomial over the digests on its path, at
a fixed point of a prime field of 127 bits, so a part of a path can be summed without what comes
before it and shifted to its place later.

Each task combines the nodes of its conversations in a table of its own and emits that. What a task
cannot know is whether its first family of conversations began before it: their turns are emitted
with sums of their own, one summary per task is brought together in order, and each such turn is
then moved to its place by a linear map. The tables are merged by node, first among neighbouring
tasks, then all; lists of ends are merged in order as they are digested. Sums over subtrees go up to
ancestors at distances 1, 2, 4 and so on, so depth costs its logarithm.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from siftwright.llm.common import parallelism, stored, table

#: The field and the point at which paths are summed.
PRIME = (1 << 127) - 1
POINT = int.from_bytes(hashlib.sha256(b"prefix trie").digest()[:15], "big")
#: Conversations of a family, and the values that a number of borrowed turns may take.
FAMILY, SPREAD = 5, 9
#: Nodes and ends that a task holds before it emits them; tasks whose tables meet first.
HELD, FAN = 100_000, 16
NO_ENDS = hashlib.sha256(b"").hexdigest()

_FIELDS = "kind int, part int, key binary, parent binary, depth long, bytes long, conv_id long, n long, ids string, info string"
_NAMES = [f.split()[0] for f in _FIELDS.split(", ")]
_NODE, _END, _RAW, _SUMMARY = range(4)


def borrowed(conv_id: int, spread: int = SPREAD) -> int:
    """How many turns a conversation takes from the first of its family."""
    return zlib.crc32(str(conv_id).encode()) % spread


def _light(rows: DataFrame) -> DataFrame:
    """What a turn contributes: its conversation, its place in the order, a digest and its size."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    mark = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 30))
    light = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), mark.alias("mark"), F.octet_length(text).cast("long").alias("bytes"))
    return light.filter("conv_id IS NOT NULL").withColumn("_id", F.monotonically_increasing_id())


class _Table:
    """The nodes and ends that a task has met and not yet emitted."""

    def __init__(self, part: int):
        self.part = part
        self.nodes: dict[int, list] = {}
        self.ends: dict[int, list[int]] = {}
        self.listed = 0
        self.rows: list[tuple] = []

    def node(self, key: int, parent: int | None, depth: int, size: int, conv_id: int) -> None:
        known = self.nodes.get(key)
        if known is None:
            self.nodes[key] = [parent, depth, size, conv_id, 1]
        else:
            known[3] = min(known[3], conv_id)
            known[4] += 1

    def end(self, key: int, conv_id: int) -> None:
        """Ids come in ascending order, with none of another task's between them."""
        self.ends.setdefault(key, []).append(conv_id)
        self.listed += 1

    def lone_end(self, key: int, conv_id: int) -> None:
        self.row(_END, key, conv_id=conv_id, n=1, ids=str(conv_id))

    def row(self, kind: int, key: int | None = None, parent: int | None = None, depth: int = 0, size: int = 0, conv_id: int = 0, n: int = 0, ids: str | None = None, info: str | None = None) -> None:
        name = lambda k: None if k is None else k.to_bytes(16, "big")
        self.rows.append((kind, self.part, name(key), name(parent), depth, size, conv_id, n, ids, info))

    def batches(self, force: bool = False) -> Iterator[pa.RecordBatch]:
        if force or len(self.nodes) + self.listed + len(self.rows) >= HELD:
            for key, (parent, depth, size, conv_id, n) in self.nodes.items():
                self.row(_NODE, key, parent, depth, size, conv_id, n)
            for key, ids in self.ends.items():
                self.row(_END, key, conv_id=ids[0], n=len(ids), ids=",".join(map(str, ids)))
            if self.rows:
                kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*self.rows), kinds)], names=_NAMES)
            self.nodes, self.ends, self.listed, self.rows = {}, {}, 0, []


class _Heads:
    """The first turns of a family's first conversation, as others borrow them: (digest, size)."""

    def __init__(self, family: int | None = None, turns: list[tuple[int, int]] = ()):
        self.family = family
        self.turns = [tuple(t) for t in turns]

    def path(self, n: int) -> list[tuple[int, int | None, int, int]]:
        """(key, parent, depth, size) of the root and of the first n turns."""
        out: list[tuple[int, int | None, int, int]] = [(0, None, 0, 0)]
        power = 1
        for depth, (mark, size) in enumerate(self.turns[:n], 1):
            power = power * POINT % PRIME
            out.append(((out[-1][0] + mark * power) % PRIME, out[-1][0], depth, size))
        return out


def _partial(family: int, spread: int):
    """A task's rows: nodes, ends, turns whose place is not known yet, and one summary."""

    def run(batches):
        context = TaskContext.get()
        table = _Table(context.partitionId())
        heads, first_family = _Heads(), None
        conv = key = None
        own = skip = pos = rank = size_of = 0
        power, raw, total = 1, False, 0
        raws: list[dict] = []

        for batch in batches:
            for c, mark, size in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if c != conv:
                    if conv is not None and not raw:
                        table.end(key, conv)
                    conv, rank, own = c, 0, c - c % family
                    if own != heads.family:
                        heads = _Heads(own)
                    first_family = own if first_family is None else first_family
                    raw = own == first_family
                    if raw:
                        total, power = 0, 1
                        raws.append({"conv": c, "n": 0, "total": 0, "head": []})
                    else:
                        skip = 0 if c == own else borrowed(c, spread)
                        path = heads.path(skip)
                        for node in path:
                            table.node(*node, c)
                        key, pos = path[-1][0], path[-1][2]
                        power = pow(POINT, pos, PRIME)
                rank += 1
                mark = int.from_bytes(mark, "big") + 1
                if c == own and rank < spread:
                    heads.turns.append((mark, size))
                if raw:
                    power = power * POINT % PRIME
                    before, total = total, (total + mark * power) % PRIME
                    table.row(_RAW, total, before, rank, size, c)
                    raws[-1].update(n=rank, total=total)
                    if rank < spread:
                        raws[-1]["head"].append((mark, size, total))
                elif rank > skip:
                    power = power * POINT % PRIME
                    before, key, pos = key, (key + mark * power) % PRIME, pos + 1
                    table.node(key, before, pos, size, c)
                yield from table.batches()
        if conv is not None:
            tail = None if raw else {"conv": conv, "key": key, "pos": pos, "rank": rank, "heads": heads.turns}
            table.row(_SUMMARY, info=json.dumps({"raw": raws, "tail": tail}))
            yield from table.batches(True)

    return run


def _placed(summaries: list[tuple[int, str]], family: int, spread: int) -> tuple[dict, _Table]:
    """By (task, conversation), the linear map of its turns there: how many come before those that
    count, and shift, scale and addend; and the nodes and ends that only the whole tells. There are
    as many summaries as tasks, each of one family's few conversations."""
    maps: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    known, heads = _Table(-1), _Heads()
    open_conv = None
    key = pos = rank = 0

    for part, info in sorted(summaries):
        said = json.loads(info)
        for raw in said["raw"]:
            c, n = raw["conv"], raw["n"]
            own = c - c % family
            skip = 0 if c == own else borrowed(c, spread)
            if c != open_conv:
                if open_conv is not None:
                    known.lone_end(key, open_conv)
                if own != heads.family:
                    heads = _Heads(own)
                open_conv, rank = c, 0
                path = heads.path(skip)
                for node in path:
                    known.node(*node, c)
                key, pos = path[-1][0], path[-1][2]
            out = max(0, min(n, skip - rank))
            scale = pow(POINT, pos - out, PRIME)
            add = (key - scale * (raw["head"][out - 1][2] if out else 0)) % PRIME
            maps[part, c] = (out, pos - out, scale, add)
            if c == own:
                heads.turns += [tuple(t[:2]) for t in raw["head"][: max(0, spread - 1 - rank)]]
            if n > out:
                key, pos = (add + scale * raw["total"]) % PRIME, pos + n - out
            rank += n
        if tail := said["tail"]:
            if open_conv is not None:
                known.lone_end(key, open_conv)
            open_conv, key, pos, rank = tail["conv"], tail["key"], tail["pos"], tail["rank"]
            heads = _Heads(open_conv - open_conv % family, tail["heads"])
    if open_conv is not None:
        known.lone_end(key, open_conv)
    return maps, known


def _moved(maps: dict):
    """Turns whose place is known by now, as nodes."""

    def run(batches):
        table = _Table(TaskContext.get().partitionId())
        for batch in batches:
            for part, c, at, total, before, size in zip(*(batch.column(i).to_pylist() for i in range(6))):
                skip, shift, scale, add = maps[part, c]
                if at > skip:
                    own, parent = ((add + scale * int.from_bytes(x, "big")) % PRIME for x in (total, before))
                    table.node(own, parent, at + shift, size, c)
            yield from table.batches()
        yield from table.batches(True)

    return run


def partials(rows: DataFrame, family: int = FAMILY, spread: int = SPREAD) -> DataFrame:
    """The tasks' tables of ``rows(conv_id, turn, role, text)``: rows of nodes and of ends."""
    spark = rows.sparkSession
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "mark", "_id"]
    line = _light(rows).repartitionByRange(parallelism(spark), *order).sortWithinPartitions(*order)
    first = stored(line.select("conv_id", "mark", "bytes").mapInArrow(_partial(family, spread), _FIELDS), "trie-partial")
    maps, known = _placed([(r["part"], r["info"]) for r in first.filter(F.col("kind") == _SUMMARY).select("part", "info").collect()], family, spread)
    moved = first.filter(F.col("kind") == _RAW).select("part", "conv_id", "depth", "key", "parent", "bytes").mapInArrow(_moved(maps), _FIELDS)
    few = [tuple(r) for b in known.batches(True) for r in zip(*(c.to_pylist() for c in b.columns))]
    return first.filter(F.col("kind") <= _END).unionByName(moved).unionByName(spark.createDataFrame(few, _FIELDS))


def _merged(tables: DataFrame, *by: str) -> DataFrame:
    return tables.groupBy("key", *by).agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("bytes").alias("bytes"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"))


def _end_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256): a node's ends, in order, as one text. Lists come in chunks that do not
    overlap, sorted by node and first id, and are digested as they pass: a task holds one chunk."""

    def run(batches):
        key, digest, out = None, None, []
        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != key:
                    if key is not None:
                        out.append((key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.binary(), pa.string()))], names=["key", "ends_sha256"])
            out = []
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["key", "ends_sha256"])

    line = ends.select("key", "conv_id", "ids").repartition(parallelism(ends.sparkSession), "key").sortWithinPartitions("key", "conv_id")
    return line.select("key", "ids").mapInArrow(run, "key binary, ends_sha256 string")


def _rolled_up(nodes: DataFrame) -> DataFrame:
    """(key, parent_conv_id, n_children, n_leaves, saved_tokens). In each round every node adds what
    it has gathered from the generations below it to its ancestor ``step`` above, and learns who is
    twice as far; those of fewer generations have nobody there and ask nothing."""
    root = nodes.filter("depth = 0").select("conv_id").first()
    below = nodes.filter("depth > 0").groupBy(F.col("parent").alias("key")).agg(F.count("*").cast("long").alias("n_children"))
    parents = nodes.filter("depth > 0").select(F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    named = nodes.withColumnRenamed("parent", "up")
    top = named.filter("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root and root["conv_id"])).cast("long"))
    named = named.filter("depth > 1").join(parents, "up").unionByName(top)
    kids = F.coalesce("n_children", F.lit(0).cast("long"))
    state = stored(
        named.join(below, "key", "left").select(
            "key", "up", "depth", "parent_conv_id", kids.alias("n_children"), (kids == 0).cast("long").alias("n_leaves"), ((F.col("n") - 1) * F.col("bytes")).alias("saved_tokens")
        ), "trie-sums",
    )
    deepest, step = state.agg(F.max("depth")).first()[0] or 0, 1
    while step <= deepest:
        sent = state.filter("up IS NOT NULL").groupBy(F.col("up").alias("key")).agg(F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved"))
        above = state.filter("up IS NOT NULL").select(F.col("key").alias("up"), F.col("up").alias("far"))
        far = F.col("depth") >= 2 * step
        deep = state.filter(far).join(above, "up").drop("up").withColumnRenamed("far", "up")
        next_up = deep.unionByName(state.filter(~far).withColumn("up", F.lit(None).cast("binary")))
        sums = [(F.col(a) + F.coalesce(b, F.lit(0))).alias(a) for a, b in (("n_leaves", "_leaves"), ("saved_tokens", "_saved"))]
        state = stored(next_up.join(sent, "key", "left").select("key", "up", "depth", "parent_conv_id", "n_children", *sums), "trie-sums")
        step *= 2
    return state.select("key", "parent_conv_id", "n_children", "n_leaves", "saved_tokens")


def trie(rows: DataFrame, family: int = FAMILY, spread: int = SPREAD) -> DataFrame:
    """A row for each distinct prefix of the rebuilt conversations: (conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    A conversation borrows turns from that of its id less the remainder, never negative, by
    ``family``; a family of 1 leaves conversations as they are. Turns sort by turn, nulls first, then
    role, then the digest of role and text; a repeated row is a turn each time. A null role or text
    is empty. Rows without conv_id belong to no conversation and are left out. Other columns are
    not read. No rows give no nodes.

    The list of the conversations that end at a node is one digest, so one task reads it, as text in
    chunks; everything else of a hot conversation, first turn or node is dealt out.
    """
    tables = partials(rows, family, spread)
    near = _merged(tables.filter(F.col("kind") == _NODE).withColumn("_near", F.floor(F.col("part") / FAN)), "_near").drop("_near")
    nodes = stored(_merged(near), "trie-nodes")
    ends = _end_digests(tables.filter(F.col("kind") == _END))
    whole = nodes.join(_rolled_up(nodes), "key").join(ends, "key", "left")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


#: CRC-32 of an id's decimal digits, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(substr(s, i, 1)) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""
ORACLE_SQL = f"""
WITH c AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS i
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
v AS (SELECT conv_id, conv_id - (conv_id % {FAMILY} + {FAMILY}) % {FAMILY} AS family, {_CRC} % {SPREAD} AS h FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM c)),
r AS (SELECT v.conv_id, 0 AS own, i, role, text FROM v JOIN c ON c.conv_id = v.family AND i <= h UNION ALL SELECT v.conv_id, 1, i, role, text FROM v JOIN c USING (conv_id) WHERE i > h),
p AS (SELECT conv_id, row_number() OVER w AS d, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER w) AS node, strlen(text) AS bytes FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, i)),
m AS (SELECT conv_id, d, node, bytes FROM p UNION ALL SELECT conv_id, 0, '', 0 FROM v),
l AS (SELECT conv_id, max(d) AS d FROM m GROUP BY conv_id),
n AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM m GROUP BY node, d),
k AS (SELECT DISTINCT a.node AS parent, b.node FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.d = a.d + 1),
kn AS (SELECT parent AS node, count(*) AS n_children FROM k GROUP BY parent),
u AS (SELECT DISTINCT a.node AS top, b.node FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.d >= a.d),
su AS (SELECT top AS node, count(*) FILTER (WHERE kn.node IS NULL) AS n_leaves, CAST(sum((n_convs - 1) * bytes) AS BIGINT) AS saved_tokens FROM u JOIN n USING (node) LEFT JOIN kn USING (node) GROUP BY top),
e AS (SELECT node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM m JOIN l USING (conv_id, d) GROUP BY node)
SELECT n.conv_id, n.d AS depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n JOIN su USING (node) LEFT JOIN kn USING (node) LEFT JOIN k USING (node) LEFT JOIN n q ON q.node = k.parent LEFT JOIN e USING (node)"""
