"""Removal of passages that repeat, by common prefixes of suffixes.

A byte goes if a string of ``least`` bytes that covers it also starts anywhere else in the corpus.
Equal strings of that length are brought together by content: of the hashes of a window's grams the
smallest one, the leftmost if several, is its anchor, and consecutive windows with one anchor are a
piece. Equal windows have equal anchors at equal distances, so what repeats is decided among the
pieces of each anchor; of these only one of a kind is looked at, and those that have more than one
occurrence are all repeats.

What is left, the different pieces of an anchor, is searched in blocks within tasks. A block's
suffixes are sorted to more than the least length. Intervals of its Burrows-Wheeler transform are
extended backwards breadth first, which gives each common prefix of neighbouring suffixes by
increasing length; at the least length it stops, and what has no value then is a repeat.

An anchor with too many different pieces for a block is cut finer: the windows of its pieces are
dealt by their distance from it, and keyed by the bytes that all windows of so near distances share.
At the last step such a piece is one window, and equal ones are of one kind.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftwright.functions.shared import fresh_path
from siftwright.llm.common import parallelism, stored, table

LEAST = 200
#: Windows that share a key when an anchor's pieces are cut finer, step by step.
FINER = (16, 1)
#: Different pieces of a key that are searched together at most; bytes of whole keys in a block.
MANY, BLOCK = 512, 1 << 19
#: Windows whose anchors are sought at once.
CHUNK = 1 << 20
_LOW = np.uint64((1 << 21) - 1)


def gram_of(least: int) -> int:
    """Bytes of a gram: a power of two, at most half a window."""
    if least < 16:
        raise ValueError("least must be 16 bytes or more")
    gram = 8
    while gram * 4 <= least:
        gram *= 2
    return gram


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * np.uint64(0x9E3779B97F4A7C15) + b
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _grams(raw: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each gram of the bytes, from those of its halves."""
    h = np.ndarray((len(raw) - 7,), "<u8", buffer=raw, strides=(1,))
    h = _mixed(h, np.uint64(len("gram")))
    width = 8
    while width < gram:
        h = _mixed(h[:-width], h[width:])
        width *= 2
    return h


def pieces_of(raw: bytes, least: int) -> Iterator[tuple[int, int, int, int]]:
    """(first window, last window, anchor, key) for runs of windows with one anchor. Every window is
    in one; a run ends at a chunk's end, too."""
    gram = gram_of(least)
    span = least - gram + 1
    for begin in range(0, len(raw) - least + 1, CHUNK):
        part = np.frombuffer(raw, np.uint8, min(CHUNK + least - 1, len(raw) - begin), begin)
        h = _grams(part, gram)
        ranked = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        blocks = np.full(-(-len(h) // span) * span, ~np.uint64(0))
        blocks[: len(h)] = ranked
        blocks = blocks.reshape(-1, span)
        left = np.minimum.accumulate(blocks, axis=1).reshape(-1)
        right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        windows = len(part) - least + 1
        anchors = (np.minimum(right[:windows], left[span - 1 : span - 1 + windows]) & _LOW).astype(np.int64)
        cuts = np.flatnonzero(anchors[1:] != anchors[:-1]) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts - 1, [windows - 1]])
        at = anchors[starts]
        yield from zip((starts + begin).tolist(), (ends + begin).tolist(), (at + begin).tolist(), h[at].view(np.int64).tolist())


def _sorted_suffixes(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` codes at least; equal ones in any order."""
    n, width = len(codes), 7
    padded = np.concatenate([codes, np.zeros(width, codes.dtype)]).astype(np.int64)
    packed = np.zeros(n, np.int64)
    for j in range(width):
        packed = (packed << 9) | padded[j : j + n]
    order = np.argsort(packed, kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = packed[order[1:]] != packed[order[:-1]]
    rank = np.full(n + 1, -1, np.int64)
    while True:
        places = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        rank[order] = places
        tied = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
        if width >= depth or not len(tied):
            return order
        later = rank[np.minimum(order[tied] + width, n)]
        moved = tied[np.lexsort((later, places[tied]))]
        order[tied], following = order[moved], rank[np.minimum(order[moved] + width, n)]
        fresh[tied[1:]] |= following[1:] != following[:-1]
        width *= 2


def _unset_prefixes(last: np.ndarray, least: int) -> np.ndarray:
    """Whether a suffix shares ``least`` codes or more with the one before it, by backward extension
    of the intervals of the transform ``last``: one of length l that ends where no value is known yet
    tells that the common prefix there is l. Each place is told once."""
    n = len(last)
    step = np.empty(n, np.int64)
    step[np.argsort(last, kind="stable")] = np.arange(n)
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(least):
        one = high - low == 1
        lows, highs = [step[low[one]]], [step[low[one]] + 1]
        wide, size = low[~one], (high - low)[~one]
        if len(wide):
            before = np.cumsum(size) - size
            rows = np.arange(size.sum()) + np.repeat(wide - before, size)
            code = (np.repeat(np.arange(len(wide)), size) << 9) | last[rows]
            order = np.argsort(code, kind="stable")
            code, goal = code[order], step[rows[order]]
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            lows.append(goal[first])
            highs.append(goal[np.append(first[1:], len(code)) - 1] + 1)
        low, high = np.concatenate(lows), np.concatenate(highs)
        fresh = ~known[high]
        low, high = low[fresh], high[fresh]
        known[high] = True
        if not len(low):
            break
    return ~known[:n]


def repeated_windows(pieces: list[bytes], least: int) -> list[np.ndarray]:
    """For each piece, which of its windows occur more than once in all pieces."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    codes = np.frombuffer(b"\0".join(pieces) + b"\0\0", np.uint8).astype(np.int64) + 2
    codes[ends], codes[-1] = 1, 0  # a mark ends each piece, the smallest code the text
    order = _sorted_suffixes(codes, least)
    same = np.flatnonzero(_unset_prefixes(codes[order - 1], least))
    found = np.zeros(len(codes), bool)
    found[order[same]] = found[order[same - 1]] = True
    starts = ends - sizes
    return [found[s : s + n - least + 1] for s, n in zip(starts.tolist(), sizes.tolist())]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of the runs that are set."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist()))


def _digest(raw: bytes, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(raw, seed=seed) - (1 << 63)


_PIECE = "text_id binary, key long, digest long, first int, last int, anchor int, n long"
_PIECE_TYPES = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
_NAMES = [f.split()[0] for f in _PIECE.split(", ")]


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names=names)


def _pieces(least: int):
    """A text's different pieces with their occurrences; and, without a key, the windows of those
    that it repeats itself."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for text_id, raw, copies in zip(*(batch.column(i) for i in range(3))):
                raw, text_id, copies = raw.as_py(), text_id.as_py(), copies.as_py()
                met: dict[tuple[int, int], list] = {}
                for first, last, anchor, key in pieces_of(raw, least):
                    met.setdefault((key, _digest(raw[first : last + least])), []).append((first, last, anchor))
                own = np.zeros(max(len(raw) - least + 1, 0), bool) if any(len(x) > 1 for x in met.values()) else None
                for (key, digest), places in met.items():
                    out.append((text_id, key, digest, *places[0], len(places) * copies))
                    if len(places) > 1:
                        for first, last, _ in places:
                            own[first : last + 1] = True
                if own is not None:
                    out += [(text_id, None, None, a, b, None, 2) for a, b in _runs(own)]
                if len(out) > 20000:
                    yield _batch(out, _PIECE_TYPES, _NAMES)
                    out = []
            yield _batch(out, _PIECE_TYPES, _NAMES)

    return run


def _finer(least: int, width: int):
    """Pieces cut by the distance of their windows from the anchor, ``width`` distances each, and
    keyed by what all windows of such distances share. ``piece`` begins at the first window."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for text_id, first, last, anchor, n, piece in zip(*(batch.column(i).to_pylist() for i in range(6))):
                for group in range((anchor - last) // width, (anchor - first) // width + 1):
                    a, b = max(first, anchor - (group + 1) * width + 1), min(last, anchor - group * width)
                    core = piece[anchor - group * width - first : anchor - (group + 1) * width + 1 + least - first]
                    out.append((text_id, _digest(core, group + 1), _digest(piece[a - first : b + least - first]), a, b, anchor, n))
                if len(out) > 20000:
                    yield _batch(out, _PIECE_TYPES, _NAMES)
                    out = []
            yield _batch(out, _PIECE_TYPES, _NAMES)

    return run


def _recurring(pieces: DataFrame) -> DataFrame:
    """The pieces whose keys occur more than once, a small part of all: only keys are counted for it, before
    the shuffle."""
    keys = pieces.groupBy("key").agg(F.sum("n").alias("_n")).filter("_n > 1").select("key")
    return stored(pieces.join(keys, "key", "left_semi").select(*_NAMES), "dedup-recurring")


def _kinds(pieces: DataFrame) -> DataFrame:
    """A row per kind of piece: one place of it, how many occurrences (n), how many kinds its key has, and
    how many of these occur once. Counted before the shuffle, so copies and common keys meet as counts."""
    of = F.struct("text_id", "first", "last", "anchor")
    kinds = stored(pieces.groupBy("key", "digest").agg(F.sum("n").alias("n"), F.min(of).alias("at")), "dedup-kinds")
    keys = kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("lone"))
    return stored(kinds.join(keys, "key").select("key", "digest", "n", "at.*", "kinds", "lone"), "dedup-repeats")


def _with_bytes(rows: DataFrame, texts: DataFrame, least: int) -> DataFrame:
    """Adds each row's ``piece``. Texts lie in buckets by their ids, so only the light rows move."""
    piece = F.substring("raw", F.col("first") + 1, F.col("last") - F.col("first") + least)
    return rows.join(texts.select("text_id", "raw"), "text_id").select(*rows.columns, piece.alias("piece"))


def _searched(rows: DataFrame, least: int) -> DataFrame:
    """(text_id, first, last): runs of windows, of pieces that occur once, that other pieces of their
    key have too. Keys come whole, some hundred pieces at most each."""

    def run(batches):
        held: list[tuple] = []
        size, key = 0, None

        def settle():
            out = []
            for (_, n, text_id, first, piece), flags in zip(held, repeated_windows([h[4] for h in held], least)):
                if n == 1:
                    out += [(text_id, first + a, first + b) for a, b in _runs(flags)]
            return _batch(out, [pa.binary(), pa.int32(), pa.int32()], ["text_id", "first", "last"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != key and size >= BLOCK:
                    yield settle()
                    held, size = [], 0
                key = row[0]
                held.append(row)
                size += len(row[4])
        if held:
            yield settle()

    line = rows.select("key", "n", "text_id", "first", "piece").repartition(parallelism(rows.sparkSession), "key").sortWithinPartitions("key")
    return line.mapInArrow(run, "text_id binary, first int, last int")


def text_id_of(text: Column) -> Column:
    """Names a text by its content: equal texts are one."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def _bucketed(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` as a table in the shared folder with a bucket per shuffle partition, so that joins on
    ``key`` leave it in place."""
    spark = rows.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    rows.write.option("path", fresh_path(spark, "bucketed")).option("compression", "zstd").bucketBy(parallelism(spark), key).format("parquet").saveAsTable(name)
    return spark.table(name)


def _texts(docs: DataFrame) -> DataFrame:
    """(text_id, raw, n): each different text once, and the rows that have it."""
    rows = docs.select(text_id_of(F.col("text")).alias("text_id"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    return _bucketed(rows.groupBy("text_id").agg(F.first("raw").alias("raw"), F.count("*").alias("n")), "text_id")


def _marks(texts: DataFrame, least: int) -> DataFrame:
    """(text_id, first, last): runs of windows that repeat. Texts of several rows are left out, as all
    their windows do."""
    long = texts.filter(F.octet_length("raw") >= least)
    pieces = stored(long.select("text_id", "raw", "n").mapInArrow(_pieces(least), _PIECE), "dedup-pieces")
    marks = pieces.filter("key IS NULL").select("text_id", "first", "last")
    pieces = pieces.filter("key IS NOT NULL")
    for width in (*FINER, 0):
        pieces = _recurring(pieces)
        kinds = _kinds(pieces)
        repeats = kinds.filter("n > 1").select("key", "digest")
        marks = marks.unionByName(pieces.filter("n = 1").join(repeats, ["key", "digest"]).select("text_id", "first", "last"))
        open_kinds = kinds.filter("kinds > 1 AND lone > 0")
        few = _with_bytes(open_kinds.filter(F.col("kinds") <= MANY), texts, least)
        marks = marks.unionByName(stored(_searched(few, least), "dedup-found"))
        many = open_kinds.filter(F.col("kinds") > MANY)
        if not width or not many.head(1):
            break
        finer = _with_bytes(many, texts, least).select("text_id", "first", "last", "anchor", "n", "piece")
        pieces = stored(finer.mapInArrow(_finer(least, width), _PIECE), "dedup-pieces")
    return marks


def _cut(least: int, keep: bool):
    """A text's figures, from its windows that repeat, and what is left of it."""

    def run(batches):
        for batch in batches:
            out = []
            for text_id, raw, copies, runs in zip(*(batch.column(i) for i in range(4))):
                raw, runs = raw.as_py(), runs.as_py() or []
                gone = np.zeros(len(raw) + 1, np.int32)
                if copies.as_py() > 1 and len(raw) >= least:
                    runs = [{"first": 0, "last": len(raw) - least}]
                for r in runs:
                    gone[r["first"]] += 1
                    gone[r["last"] + least] -= 1
                covered = np.cumsum(gone[:-1]) > 0
                kept = np.frombuffer(raw, np.uint8)[~covered].tobytes()
                out.append((text_id.as_py(), len(raw), len(raw) - len(kept), len(_runs(covered)), hashlib.sha256(kept).hexdigest(), kept if keep else None))
            yield _batch(out, [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()], ["text_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def deduplicated(docs: DataFrame, least: int = LEAST, keep: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row of ``docs(doc_id, text)``:
    what is left of its text in UTF-8, as bytes, since a cut may fall inside a character; null
    without ``keep``.

    A null text is empty. Nothing goes of a text of fewer than ``least`` bytes; a text that several
    rows have, whatever their ids, repeats itself and goes. Other columns are not read. No rows
    give none.
    """
    texts = _texts(docs)
    runs = _marks(texts, least).groupBy("text_id").agg(F.collect_list(F.struct("first", "last")).alias("runs"))  # as many as its text has pieces
    cut = texts.join(runs, "text_id", "left").select("text_id", "raw", "n", "runs").mapInArrow(_cut(least, keep), "text_id binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    named = docs.select("doc_id", text_id_of(F.col("text")).alias("text_id"))
    return named.join(stored(cut, "dedup-cut"), "text_id").drop("text_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"), keep=False).drop("kept")


#: Windows are slices of bytes; what is kept is put together in hexadecimal, where a byte is two characters.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS t, encode(coalesce(text, '')) AS raw FROM documents),
w AS (SELECT r, i, md5_number(raw[i + 1 : i + {LEAST}]) AS g FROM (SELECT r, raw, unnest(range(0, octet_length(raw) - {LEAST - 1})) AS i FROM d)),
g AS (SELECT g FROM w GROUP BY g HAVING count(*) > 1),
s AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS gap FROM w SEMI JOIN g USING (g)),
u AS (SELECT r, i, sum(CASE WHEN gap <= {LEAST} THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS span FROM s),
c AS (SELECT r, min(i) AS a, max(i) + {LEAST} AS b FROM u GROUP BY r, span),
k AS (SELECT r, lag(b, 1, 0) OVER o AS a, a AS b FROM c WINDOW o AS (PARTITION BY r ORDER BY a) UNION ALL SELECT r, max(b), NULL FROM c GROUP BY r),
x AS (SELECT r, string_agg(substr(t, CAST(2 * a + 1 AS BIGINT), CAST(2 * (coalesce(b, length(t) // 2) - a) AS BIGINT)), '' ORDER BY a) AS kept FROM k JOIN d USING (r) GROUP BY r),
n AS (SELECT r, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM c GROUP BY r)
SELECT doc_id, length(t) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, t))) AS kept_sha256 FROM d LEFT JOIN n USING (r) LEFT JOIN x USING (r)"""
