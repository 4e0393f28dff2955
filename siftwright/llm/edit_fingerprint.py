"""Document fingerprints by a randomised edit embedding.

A walk reads a text: at each step it outputs the character under it and then moves on, or not, by
a random bit that hangs on the step and the character. All texts share the bits. Texts within a
few edits fall back into step, so their outputs differ in few places: edit distance becomes
Hamming distance.

A fingerprint samples the output at fixed random steps, as four-bit digits. The range of steps is
a power of two that fits the text's length; a second block samples half that range, so texts whose
lengths straddle a power of two still have a range in common. Digits behind a text's end are dots.

Banding over the sampled digits finds near texts, and a bit-parallel edit distance verifies them.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from siftwright.llm.common import cut, map_texts, parallelism, stored, table
from siftwright.llm.near_dedup import components

#: Digits of each of the two blocks; the bits of the walk repeat after PERIOD steps.
DIGITS, PERIOD, SEED = 256, 4096, 11
#: Characters are hashed to so many classes, each with its own bits.
CLASSES = 64
#: Digits of a band, and the edit similarity of links unless it is given.
BAND, LEAST = 6, 0.9
#: Rounds with pivots before the rest of a band is compared, and texts of a block in that.
ROUNDS, BLOCK = 3, 128
_HASH = np.uint32(2654435761)


@lru_cache(maxsize=1)
def waits() -> list[list[int]]:
    """For each class and step (within the period), the steps until the walk has moved on."""
    bits = np.random.default_rng(SEED).integers(0, 2, (CLASSES, PERIOD), dtype=np.int8)
    bits[:, -1] = 1  # ends every wait
    out = []
    for row in np.concatenate([bits, bits], 1):
        nexts = np.where(row == 1, np.arange(2 * PERIOD), 2 * PERIOD)
        nexts = np.minimum.accumulate(nexts[::-1])[::-1]
        out.append((nexts[:PERIOD] - np.arange(PERIOD) + 1).tolist())
    return out


@lru_cache(maxsize=64)
def sampled(exponent: int) -> np.ndarray:
    """The steps sampled from the first 2 ** exponent, in order."""
    return np.sort(np.random.default_rng((SEED, exponent)).integers(0, 1 << exponent, DIGITS))


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def walk(codes: np.ndarray, start: int = 0) -> tuple[np.ndarray, int]:
    """The step at which the walk reaches each character, and the step at which it has left the
    last one."""
    rows, mask, t, times = waits(), PERIOD - 1, start, []
    add = times.append
    for c in ((codes * _HASH) >> np.uint32(26)).tolist():
        add(t)
        t += rows[c][t & mask]
    return np.array(times, dtype=np.int64), t


def digits_of(codes: np.ndarray, times: np.ndarray, end: int, exponent: int) -> str:
    steps = sampled(exponent)
    inside = int(np.searchsorted(steps, end))
    at = np.searchsorted(times, steps[:inside], side="right") - 1
    nibbles = (codes[at] * _HASH) >> np.uint32(28) if inside else np.zeros(0, dtype=np.uint32)
    return "".join(map("0123456789abcdef".__getitem__, nibbles.tolist())) + "." * (DIGITS - inside)


def fingerprint_of(codes: np.ndarray, times: np.ndarray, end: int) -> str:
    """``exponent:digits:digits`` over the text's range and half of it. The range fits twice the
    length, which is how long a walk takes on average."""
    exponent = max(1, (2 * len(codes)).bit_length())
    return f"{exponent:02d}:{digits_of(codes, times, end, exponent)}:{digits_of(codes, times, end, exponent - 1)}"


def fingerprint(text: str | None) -> str:
    codes = codes_of(text or "")
    return fingerprint_of(codes, *walk(codes))


def likeness(a: str, b: str) -> float:
    """Share of equal digits among those that stand for text in either; 0 if the ranges have
    nothing in common, 1 for equal fingerprints."""
    if a == b:
        return 1.0
    (ea, fa, ga), (eb, fb, gb) = a.split(":"), b.split(":")
    d = int(ea) - int(eb)
    if abs(d) > 1:
        return 0.0
    x, y = (fa, fb) if d == 0 else (ga, fb) if d == 1 else (fa, gb)
    u, v = np.frombuffer(x.encode(), dtype=np.uint8), np.frombuffer(y.encode(), dtype=np.uint8)
    used = (u != 46) | (v != 46)
    return float(((u == v) & used).sum() / max(1, used.sum()))


class Walked:
    """A document on its way through ``with_edits``."""

    __slots__ = ("codes", "doc_id", "end", "mark", "text", "times")

    def __init__(self, doc_id, text: str):
        self.doc_id, self.text, self.codes = doc_id, text, codes_of(text)
        self.times, self.end = walk(self.codes)
        self.mark = fingerprint_of(self.codes, self.times, self.end)

    def row(self, follower: str, follower_mark: str) -> tuple:
        """The document beside the next one. The walk over the edited text shares its beginning
        with the walk over the text."""
        n, m = len(self.codes), len(self.codes) // 3
        taken = follower[:m]
        edited = self.text[: n - m] + taken
        tail = codes_of(taken)
        codes = np.concatenate([self.codes[: n - m], tail])
        times, end = walk(tail, int(self.times[n - m]) if m else self.end)
        mark = fingerprint_of(codes, np.concatenate([self.times[: n - m], times]), end)
        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return (self.doc_id, n, digest, self.mark, mark, likeness(self.mark, mark), likeness(self.mark, follower_mark))


FIELDS = "doc_id {id}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness; see FIELDS.

    The edited text has its last third (rounded down) replaced by the beginning of the next
    document in descending order of doc_id; after the last comes the first. A null text is empty.
    Rows that repeat an id follow each other in the order of a hash of their texts, and then of these; a
    null id comes last.

    Texts move once, by ranges of that order, which cut an id that many rows have, and rows that are equal
    by a number of their own. Each task fingerprints its run of documents as it streams
    by, one document behind; the last of a run waits for the first of the next run. Those two rows
    of each task are kept aside, in the same stored result, and joined afterwards: as many rows
    as tasks.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    fields = FIELDS.format(id=kind)
    names = [x.split()[0] for x in fields.split(", ")]
    schema = f"{fields}, part int, text string"
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    ranged = base.repartitionByRange(parallelism(spark), F.desc_nulls_last("doc_id"), "_hash", "_row")
    ranged = ranged.sortWithinPartitions(F.desc_nulls_last("doc_id"), "_hash", "text", "_row").select("doc_id", "text")

    def run(batches):
        part = TaskContext.get().partitionId()
        waiting: Walked | None = None
        arrow = None

        def batch_of(rows):
            return pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], type=t) for i, (n, t) in enumerate(arrow)})

        def aside(doc: Walked, first: bool):
            """A row kept aside: the first of a run is known by its null n_chars."""
            return (doc.doc_id, None if first else len(doc.codes), None, doc.mark, None, None, None, part, doc.text)

        for batch in batches:
            if arrow is None:
                kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string()]
                arrow = list(zip([*names, "part", "text"], kinds))
            rows = []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                doc = Walked(doc_id.as_py(), text.as_py())
                if waiting is None:
                    rows.append(aside(doc, True))
                else:
                    rows.append((*waiting.row(doc.text, doc.mark), None, None))
                waiting = doc
            yield batch_of(rows)
        if waiting is not None:
            yield batch_of([aside(waiting, False)])

    done = stored(ranged.mapInArrow(run, schema), "edit-fingerprints")
    kept = done.filter("part IS NOT NULL")
    firsts = kept.filter("n_chars IS NULL")
    heads = firsts.select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_mark"))
    along = Window.orderBy("part")  # a row per task
    turn = firsts.select("part", F.coalesce(F.lead("part").over(along), F.min("part").over(Window.partitionBy())).alias("next_part"))
    pairs = kept.filter("n_chars IS NOT NULL").select("doc_id", "part", "text").join(turn, "part").join(heads, "next_part")

    def finish(batches):
        for batch in batches:
            rows = [Walked(i.as_py(), t.as_py()).row(n.as_py(), m.as_py()) for i, t, n, m in zip(*(batch.column(k) for k in range(4)))]
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], type=t) for i, (n, t) in enumerate(zip(names, kinds))})

    last = pairs.select("doc_id", "text", "next_text", "next_mark").mapInArrow(finish, fields)
    return done.filter("part IS NULL").select(*names).unionByName(last)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each text, without a shuffle."""
    return map_texts(docs, lambda: lambda texts: [pa.array([fingerprint(t) for t in texts], pa.string())], "fingerprint string")


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance, a whole column of the table at a time in the bits of one integer. Once
    it must exceed ``most``, some larger number."""
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    n, ones = len(a), (1 << len(a)) - 1
    up, down, distance, left = ones, 0, n, len(b)
    for c in b:
        if most is not None and distance - left > most:
            return distance - left
        left -= 1
        eq = at.get(c, 0)
        x = eq | down
        d = ((((eq & up) + up) ^ up) | eq) & ones
        plus, minus = (down | ~(d | up)) & ones, up & d
        distance += (plus >> (n - 1) & 1) - (minus >> (n - 1) & 1)
        plus, minus = (plus << 1 | 1) & ones, minus << 1 & ones
        up, down = (minus | ~(x | plus)) & ones, plus & x
    return distance


def open_bands(bands: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, component) of the bands that hold several components."""
    known = bands.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    several = known.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).filter("low < high AND n > 2")
    return known.join(several.select("key"), "key", "left_semi")


def pivoted(rest: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of each band's pivot of this turn with the members of other components."""
    order = F.struct(F.xxhash64("node", F.lit(turn)), F.col("node"), F.col("component"))
    pivots = rest.groupBy("key").agg(F.min(order).alias("p")).select("key", F.col("p.node").alias("a"), F.col("p.component").alias("of"))
    return rest.join(pivots, "key").filter("component <> of").select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()


def near_pairs(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """Links (a, b, similarity) between documents within edit similarity ``least``: one less the
    edit distance over the longer length.

    The embedding holds small distances: of texts with scattered edits, a shared band is found for
    nine in ten links or more at a similarity of 0.9, and for fewer below.

    Texts that share the digits of some band, in either block, are candidates. Each is verified
    against the smallest id of its band; rounds with other pivots go over the bands that still
    hold several components, and at last the members of different components that are left in a
    band are compared, block against block. So a large group yields as many pairs as members for
    each of its bands and not all pairs, but its components are those of all links among
    candidates. Equal texts are one class, named by its smallest id, which is linked to each copy. Rows
    that repeat an id are texts of their own; links within an id are left out. Empty texts, null ids
    and texts are linked with nothing; an empty table gives none.
    """
    base = docs.select("doc_id", "text").filter("doc_id IS NOT NULL AND length(text) > 0")
    whole = base.withColumn("same", F.sha2("text", 256))
    classes = stored(whole.groupBy("same").agg(F.min("doc_id").alias("first")), "edit-names")
    copies = whole.select("doc_id", "same").join(classes, "same").filter("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"), F.lit(1.0).alias("similarity"))
    first = whole.join(classes, (whole["same"] == classes["same"]) & (whole["doc_id"] == classes["first"]), "left_semi")
    one = stored(first.select(F.col("same").alias("doc_id"), "text").dropDuplicates(["doc_id"]), "edit-classes")
    parts = F.split("fingerprint", ":")
    marked = fingerprints(one).select("doc_id", parts[0].cast("int").alias("exponent"), parts[1].alias("full"), parts[2].alias("half"))
    blocks = marked.select("doc_id", F.explode(F.array(F.struct("exponent", F.col("full").alias("digits")), F.struct((F.col("exponent") - 1).alias("exponent"), F.col("half").alias("digits")))).alias("x"))
    bands = blocks.select("doc_id", "x.exponent", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(DIGITS // BAND - 1)), lambda i: F.substring(F.col("x.digits"), i * BAND + 1, F.lit(BAND)))).alias("band", "digits"))
    bands = bands.filter(~F.contains("digits", F.lit("."))).select("doc_id", F.xxhash64("exponent", "band", "digits").alias("key"))
    least_ids = bands.groupBy("key").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).filter("n > 1")
    bands = cut(bands.join(least_ids, "key").select("key", F.col("doc_id").alias("node"), "a"))
    kind = "string"
    texts = lambda name: one.select(F.col("doc_id").alias(name), F.col("text").alias(f"text_{name}"))

    def verify(batches):
        for batch in batches:
            similar = [similarity(x.as_py(), y.as_py(), least) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(similar, pa.float64())], names=["a", "b", "similarity"])

    met = bands.filter("a <> node").select("a", F.col("node").alias("b")).distinct()
    found = labels = None
    for turn in range(ROUNDS + 1):
        if turn:
            rest = cut(open_bands(bands.select("key", "node"), labels))
            if rest.isEmpty():
                break
            met = pivoted(rest, turn)
        if turn < ROUNDS:
            joined = met.join(texts("b"), "b").join(texts("a"), "a").select("a", "b", "text_a", "text_b")
            linked = joined.mapInArrow(verify, f"a {kind}, b {kind}, similarity double")
        else:
            linked = _between(rest, one, kind, least)
        linked = cut(linked.filter(F.col("similarity") >= least))
        found = linked if found is None else found.unionByName(linked)
        if turn < ROUNDS:
            labels = components(found)
    names = lambda side: classes.select(F.col("same").alias(side), F.col("first").alias(f"{side}_id"))
    named = found.join(names("a"), "a").join(names("b"), "b").filter("a_id <> b_id")
    links = named.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), "similarity").distinct()
    return links.unionByName(copies)


def similarity(s: str, t: str, least: float) -> float:
    """One less the edit distance over the longer length; 0 if the lengths, or the characters'
    counts, leave it below ``least``."""
    longer = max(len(s), len(t))
    if 1 - abs(len(s) - len(t)) / longer < least or 1 - bag_distance(bag_of(s), bag_of(t)) / longer < least:
        return 0.0
    return 1 - edit_distance(s, t, int((1 - least) * longer) + 1) / longer


def bag_of(text: str) -> np.ndarray:
    """Counts of a text's characters by class."""
    return np.bincount((codes_of(text) * _HASH) >> np.uint32(26), minlength=CLASSES)


def bag_distance(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the edit distance: an edit adds one character, removes one, or both."""
    more = a - b
    return int(max(more[more > 0].sum(), -more[more < 0].sum()))


def _between(rest: DataFrame, one: DataFrame, kind: str, least: float) -> DataFrame:
    """Links between members of different components of a band, ``rest(key, node, component)``.

    Members of a band fall into blocks of about BLOCK; a group is a pair of blocks. A pair is
    compared in the first band that it shares, and only links leave the task.
    """
    keys = rest.groupBy("node").agg(F.collect_set("key").alias("keys"))
    blocks = rest.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = rest.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("low"), F.greatest("block", o).alias("high")))
    dealt = placed.withColumn("pair", F.explode(others)).select("key", "pair.low", "pair.high", "block", "node", "component")
    dealt = dealt.join(keys, "node").join(one.select(F.col("doc_id").alias("node"), "text"), "node").select("key", "low", "high", "block", "node", "component", "keys", "text")

    def compare(group: pa.Table) -> pa.Table:
        key, low, high = (group.column(i)[0].as_py() for i in range(3))
        block, node, part, keys, texts = (group.column(i).to_pylist() for i in range(3, 8))
        keys = [set(k) for k in keys]
        out = []
        for i in (i for i in range(len(node)) if block[i] == low):
            for j in (j for j in range(len(node)) if block[j] == high):
                if part[i] == part[j] or (low == high and node[i] >= node[j]) or min(keys[i] & keys[j]) != key:
                    continue
                near = similarity(texts[i], texts[j], least)
                if near >= least:
                    out.append((*sorted((node[i], node[j])), near))
        a, b, near = zip(*out) if out else ((), (), ())
        ids = group.schema.field("node").type
        return pa.table({"a": pa.array(a, ids), "b": pa.array(b, ids), "similarity": pa.array(near, pa.float64())})

    return dealt.groupBy("key", "low", "high").applyInArrow(compare, f"a {kind}, b {kind}, similarity double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edits(table(spark, sf_dir, "documents"))
