"""Language identification by compression.

A bounded sample of labelled text per language is a zstandard raw-content dictionary. A text is
compressed in blocks with each dictionary; the language whose dictionary gives the fewest bytes
wins. A decision whose margin is narrow is rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from siftwright.llm.common import crc_of, keep_texts, map_texts, table

#: Pieces of a sampled document that go into its language's dictionary, and characters of each.
PIECES, PIECE_CHARS = 4, 240
#: Documents sampled for each language, and sampled ids that may be broadcast.
SAMPLE_ROWS, BROADCAST_ROWS = 200, 100_000
#: Characters of text that are compressed together; level of compression.
BLOCK, LEVEL = 4096, 3
#: Relative margin between the two smallest sizes at which the score is a half, and the score
#: below which a decision is rejected.
HALF_MARGIN, REJECT_BELOW = 0.02, 0.2
UNDETERMINED = "und"


def learnable(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lang) of the rows that may be learned from."""
    return docs.select("doc_id", "text", "lang").filter((crc_of("doc_id") % 5 != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())


def sample(docs: DataFrame) -> DataFrame:
    """Training sample: of each language, the SAMPLE_ROWS documents first in hash order. Of each of
    them, pieces at places that a hash chooses anywhere in it, or all of a text that is no longer.

    Ids are ranked before any text is read, so the sort moves ids only, and a language that holds
    most rows is cut down in each task before it meets (the rank limit is pushed below the
    shuffle). The sample, and so what the driver holds, grows with the number of languages only;
    its ids are broadcast if they are at most BROADCAST_ROWS.
    """
    known = learnable(docs)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ranked = known.select("lang", "doc_id").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= SAMPLE_ROWS)
    chosen = ranked.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), "rank")
    if known.select("lang").distinct().count() * SAMPLE_ROWS <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    picked = known.join(chosen, (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")))
    room = F.greatest(F.lit(1), F.length("text") - PIECE_CHARS + 1)
    piece = lambda i: F.substring(F.col("text"), (F.pmod(F.xxhash64("doc_id", i), room) + 1).cast("int"), F.lit(PIECE_CHARS))
    pieces = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(PIECES)), piece), "\n")
    return picked.select("lang", "rank", F.when(F.length("text") <= PIECES * PIECE_CHARS, F.col("text")).otherwise(pieces).alias("text"))


def dictionaries(docs: DataFrame) -> dict[str, bytes]:
    """Raw dictionary content by language, those with the most documents to learn from first; every
    label is learned, from all of its sample, whatever its script. A dictionary has SAMPLE_ROWS texts of
    about PIECES * PIECE_CHARS characters at most. An empty table gives none."""
    rows = sorted((r["lang"], r["rank"], r["text"]) for r in sample(docs).collect())
    counts = learnable(docs).groupBy("lang").count().collect()
    out: dict[str, bytearray] = {r["lang"]: bytearray() for r in sorted(counts, key=lambda r: (-r["count"], r["lang"]))}
    for lang, _, text in rows:
        out[lang] += text.lower().encode("utf-8", "replace") + b"\n"
    return {k: bytes(v) for k, v in out.items()}


class Sizes:
    """Compressed sizes of a text under each dictionary, in the order of ``content``."""

    def __init__(self, content: dict[str, bytes]):
        self.langs = list(content)
        self.by: list[zstandard.ZstdCompressor] = []
        for lang in self.langs:
            prepared = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            prepared.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=prepared, write_checksum=False, write_content_size=False, write_dict_id=False))

    def of(self, text: str) -> np.ndarray:
        total = np.zeros(len(self.langs), dtype=np.int64)
        for at in range(0, len(text), BLOCK):
            block = text[at : at + BLOCK].lower().encode("utf-8", "replace")
            total += [len(c.compress(block)) for c in self.by]
        return total

    def decide(self, text: str | None) -> tuple[str, float]:
        """(language, score). The score rises with the relative margin over the runner-up: a half
        at HALF_MARGIN, towards 1 beyond it. A lone language has no runner-up and scores 1."""
        if text is None or not self.langs or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        sizes = self.of(text)
        best = int(np.argmin(sizes))
        if len(sizes) == 1:
            return self.langs[best], 1.0
        second = int(np.partition(sizes, 1)[1])
        margin = (second - int(sizes[best])) / second
        return self.langs[best], margin / (margin + HALF_MARGIN) if margin > 0 else 0.0


def predict(docs: DataFrame, content: dict[str, bytes]) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every whole text of ``docs(doc_id, text)``.

    A null text, or one without letters, is ``und`` with score 0 and rejected. Ties go to the
    language with the most documents to learn from, with score 0. Without dictionaries every text is ``und``. A null
    id is not held out. Rows are independent of each other.
    """

    def make():
        sizes = Sizes(content)

        def work(texts):
            found = [sizes.decide(t) for t in texts]
            return [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]

        return work

    held = map_texts(docs, make, "lang_pred string, score double")
    return held.select("doc_id", F.coalesce(crc_of("doc_id") % 5 == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", (F.col("score") < REJECT_BELOW).alias("rejected"))


def accepted(docs: DataFrame, content: dict[str, bytes]) -> DataFrame:
    """The rows of ``docs`` whose language is clear."""

    def make():
        sizes = Sizes(content)
        return lambda text: sizes.decide(text)[1] >= REJECT_BELOW

    return keep_texts(docs, make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, dictionaries(docs))
