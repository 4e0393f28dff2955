import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from siftwright.llm import suffix_dedup as sd


def windows(raws, least):
    return Counter(raw[i : i + least] for raw in raws for i in range(len(raw) - least + 1))


def brute(texts, least):
    raws = [(t or "").encode() for t in texts]
    seen, out = windows(raws, least), []
    for raw in raws:
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - least + 1):
            if seen[raw[i : i + least]] > 1:
                gone[i : i + least] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def told(spark, texts, least, ids=None):
    ids = ids or list(range(len(texts)))
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").withColumn("raw", F.lit(1)).withColumn("n", F.lit(2))
    rows = sd.deduplicated(docs, least).collect()
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in rows), key=str)


def want(texts, least, ids=None):
    return sorted(((i, *r) for i, r in zip(ids or range(len(texts)), brute(texts, least))), key=str)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**9), st.sampled_from([16, 21, 40]))
def test_blocks_against_all_windows(seed, least):
    r = random.Random(seed)
    base = bytes(r.choice(b"ab\x00\xff") for _ in range(150))
    pieces = [base[a : a + r.randint(least, 70)] + bytes(r.choice(b"ab") for _ in range(r.randint(least, 60))) for a in (r.randint(0, 90) for _ in range(r.randint(1, 9)))]
    pieces += [p * 2 for p in pieces[:1]]
    seen = windows(pieces, least)
    for piece, flags in zip(pieces, sd.repeated_windows(pieces, least)):
        assert flags.tolist() == [seen[piece[i : i + least]] > 1 for i in range(len(piece) - least + 1)]


def test_pieces_hold_each_window_once(monkeypatch):
    monkeypatch.setattr(sd, "CHUNK", 700)
    for raw in (bytes(random.Random(1).randbytes(5000)), b"a" * 3000, b"abcde" * 500, b"x" * 50, b"x" * 49, b""):
        met = [i for first, last, _, _ in sd.pieces_of(raw, 50) for i in range(first, last + 1)]
        assert met == list(range(len(raw) - 49))
        assert all(first <= anchor or last <= anchor <= first + 50 for first, last, anchor, _ in sd.pieces_of(raw, 50))


def sample(seed, docs, least):
    """Texts with shared passages, periodic parts, parts repeated within a text, and copies."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 9)))
    passages = [" ".join(word() for _ in range(least // 3)) for _ in range(4)]
    out = []
    for _ in range(docs):
        parts = [" ".join(word() for _ in range(r.randint(0, 30))) for _ in range(3)]
        parts.insert(r.randint(0, 3), r.choice([*passages, "ab" * least, passages[0] * 2, ""]))
        out.append(" ".join(parts)[: r.choice([10**6, 10**6, least - 1, least])])
    return [*out, out[0], out[0], None, "", "q" * (least - 1), "q" * least, "z" * 3 * least]


@pytest.mark.parametrize("seed, least", [(1, 30), (2, 50), (3, 64)])
def test_against_all_windows(spark, seed, least):
    texts = sample(seed, 60, least)
    assert told(spark, texts, least) == want(texts, least)


@pytest.mark.parametrize("many", [1, 3])
def test_keys_of_many_pieces_are_cut_finer(spark, monkeypatch, many):
    monkeypatch.setattr(sd, "MANY", many)
    monkeypatch.setattr(sd, "BLOCK", 100)
    r = random.Random(7)
    line = "a line that stands in very many texts, each time beside other words "
    texts = [" ".join(r.choice(["one", "two", "three", "four"]) for _ in range(r.randint(5, 25))) + line + " ".join(r.choice(["one", "two", "six"]) for _ in range(r.randint(5, 25))) for _ in range(60)]
    assert told(spark, texts, 80) == want(texts, 80)


def test_repeated_and_null_ids_and_no_rows(spark):
    texts, ids = ["x" * 40 + str(i % 2) * 40 for i in range(6)] + ["é" * 30], [1, 1, None, None, 2, 3, 3]
    assert told(spark, texts, 32, ids) == want(texts, 32, ids)
    assert told(spark, [], 32) == []
