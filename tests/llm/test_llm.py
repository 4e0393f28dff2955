"""The operators against SQL, brute force, exact round trips and held-out rows."""

import gzip
import hashlib
import re
from itertools import combinations

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftwright.llm import ann, bpe, chat_format, edit_fingerprint, language_id, near_dedup, packing, quality, queries, secret_scan, trigrams, warc

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_tokens", F.lit(0)).withColumn("node", F.lit("x"))


ODD = [None, "", " ", "a", "a", "word " * 30000, "é漢字 \x00 x", "secret: abcdefgh1234"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    ours, theirs = queries.queries()[name](spark, SMALL).toPandas(), con.execute(queries.oracle_sql()[name]).fetchdf()
    cell = lambda x: "null" if pd.isna(x) else str(int(x)) if isinstance(x, (int, float, np.number)) and not isinstance(x, bool) else str(x)
    rows = lambda f: sorted(tuple(map(cell, r)) for r in f[sorted(f.columns)].astype(object).itertuples(index=False))
    assert rows(ours) == rows(theirs)


def brute_padding(lengths, buckets):
    points = sorted(set(lengths))
    best = None
    for k in range(min(buckets, len(points))):
        for inner in combinations(points[:-1], k):
            bounds = [*inner, points[-1]]
            pad = sum(min(b for b in bounds if b >= n) - n for n in lengths)
            best = pad if best is None else min(best, pad)
    return best


def test_packing(spark):
    rng = np.random.default_rng(1)
    lengths = rng.integers(0, 30, 60).tolist()
    out = packing.pack(docs_of(spark, ["w " * n for n in lengths]), budget=64, buckets=3).toPandas()
    assert sorted(out["n_tokens"]) == sorted(lengths) and out["pad"].sum() == brute_padding(lengths, 3)
    assert not out.duplicated(["batch_id", "slot"]).any()
    batches = out.groupby("batch_id").agg(n=("slot", "size"), b=("boundary", "max"), kinds=("boundary", "nunique"))
    assert (batches["kinds"] == 1).all() and ((batches["n"] * batches["b"] <= 64) | (batches["n"] == 1)).all()


def test_odd_rows(spark):
    """Null, empty, very long and repeated texts, clashing columns, empty tables."""
    docs = docs_of(spark, ODD)
    net, content = quality.Network(), {"x": b"word a", "y": b"zzz"}
    each = [packing.pack, secret_scan.scan, near_dedup.near_duplicates, lambda d: quality.predict(d, net), lambda d: language_id.predict(d, content), edit_fingerprint.fingerprints]
    for make in each:
        assert make(docs).count() == len(ODD)
        assert make(docs.limit(0)).count() == 0
    langs = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs, content).collect()}
    assert langs[0] == langs[1] == langs[2] == "und"
    kept = {r["doc_id"]: r["kept"] for r in near_dedup.near_duplicates(docs).collect()}
    assert kept[3] and not kept[4] and kept[0] and kept[1]


def test_secrets(spark):
    texts = ["api_KEY = 'abcdefgh' and AKIAABCDEFGHIJKL12 " + "0af" * 12, "password: short", "é token=ABCDEFGHIJ"]
    got = {r["doc_id"]: r for r in secret_scan.digests(docs_of(spark, texts)).collect()}
    assert (got[0]["n_assign"], got[0]["n_access"], got[0]["n_hex"]) == (1, 1, 1) and got[1]["spans"] == "" and got[2]["spans"] == "assign:2:18"
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redacted(docs_of(spark, texts)).collect()}
    assert clean[2] == "é [secret]" and clean[1] == texts[1]
    assert trigrams.query_of("[a-z]+") is True and "kia" in trigrams.grams_of(trigrams.query_of("AKIA[A-Z]+"))


def test_chat(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a<[\\x"), (1, 1, "assistant", "</s>[INST]"), (2, 0, "assistant", None), (3, 0, "odd<role", "t")], "conv_id long, turn int, role string, text string")
    got = {r["conv_id"]: r for r in chat_format.digests(rows).collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256("user\na<[\\x\nassistant\n</s>[INST]\n".encode()).hexdigest() and got[1]["valid"]
    assert got[1]["loss_sha256"] == hashlib.sha256(b"</s>[INST]").hexdigest() and not got[2]["valid"]
    assert got[3]["turns_sha256"] == hashlib.sha256(b"odd<role\nt\n").hexdigest()
    for r in chat_format.formatted(chat_format.with_trap(rows)).collect():
        assert r["formatted"] == "".join(s["text"] for s in r["segments"])
        if r["conv_id"] == chat_format.TRAP[0]:
            assert [s["text"].replace("<\\", "<").replace("[\\", "[") for s in r["segments"] if s["loss"]] == [chat_format.TRAP[1]] and r["valid"]
    assert chat_format.digests(rows.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    texts = [None, "", "x" * 200_000, "x" * 200_000, "é" * 70_000]
    pages = spark.createDataFrame([(i, "u\n" if i else None, t) for i, t in enumerate(texts)], "page_id long, url string, html string")
    manifest = warc.write(pages, f"file://{tmp_path}/w")
    back = warc.payloads(warc.read_chunks(manifest).filter("record_type = 'response'"))
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in back.collect()} == {0: "", 2: texts[2], 4: texts[4]}
    assert warc.read_chunks(warc.write(pages.limit(0), f"file://{tmp_path}/none")).count() == 0
    damaged = tmp_path / "damaged.warc.gz"
    whole = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Target-URI: u\r\nWARC-Payload-Digest: sha1:X\r\nX-Payload-Length: 1\r\nContent-Length: 1\r\n\r\na\r\n\r\n")
    damaged.write_bytes(whole)
    with pytest.raises(Exception, match="another digest"):
        warc.read_chunks(spark.createDataFrame([(f"file://{damaged}",)], "path string")).count()


@pytest.mark.parametrize("kind", ["long", "string"])
def test_warc_ids(spark, tmp_path, kind):
    """Ids past 2 ** 53, null and repeated ids, ids that are text."""
    one = lambda i: i if i is None or kind == "long" else f"p {i}/é>"
    big = 9007199254740993
    rows = [(one(big), "u", "same", 1), (one(big + 2), "u", "same", 2), (None, None, "same", 3), (one(7), "u", None, 4), (None, "u", "alone", 5), (None, "u", "alone", 5), (one(8), "u", "twice", 6), (one(8), "u", "twice", 6), (one(9), "u", "last", 7)]
    pages = spark.createDataFrame(rows, f"page_id {kind}, url string, html string, refers_to int")
    back = warc.read_chunks(warc.write(pages, f"file://{tmp_path}/w"), kind="bigint" if kind == "long" else kind)
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in back.collect()), key=str)
    revisit = lambda i: (one(i), "revisit", one(big), 4)
    want = [(one(big), "response", None, 4), revisit(big + 2), revisit(None), (one(7), "response", None, 0), *[(None, "response", None, 5)] * 2, *[(one(8), "response", None, 5)] * 2, (one(9), "response", None, 4)]
    assert got == sorted(want, key=str)


def test_bpe(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionByName(docs_of(spark, ODD).select((-1 - F.col("doc_id")).alias("doc_id"), "text"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in bpe.digests(docs, path).collect():
        ids = tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(" ".join(map(str, ids)))), r["doc_id"]
        assert r["decoded_sha256"] == sha(tok.decode(ids, skip_special_tokens=False))
    some = docs.filter("doc_id % 7 = 0")
    encoded = bpe.encode(some, path)
    back = {r["doc_id"]: r["text"] for r in bpe.decode(encoded, path).collect()}
    for r in encoded.collect():
        assert list(r["ids"]) == tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids and back[r["doc_id"]] == tok.decode(list(r["ids"]), skip_special_tokens=False)
    assert bpe.digests(docs.limit(0), path).count() == 0 and bpe.encode(docs.limit(0), path).count() == 0


def test_bpe_in_pieces(spark, monkeypatch):
    """A text longer than a block, and a memory that is often cleared, give the same digests."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").limit(20).collect()]
    vocab = bpe.Vocabulary(path)
    plain = [bpe.Encoder(vocab).encode(t) for t in texts]
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 50)
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 5)
    monkeypatch.setattr(bpe, "map_texts", lambda docs, make, fields: [c.to_pylist() for c in make()(iter(texts))])
    monkeypatch.setattr(bpe, "pieces", lambda text, own=bpe.pieces: own(text, 50))
    n, ids, _ = bpe.digests(None, path)
    assert n == [len(x) for x in plain] and ids == [hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest() for x in plain]


def test_near_neighbours(spark):
    rows = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    found = {}
    for r in queries.queries()["op10_ann"](spark, SMALL).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = total = 0
    for q in (i for i in rows if i % 20 == 0):
        best = sorted((-float(v @ rows[q]), i) for i, v in rows.items() if i != q)[:20]
        hits, total = hits + len({i for _, i in best} & found[q]), total + len(best)
    assert hits / total >= 0.9, hits / total


def test_held_out(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{MORE}/labels.parquet").collect()}
    rows = [r for r in queries.queries()["op4_quality"](spark, MORE).collect() if r["held_out"] and labels.get(r["doc_id"]) is not None]
    good, bad = ([r["score"] for r in rows if labels[r["doc_id"]] == v] for v in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{MORE}/documents.parquet").select("doc_id", "lang").collect()}
    told = [r for r in queries.queries()["op8_language_id"](spark, MORE).collect() if r["held_out"] and langs[r["doc_id"]] and r["lang_pred"] != "und"]
    right = np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in told])
    print("AUC", auc, "language", right)
    assert auc >= 0.97 and right >= 0.93


def test_fingerprints():
    a = "the quick brown fox jumps over the lazy dog " * 20
    f = edit_fingerprint.fingerprint
    assert f(a) == f(a) and edit_fingerprint.likeness(f(a), f(a)) == 1
    assert edit_fingerprint.likeness(f(a), f(a[:300] + "!" + a[301:])) > edit_fingerprint.likeness(f(a), f("zebra 12345 " * 70))


def groups_of(rows):
    """The ids of each component of two or more ids."""
    out = {}
    for r in rows:
        if r["doc_id"] is not None:
            out.setdefault(r["component_id"], set()).add(r["doc_id"])
    return sorted(sorted(ids) for ids in out.values() if len(ids) > 1)


def test_pair_that_never_meets_its_pivot(spark, monkeypatch):
    """One band of unlike documents and one pair: no pivot of the first rounds is in the pair."""
    monkeypatch.setattr(near_dedup, "banded", lambda classes: classes.select("node", F.lit(1).cast("long").alias("key")))
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10_000, 60)) for _ in range(40)]
    docs = docs_of(spark, [*texts, texts[7] + " more"])
    assert groups_of(near_dedup.near_duplicates(docs).collect()) == [[7, 40]]


def test_links_over_rows_without_id(spark):
    """A set whose rows have an id or none, or none at all, links its neighbours."""
    w = [f"w{i}" for i in range(100)]
    x, y, z = w[10:], w, w[:-12]
    u = [f"u{i}" for i in range(100)]
    rows = [(None, x), (3, x), (None, y), (None, y), (4, z), (None, u), (5, u), (6, u[3:])]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    assert groups_of(near_dedup.near_duplicates(docs).collect()) == [[3, 4], [5, 6]]


def test_dedup_stage_keeps_rows(spark):
    """Of rows that repeat an id or have none, each is kept or dropped for itself."""
    texts = {n: " ".join(f"{n}{i}" for i in range(100)) for n in "abcd"}
    rows = [(1, texts["a"]), (2, texts["a"] + " more"), (2, texts["b"]), (None, texts["a"]), (None, texts["c"]), (None, texts["c"]), (3, texts["d"]), (3, texts["d"]), (None, None), (4, ""), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.dedup_stage(spark, docs, SMALL)
    order = lambda r: str(tuple(r))
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=order) == sorted([rows[0], rows[2], rows[4], rows[6], *rows[8:]], key=order)


def test_near_pairs(spark):
    """Groups of links against brute force: a common opening (a hot band), pairs of which only the
    opening is alike band by band, and links at the threshold."""
    rng = np.random.default_rng(5)
    letters = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    opening = letters(120)
    texts = [opening + letters(280) for _ in range(20)]
    for i in (11, 14, 17):
        tail = list(texts[i])
        for at in rng.choice(np.arange(120, 400), 70, replace=False):
            tail[at] = "#"
        texts.append("".join(tail))
    texts += [texts[8] + letters(100), texts[9] + letters(101), "abcde", "abcd", None, "", texts[3]]
    near = edit_fingerprint.edit_distance
    some = [i for i, t in enumerate(texts) if t and len(t) > 9]
    brute = {(a, b) for a, b in combinations(some, 2) if 1 - near(texts[a], texts[b]) / max(len(texts[a]), len(texts[b])) >= 0.8}
    got = {(r["a"], r["b"]) for r in edit_fingerprint.near_pairs(docs_of(spark, texts), 0.8).collect() if r["a"] in some}
    assert got == brute == {(11, 20), (14, 21), (17, 22), (8, 23), (3, 29)} | {p for p in brute if 24 in p}
    assert edit_fingerprint.similarity("abcde", "abcd", 0.8) == 0.8


def test_near_neighbours_ties(spark):
    """More vectors tie at the cut than the short list holds: the smaller ids come first."""
    rows = [(i, [1.0 if i % 60 == d else 0.0 for d in range(60)] + [1.0]) for i in range(60)]
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5, every=30, recall=2.0).collect()
    got = {q: [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 30)}
    assert got == {0: [1, 2, 3, 4, 5], 30: [0, 1, 2, 3, 4]}


def test_large_groups(spark, monkeypatch):
    """A star of near copies, a chain and pairs under the threshold, over many blocks, against
    brute force over all pairs."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "FEW", 8)
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base)]
    for _ in range(150):  # copies with up to 12 words changed: some link to the base, some to others, some to none
        own = list(base)
        for at in rng.choice(120, rng.integers(1, 12), replace=False):
            own[at] = f"x{rng.integers(1 << 30)}"
        texts.append(" ".join(own))
    walk = [f"c{i}" for i in range(400)]
    texts += [" ".join(walk[i : i + 100]) for i in range(0, 300, 9)]  # each links to the next only
    for k in range(10):
        pair = [f"p{k}_{i}" for i in range(100)]
        texts += [" ".join(pair), " ".join(pair[: 100 - 20 - k])]  # 0.68 to 0.79
    sets = [set(near_dedup.shingles_of(t, 5).tolist()) for t in texts]
    label = list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == label
    assert len(set(label)) > 20


def test_sketches():
    """Sketches merge; links pass the bands and the estimate; the slope decides as the estimate."""
    rng = np.random.default_rng(7)
    x, y = (np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64)) for _ in range(2))
    both = near_dedup.sketch_of(np.union1d(x, y))
    assert (both == near_dedup.merged(near_dedup.sketch_of(x), near_dedup.sketch_of(y))).all()
    share, passed, met = [], [], []
    for j in np.repeat([0.3, 0.62, 0.8], 300):
        n = 270
        common = int(round(2 * n * j / (1 + j)))
        pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        u, v = pool[:n], np.concatenate([pool[:common], pool[n : 2 * n - common]])
        a, b = near_dedup.sketch_of(u)[None], near_dedup.sketch_of(v)[None]
        size = np.array([n])
        share.append(near_dedup.estimated(a, b, size, size)[0])
        passed.append(near_dedup.hopeful(a, b, size, size, 0.8)[0])
        met.append((a == b).reshape(near_dedup.BANDS, near_dedup.BAND).all(1).any())
        assert passed[-1] == (share[-1] >= 0.8 - near_dedup.SLACK) or (a == b).sum() < (0.8 - near_dedup.EQUAL_SLACK) * near_dedup.REGISTERS
    share = np.array(share).reshape(3, 300)
    assert np.abs(share.mean(1) - [0.3, 0.62, 0.8]).max() < 0.01 and share.std(1).max() < 0.05
    assert all(passed[600:]) and all(met[600:]) and not any(passed[:300])


def recall_of(spark, vectors, k=20, every=20):
    """Recall against brute force, and the share of rows that a query is compared with."""
    rows = spark.createDataFrame(pa.table({"vec_id": np.arange(len(vectors)), "embedding": list(vectors)}))
    found = {}
    for r in ann.search(rows, k, every).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = total = 0
    for q in range(0, len(vectors), every):
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        best = np.argpartition(-scores, k)[:k]
        hits, total = hits + len(found[q] & set(best.tolist())), total + k
    asked = rows.withColumn("point", F.col("vec_id")).withColumn("asked", F.col("vec_id") % every == 0)
    return hits / total, ann.fit(asked.select("point", "embedding", "asked"), k)[1].share


def test_near_neighbours_of_low_dimension(spark, monkeypatch):
    """Clustered vectors and vectors along a surface: few rows are compared, most neighbours found."""
    monkeypatch.setattr(ann, "SAMPLE", 8192)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(400, 32))
    clustered = centres[rng.integers(0, 400, 20_000)] + 0.05 * rng.normal(size=(20_000, 32))
    surface = np.tanh(rng.normal(size=(20_000, 3)) @ rng.normal(size=(3, 32))) + 0.005 * rng.normal(size=(20_000, 32))
    for name, vectors in (("clustered", clustered), ("surface", surface)):
        recall, share = recall_of(spark, vectors / np.linalg.norm(vectors, axis=1)[:, None])
        print(name, recall, share)
        assert recall >= 0.9 and share < 0.2, (name, recall, share)


def test_near_neighbours_without_structure(spark):
    """Vectors of no structure: windows are wide, and most neighbours are found all the same."""
    recall, share = recall_of(spark, np.random.default_rng(9).normal(size=(6000, 48)))
    print(recall, share)
    assert recall >= 0.9


def test_near_neighbours_odd(spark):
    """Null, zero, short and non-finite vectors, null and repeated ids, equal vectors, no rows."""
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0]), (1, [0.5]), (2, [-0.0, 1.0, 0.0]), (20, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [9.0, 9.0, 9.0]), (8, [1.0, 1.0, 0.0]), (8, [2.0, 0.0, 0.0]), (40, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("point", F.lit(1)).withColumn("query", F.lit("x"))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.search(table, k=4).collect()}
    assert got == {(0, 1): (8, 2.0), (0, 2): (8, 1.0), (0, 3): (1, 0.5), (0, 4): (2, 0.0), (20, 1): (2, 1.0), (20, 2): (8, 1.0), (20, 3): (0, 0.0), (20, 4): (1, 0.0)}
    assert ann.search(table.limit(0)).count() == 0
    few = spark.createDataFrame([(i, [float(i), 1.0 / (i + 1), float(i % 3)]) for i in range(19)], "vec_id long, embedding array<float>")
    assert ann.search(few, every=1).count() == 19 * 18


def test_near_pairs_recall(spark):
    """Texts with scattered edits of a tenth or less: nine in ten links or more are found; repeated
    ids lose nothing."""
    rng = np.random.default_rng(4)
    texts = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect() if r["text"] and 300 < len(r["text"]) < 2500][:60]
    rows = []
    for i, text in enumerate(texts):
        chars = list(text)
        for at in rng.choice(len(chars), int(len(chars) * rng.uniform(0.01, 0.095)), replace=False):
            chars[at] = ("#", "", chars[at] + "+")[rng.integers(3)]
        rows += [(2 * i, text), (2 * i + 1, "".join(chars))]
    rows += [(2, rows[1][1] + "!")]  # one more text under an id that is taken
    got = {(r["a"], r["b"]) for r in edit_fingerprint.near_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = np.mean([(2 * i, 2 * i + 1) in got for i in range(len(texts))])
    print("recall", found)
    assert found >= 0.9 and {(0, 2), (1, 2)} & got


def test_edited_texts(spark):
    """with_edits against a plain loop over the whole table, odd rows included."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionByName(docs_of(spark, ODD).select((-1 - F.col("doc_id")).alias("doc_id"), "text"))
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)
    want = {}
    for i, (doc_id, text) in enumerate(rows):
        follower, m = rows[(i + 1) % len(rows)][1], len(text) // 3
        edited = text[: len(text) - m] + follower[:m]
        f = [edit_fingerprint.fingerprint(x) for x in (text, edited, follower)]
        want[doc_id] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), f[0], f[1], edit_fingerprint.likeness(f[0], f[1]), edit_fingerprint.likeness(f[0], f[2]))
    got = {r["doc_id"]: tuple(r)[1:] for r in edit_fingerprint.with_edits(docs).collect()}
    assert got == want
    assert edit_fingerprint.with_edits(docs.limit(0)).count() == 0
    a, b = rows[3][1], rows[9][1]
    table = np.arange(len(b[:300]) + 1)
    for i, x in enumerate(a[:300]):
        new = [i + 1]
        for j, y in enumerate(b[:300]):
            new.append(min(table[j] + (x != y), table[j + 1] + 1, new[j] + 1))
        table = np.array(new)
    assert edit_fingerprint.edit_distance(a[:300], b[:300]) == table[-1] and edit_fingerprint.edit_distance(a[:300], b[:300], 5) > 5


def test_packing_of_rows_that_repeat(spark, monkeypatch):
    """Many rows of one id, and without id, are numbered in parts, each place once."""
    monkeypatch.setattr(packing, "CHUNK_ROWS", 10)
    docs = spark.createDataFrame([(7, "a b c")] * 300 + [(None, "a b")] * 300 + [(i, "a " * (i % 9)) for i in range(300)], "doc_id long, text string")
    out = packing.pack(docs, budget=64, buckets=4).toPandas()
    assert len(out) == 900 and not out.duplicated(["batch_id", "slot"]).any()
    size = out.groupby("batch_id").agg(n=("slot", "size"), b=("boundary", "max"), top=("slot", "max"))
    assert (size["n"] == size["top"] + 1).all() and ((size["n"] * size["b"] <= 64) | (size["b"] == 0)).all()


def test_packing_long(spark):
    """Lengths past the exact part of the histogram, against brute force over all choices."""
    rng = np.random.default_rng(2)
    lengths = [int(x) for x in rng.choice(np.arange(1, 60_000), 9, replace=False)] + [70_001, 131_075, 131_077]
    docs = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)] + [(None, 7)] * 40, "doc_id long, n long").withColumn("text", F.lit(None).cast("string"))
    out = packing.pack(docs, F.col("n"), budget=200_000, buckets=4).toPandas()
    assert sorted(out["n_tokens"]) == sorted(lengths + [7] * 40) and (out["pad"] >= 0).all()
    points, counts = np.unique(lengths + [7] * 40, return_counts=True)
    best = min(sum((min(b for b in (*inner, points[-1]) if b >= n) - n) * c for n, c in zip(points, counts)) for inner in combinations(points[:-1], 3))
    assert out["pad"].sum() == best


def test_network_over_naive_convolution():
    """Pooled values of the scorer's tables, and of training, against a plain loop."""
    net = quality.Network(np.random.default_rng(3))
    text = "naïve text " * 120
    raw, step = text.encode(), quality.CHUNK - quality.OVERLAP
    chunks = quality.chunks_of(raw)
    assert b"".join(bytes(c[:step].astype(np.uint8).tobytes()) for c in chunks)[: len(raw) - 200] == raw[: len(raw) - 200]
    naive = np.array([[max(sum(net.weights[k, c[at + k], f] for k in range(quality.WIDTH)) for at in range(0, quality.CHUNK - quality.WIDTH + 1)) for f in range(quality.FILTERS)] for c in chunks[:2]])
    naive = np.maximum(naive + net.bias, 0)
    assert np.allclose(net.pooled(chunks[:2])[0], naive, atol=1e-4) and np.allclose(quality.Scorer(net).pooled(chunks[:2]), naive, atol=1e-4)
    whole = np.concatenate([net.pooled(chunks)[0]])
    assert abs(quality.Scorer(net).score(text) - 1 / (1 + np.exp(-net.logit(whole)))) < 1e-5


def test_language_by_direct_sizes(spark):
    """Decisions against sizes taken without prepared dictionaries; rare labels are learned."""
    import zstandard

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    rare = spark.createDataFrame([(i, "xyzzy plugh frotz nitfol rezrov " * 3, "rare") for i in range(10_001, 10_006)], "doc_id long, text string, lang string")
    content = language_id.dictionaries(docs.unionByName(rare))
    assert "rare" in content and all(len(c.decode()) <= language_id.SAMPLE_ROWS * language_id.PIECES * (language_id.PIECE_CHARS + 1) for c in content.values())
    sizes = language_id.Sizes(content)
    for r in docs.limit(30).collect():
        text, direct = r["text"] or "", []
        for lang in sizes.langs:
            use = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            one = zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=use, write_checksum=False, write_content_size=False, write_dict_id=False)
            direct.append(sum(len(one.compress(text[at : at + language_id.BLOCK].lower().encode())) for at in range(0, len(text), language_id.BLOCK)))
        told, score = sizes.decide(r["text"])
        if any(map(str.isalpha, text)) and sorted(direct)[1] - min(direct) > 8:
            assert told == sizes.langs[int(np.argmin(direct))]
    assert sizes.decide("xyzzy plugh frotz rezrov nitfol xyzzy frotz")[0] == "rare"
    assert language_id.dictionaries(docs.limit(0)) == {}


def test_pipeline(spark):
    """What the pipeline returns, against plain loops over each stage's own input."""
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    source = spark.read.parquet(f"{SMALL}/documents.parquet")
    scorer = quality.Scorer(quality.train(source, labels))
    kept = {r["doc_id"]: r["text"] for r in source.collect() if scorer.score(r["text"]) >= 0.5}
    sizes = language_id.Sizes(language_id.dictionaries(source.filter(F.col("doc_id").isin(list(kept)))))
    kept = {i: t for i, t in kept.items() if sizes.decide(t)[1] >= language_id.REJECT_BELOW}
    sets = {i: set(near_dedup.shingles_of(t, 5).tolist()) for i, t in kept.items()}
    label = {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = {i: low if x == high else x for i, x in label.items()}
    kept = {i: t for i, t in kept.items() if label[i] == i}

    def clean(text):
        spans = []
        for rule in secret_scan.BASE + secret_scan.MORE:
            spans += [m.span() for m in re.finditer(rule.regex, text) if len(m.group(rule.group)) >= rule.least]
        out, at = "", 0
        for start, end in sorted(spans):
            if start >= at:
                out += text[at:start] + "[secret]"
            at = max(at, end)
        return out + text[at:]

    count = {i: len(clean(t or "").encode().split()) for i, t in kept.items()}
    out = corpus_pipeline.run(spark, SMALL).toPandas()
    assert dict(zip(out["doc_id"], out["n_tokens"])) == count and len(out) == len(count) > 50
    points = sorted(set(count.values()))
    lengths = np.array(sorted(count.values()))
    assert set(out["boundary"]) <= set(points) and (out["pad"] >= 0).all() and not out.duplicated(["batch_id", "slot"]).any()
    one = {n: packing.boundaries([(int(p), int((lengths == p).sum()), int(p * (lengths == p).sum())) for p in points], n) for n in (packing.BUCKETS,)}[packing.BUCKETS]
    assert sorted(set(out["boundary"])) == one
    batches = out.groupby("batch_id").agg(n=("slot", "size"), b=("boundary", "max"))
    assert ((batches["n"] * batches["b"] <= packing.TOKEN_BUDGET) | (batches["n"] == 1)).all()


def test_pipeline_odd_rows(spark):
    """Each stage on null, empty, long and repeated rows, clashing columns, and no rows."""
    docs = docs_of(spark, ODD).withColumns({"lang": F.lit("x"), "source": F.lit(None).cast("string"), "n_chars": F.lit(1), "secrets": F.lit(1)})
    docs = docs.unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")))
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, SMALL)
            assert out.count() <= rows.count() and (name == "packing" or out.columns == rows.columns)


def test_dictionaries_keep_every_sampled_text(spark):
    """A script of two bytes a character has as many characters to learn from as one of one byte."""
    rng = np.random.default_rng(3)
    text = lambda letters, i: f"{i} " + "".join(rng.choice(list(letters), 3000))
    rows = [(2 * i + k, text(letters, i), lang) for i in range(300) for k, (letters, lang) in enumerate((("abcdefgh ", "la"), ("абвгдежз ", "ru")))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    content = {k: v.decode() for k, v in language_id.dictionaries(docs).items()}
    sampled = language_id.sample(docs).collect()
    assert {k: sum(r["lang"] == k for r in sampled) for k in content} == {"la": language_id.SAMPLE_ROWS, "ru": language_id.SAMPLE_ROWS}
    assert all(r["text"].lower() in content[r["lang"]] for r in sampled) and len(content["ru"]) == len(content["la"])


def test_edited_texts_of_one_id(spark, monkeypatch):
    """An id, or no id, that most rows have is cut by ranges; each text still has one follower, in a ring."""
    rows = [(5 if i % 3 else None if i % 2 else i, f"text {i % 90} " + "ab" * (i % 40)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(edit_fingerprint, "parallelism", lambda _: 8)
    out = edit_fingerprint.with_edits(docs)
    got = out.collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows)
    assert sorted(r["fingerprint"] for r in got) == sorted(map(edit_fingerprint.fingerprint, (t for _, t in rows)))
    sizes = [r["n"] for r in spark.read.parquet(*{f for f in out.inputFiles()}).groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 150



def test_large_clusters_are_narrowed(spark, monkeypatch):
    """Texts that share boilerplate at a similarity under the threshold, links among them, and a group of
    copies that is large in itself: components as by all pairs, with few sets compared."""
    monkeypatch.setattr(near_dedup, "LARGE", 64)
    rng = np.random.default_rng(8)
    common = [f"b{i}" for i in range(160)]
    own = lambda k: [f"u{rng.integers(1 << 40)}" for _ in range(k)]
    texts = [" ".join(common + own(40)) for _ in range(700)]  # about 0.66 of each other
    texts += [" ".join(t.split()[:-2] + own(2)) for t in texts[::70]]
    base = [f"c{i}" for i in range(120)]
    for _ in range(300):  # copies of one text: most are joined within their slots, some only through others
        changed = list(base)
        for at in rng.choice(120, rng.integers(1, 6), replace=False):
            changed[at] = f"x{rng.integers(1 << 40)}"
        texts.append(" ".join(changed))
    sets = [set(near_dedup.shingles_of(t, 5).tolist()) for t in texts]
    label = list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
    kept = []
    narrowed = near_dedup.narrowed
    monkeypatch.setattr(near_dedup, "narrowed", lambda s, percent: kept.append((s.count(), narrowed(s, percent))) or kept[-1][1])
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == label
    before, after = kept[0][0], kept[0][1].count()
    assert before > 900 and after < 400  # the boilerplate's texts but for the ten links are out


def test_gradients_by_differences():
    """Each part's gradient against differences of the loss, in double precision, where no maximum changes."""
    rng = np.random.default_rng(9)
    net = quality.Network(rng)
    net.weights, net.bias, net.out = net.weights.astype(np.float64), rng.normal(0, 0.1, quality.FILTERS), net.out.astype(np.float64) * 5
    net.shift = np.array([0.2])
    docs = [quality.chunks_of(bytes(rng.integers(97, 110, n, dtype=np.uint8))) for n in (40, 900, 2500, 5)]
    y, w = np.array([1.0, 0.0, 1.0, 0.0]), np.array([1.0, 2.0, 0.5, 1.0])

    def loss():
        z = np.array([net.logit(net.pooled(d)[0]) for d in docs])
        return float((w * (np.logaddexp(0, z) - y * z)).sum() / w.sum() + quality.DECAY / 2 * (net.out**2).sum())

    for part, g in zip(net.parts, quality.gradients(net, docs, y, w)):
        flat, own = part.reshape(-1), np.asarray(g).reshape(-1)
        for i in {*np.argsort(-np.abs(own))[:6].tolist(), *rng.integers(0, len(flat), 3).tolist()}:
            kept, step = flat[i], 1e-6
            flat[i] = kept + step
            up = loss()
            flat[i] = kept - step
            down = loss()
            flat[i] = kept
            assert abs((up - down) / (2 * step) - own[i]) < 1e-5, (i, own[i])
