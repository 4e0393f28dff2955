import hashlib
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest

from siftwright.llm import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn int, role string, text string, depth int, key string"


def brute(rows, family=5, spread=9):
    """Every node by its whole sequence of turns."""
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs[c].append((turn is not None, turn or 0, role, mark, text))
    turns = {c: [(r, t) for _, _, r, _, t in sorted(rows)] for c, rows in convs.items()}
    whole = {}
    for c, own in turns.items():
        h = crc32(str(c).encode()) % spread
        whole[c] = tuple(turns.get(c - c % family, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    out = []
    for node, of in members.items():
        kids = [n for n in members if len(n) == len(node) + 1 and n[: len(node)] == node]
        under = [n for n in members if n[: len(node)] == node]
        leaves = [n for n in under if all(len(m) != len(n) + 1 or m[: len(n)] != n for m in members)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in under if n)
        ends = ",".join(map(str, sorted(c for c in of if len(whole[c]) == len(node))))
        out.append((min(of), len(node), min(members[node[:-1]]) if node else None, len(of), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def told(spark, rows, *args):
    return sorted((tuple(r[c] for c in COLUMNS) for r in prefix_trie.trie(spark.createDataFrame(rows, SCHEMA), *args).collect()), key=str)


def row(c, turn, role, text):
    return c, turn, role, text, 0, "x"


ODD = [
    row(1, None, "user", "n"), row(1, 0, None, None), row(1, 0, None, None), row(1, 2, "user", "é漢"), row(-7, 0, "user", "a"), row(-7, 1, "assistant", "b"),
    row(-10, 0, "user", "a"), row(4, 5, "user", "only"), row(None, 1, "user", "nobody's"), row(40, 0, "user", ""), row(41, 0, "user", ""), row(42, 0, "user", "x" * 70000),
]


def random_rows(seed, convs, longest, words=2):
    rng = np.random.default_rng(seed)
    return [row(int(c), t, "user" if t % 2 == 0 else "assistant", f"t{rng.integers(words)}") for c in rng.choice(3 * convs, convs, replace=False) for t in range(rng.integers(1, longest + 1))]


@pytest.mark.parametrize("rows, args", [(ODD, ()), (ODD, (1,)), (random_rows(1, 60, 6), ()), (random_rows(2, 40, 14), ()), (random_rows(3, 40, 8), (1, 9))])
def test_against_every_sequence(spark, rows, args):
    assert told(spark, rows, *args) == brute(rows, *args)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_long_conversations_span_tasks(spark, seed):
    """Few conversations of many turns, more tasks than families: ranges cut conversations, borrowed
    starts and families anywhere, and prefixes are shared."""
    rng = np.random.default_rng(seed)
    rows = [row(c, t, "user", "same" if t < 11 else f"t{rng.integers(2)}") for c, n in ((0, 3), (1, 37), (2, 5), (5, 60), (6, 61), (8, 2), (9, 44), (11, 30), (14, 4)) for t in range(n)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "29")
    try:
        assert told(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_tables_are_flushed(spark, monkeypatch):
    rows = random_rows(5, 50, 6)
    monkeypatch.setattr(prefix_trie, "HELD", 7)
    assert told(spark, rows) == brute(rows)


def test_equal_conversations_and_no_rows(spark):
    rows = [row(c, t, "user", f"t{t}") for c in range(0, 500, 5) for t in range(3)]
    got = told(spark, rows)
    assert got == brute(rows) and max(r[3] for r in got) == 100
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0
