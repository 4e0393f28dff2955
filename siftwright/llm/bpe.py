"""BPE encoding and decoding by a pair occurrence index.

The words that a batch of texts brings and that its task has not met are laid out as one sequence
of symbols. An index maps each adjacent pair that has a merge to all of its positions. The active
ranks are applied in ascending order, each to all positions of its pair; every merge updates the
lists of the pairs that it makes. Words do not touch, so this is the merge order of each word on
its own.

The tokenizer's file is a parameter and its parsed contents travel with the task.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from siftwright.llm.common import map_texts

#: Characters of text whose words are encoded together, and the size at which a task forgets words.
BLOCK_CHARS, KNOWN_WORDS = 1_000_000, 300_000


class Vocabulary:
    """A word-level-closed BPE vocabulary as the tokenizers library stores it.

    Understood: NFC, white space and lower-case normalizers; one Split pre-tokenizer followed by
    byte-level mapping; an end-of-word suffix; added tokens that match the raw text. A file that
    asks for anything else is refused.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        known = (
            model["type"] == "BPE" and kinds == ["NFC", "Replace", "Lowercase"] and split["invert"] and split["behavior"] == "Removed"
            and not any(model[k] for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
            and not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
            and spec["decoder"] is None and spec["post_processor"] is None
        )
        if not known:
            raise ValueError(f"{path} asks for steps that this encoder does not know")
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        chars = byte_chars()
        self.inner = [vocab[c] for c in chars]
        self.last = [vocab[c + suffix] for c in chars]
        self.tokens = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        #: (left id, right id) -> (rank, merged id)
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(map(tuple, model["merges"]))}
        self.word_pattern = split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")

    def text_of(self, ids) -> str:
        """What ids decode to: the tokens, a space between, as the library joins them for a file
        without a decoder. An id outside the vocabulary is left out."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable
    Latin-1 stands for itself, the rest follow from code point 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


def encode_words(words: list[str], vocab: Vocabulary) -> list[tuple[int, ...]]:
    """The ids of each word."""
    symbols: list[int] = []
    starts: list[int] = []
    for w in words:
        starts.append(len(symbols))
        raw = w.encode("utf-8")
        symbols.extend(map(vocab.inner.__getitem__, raw))
        symbols[-1] = vocab.last[raw[-1]]
    n = len(symbols)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    for s in starts:
        before[s] = -1
        if s:
            after[s - 1] = -1
    if n:
        after[n - 1] = -1

    merges = vocab.merges
    at: dict[int, list[int]] = defaultdict(list)
    of_rank: dict[int, tuple[int, int, int]] = {}
    for p in range(n):
        q = after[p]
        if q >= 0 and (m := merges.get((symbols[p], symbols[q]))):
            at[m[0]].append(p)
            of_rank[m[0]] = (symbols[p], symbols[q], m[1])
    active = list(at)
    heapq.heapify(active)
    while active:
        rank = heapq.heappop(active)
        places = at.pop(rank, None)
        if not places:
            continue
        places.sort()
        a, b, made = of_rank[rank]
        for k, p in enumerate(places):
            q = after[p]
            if symbols[p] != a or q < 0 or symbols[q] != b:
                continue
            symbols[p], symbols[q] = made, -1
            after[p] = r = after[q]
            if r >= 0:
                before[r] = p
            lower = False
            left = before[p]
            for x, y in ((left, p), (p, r)):
                if x >= 0 and y >= 0 and (m := merges.get((symbols[x], symbols[y]))):
                    if m[0] not in at:
                        at[m[0]] = []
                        of_rank[m[0]] = (symbols[x], symbols[y], m[1])
                        heapq.heappush(active, m[0])
                    at[m[0]].append(x)
                    lower |= m[0] <= rank
            if lower:  # a pair of lower rank came up: it goes first, what is left of this one waits
                if rank not in at:
                    heapq.heappush(active, rank)
                at[rank] = at.get(rank, []) + places[k + 1 :]
                break
    ends = starts[1:] + [n]
    return [tuple(x for x in symbols[s:e] if x >= 0) for s, e in zip(starts, ends)]


def pieces(text: str, chars: int = BLOCK_CHARS) -> Iterator[str]:
    """A text in pieces that end behind white space, so that no word, mark or normal form spans
    two of them. A run without white space stays one piece."""
    at, n = 0, len(text)
    while n - at > chars:
        cut = regex.compile(r"[ \n]").search(text, at + chars)
        if cut is None:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


class Encoder:
    """Encodes text by text for one task; remembers the words that it has met: of each its ids, the
    ids in decimal, and what they decode to."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.words = regex.compile(vocab.word_pattern).findall
        marks = sorted(vocab.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        self.known: dict[str, tuple[tuple[int, ...], str, str]] = {}

    def lowered(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()  # no final form of sigma

    def split(self, text: str) -> list[str]:
        """Words of a text; an added token is one word, marked by a leading NUL."""
        if self.marks is None or not any(m in text for m in self.vocab.special):
            return self.words(self.lowered(text))
        out: list[str] = []
        for part in self.marks.split(text):
            if part in self.vocab.special:
                out.append("\0" + part)
            elif part:
                out.extend(self.words(self.lowered(part)))
        return out

    def learn(self, lists: list[list[str]]) -> None:
        fresh = set().union(*lists) - self.known.keys() if lists else set()
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
            fresh = set().union(*lists)
        special = {w for w in fresh if w[0] == "\0" and w[1:] in self.vocab.special}
        plain = sorted(fresh - special)
        for words, ids in ((plain, encode_words(plain, self.vocab)), (special, ((self.vocab.special[w[1:]],) for w in special))):
            self.known.update((w, (i, " ".join(map(str, i)), self.vocab.text_of(i))) for w, i in zip(words, ids))

    def encode(self, text: str | None) -> list[int]:
        words = self.split(text or "")
        self.learn([words])
        return [i for w in words for i in self.known[w][0]]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Adds ``ids array<int>`` to ``docs(doc_id, text)``; other columns are left out.

    A null text is empty and has no ids. Rows are independent: repeated ids and empty tables need
    no care.
    """
    vocab = Vocabulary(path)
    return map_texts(docs, lambda: lambda texts, e=Encoder(vocab): [pa.array(map(e.encode, texts), pa.list_(pa.int32()))], "ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of ``encoded(doc_id, ids)``: see ``Vocabulary.text_of``. Null ids are none."""
    vocab = Vocabulary(path)

    def run(batches):
        for batch in batches:
            texts = [vocab.text_of(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = dict(encoded.dtypes)["doc_id"]
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Number of ids, digest of the ids and of the text decoded from them, for each row.

    A null text is empty. Rows are independent: repeated ids, ties and empty tables need no care.
    Ids and decoded texts never leave the task: digests grow piece by piece, so a long text costs
    the memory of one piece.
    """
    vocab = Vocabulary(path)

    def make():
        encoder = Encoder(vocab)

        def told(lists: list[list[str]]):
            """Number, decimals and decoded text of the ids of each list of words."""
            encoder.learn(lists)
            for words in lists:
                known = [encoder.known[w] for w in words]
                yield sum([len(k[0]) for k in known]), *(" ".join([k[x] for k in known]) for x in (1, 2))

        def work(texts):
            out: list[tuple[int, str, str]] = []
            waiting: list[str] = []
            size = 0

            def settle():
                """Digests of the texts that wait; together they are about one block."""
                out.extend((n, *(hashlib.sha256(x.encode()).hexdigest() for x in said)) for n, *said in told([encoder.split(t) for t in waiting]))
                waiting.clear()

            for text in texts:
                text = text or ""
                if len(text) > BLOCK_CHARS:
                    settle()
                    size, total, hashes = 0, 0, (hashlib.sha256(), hashlib.sha256())
                    for piece in pieces(text):
                        for n, *said in told([encoder.split(piece)]):
                            for h, x in zip(hashes, said):
                                h.update(((" " if total and n else "") + x).encode())
                            total += n
                    out.append((total, hashes[0].hexdigest(), hashes[1].hexdigest()))
                    continue
                waiting.append(text)
                size += len(text)
                if size > BLOCK_CHARS:
                    settle()
                    size = 0
            settle()
            n, a, b = zip(*out) if out else ((), (), ())
            return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]

        return work

    return map_texts(docs, make, "n_tokens long, ids_sha256 string, decoded_sha256 string")
