"""Fill-in-the-middle transformation by a scan for events.

A text is a row of units. The units of a kind are told by classes of characters: a run of characters
of one class gives a unit for every ``width`` of them, the last one maybe shorter, or one unit for
the whole run. Only characters of the ASCII range change the class; all others are of the kind's
plain class.

One Aho-Corasick automaton finds the characters that change the class, and the sentinels, in a
single pass. Between two events all characters are plain, so their units are a division away: the
events and the numbers of units before them are all that is kept of a text, and the place where
a unit of a given rank ends is found among them by bisection.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftwright.llm.common import table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
#: Of a hundred texts, so many stay plain at least; of a hundred others, so many have the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20


@dataclass(frozen=True)
class Units:
    """A kind of units: ``classes`` gives the characters of each further class; ``widths`` the length
    of a unit, 0 for a whole run, of the plain class and then of each further one."""

    classes: tuple[str, ...] = ()
    widths: tuple[int, ...] = (1,)

    def __post_init__(self):
        all_of = "".join(self.classes)
        if not all_of.isascii() or len(set(all_of)) < len(all_of) or len(self.widths) != len(self.classes) + 1 or min(self.widths) < 0:
            raise ValueError("classes are disjoint sets of ASCII characters, each with a width, after that of all other characters")


CODE_POINTS = Units()
#: Runs of white space and of anything else.
WORDS = Units((" \t\n\v\f\r",), (0, 0))
#: Digits by threes, white space and punctuation one by one, words whole.
PIECES = Units(("0123456789", " \t\n\v\f\r", "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"), (0, 3, 1, 1))


@dataclass
class Scan:
    """What a pass over a text has found: runs, each with its start, its class's width and the units
    before it, and whether a sentinel stands in the text."""

    length: int
    marked: bool = False
    starts: list[int] = field(default_factory=list)
    widths: list[int] = field(default_factory=list)
    before: list[int] = field(default_factory=list)
    units: int = 0

    def run(self, start: int, end: int, width: int) -> None:
        if end > start:
            self.starts.append(start)
            self.widths.append(width)
            self.before.append(self.units)
            self.units += -(-(end - start) // width) if width else 1

    def end_of(self, rank: int) -> int:
        """Where the first ``rank`` units end."""
        if rank <= 0:
            return 0
        if rank >= self.units:
            return self.length
        at = int(np.searchsorted(np.asarray(self.before), rank, side="left")) - 1
        stop = self.starts[at + 1] if at + 1 < len(self.starts) else self.length
        width = self.widths[at]
        return min(stop, self.starts[at] + (rank - self.before[at]) * width) if width else stop


class Scanner:
    """The automaton of a kind of units. Sentinels must not be able to overlap each other, or a text's
    parts could not be told from its output."""

    def __init__(self, units: Units = CODE_POINTS, sentinels: tuple[str, ...] = SENTINELS):
        for a in sentinels:
            if not a or any(a.endswith(b[:k]) for b in sentinels for k in range(1, len(b))) or any(a in b for b in sentinels if a is not b):
                raise ValueError("sentinels may neither overlap nor hold each other")
        self.units = units
        self.machine = ahocorasick.Automaton()
        for i, chars in enumerate(units.classes):
            for c in chars:
                self.machine.add_word(c, i + 1)
        for s in sentinels:
            self.machine.add_word(s, 0)
        self.machine.make_automaton()

    def scan(self, text: str) -> Scan:
        """The runs of a text. An event is one character of a further class; what lies between two
        events is plain."""
        found = Scan(len(text))
        widths = self.units.widths
        start = end = 0  # the open run of a further class
        kind = 0
        for at, event in self.machine.iter(text):
            if not event:
                found.marked = True
            elif event == kind and at == end:
                end += 1
            else:
                found.run(start, end, widths[kind])
                found.run(end, at, widths[0])
                start, end, kind = at, at + 1, event
        found.run(start, end, widths[kind])
        found.run(end, len(text), widths[0])
        return found


def assembled(form: str, prefix: str, middle: str, suffix: str) -> str:
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


def rebuilt(form: str, output: str) -> str:
    """The text, from the output and its form. No part holds a sentinel and sentinels cannot overlap,
    so the first of each is the one that was put there."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    a = output.index(second, len(first))
    b = output.index(MIDDLE, a + len(second))
    one, two, middle = output[len(first) : a], output[a + len(second) : b], output[b + len(MIDDLE) :]
    return one + middle + two if form == "psm" else two + middle + one


def draws(seed: int = 1) -> Column:
    """Four numbers below 2 ** 32 by doc_id; a null one is drawn for as an empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def _cut(scanner: Scanner, text: str, h: list[int]) -> tuple:
    """(units, form, prefix, middle, output) of a text."""
    found = scanner.scan(text)
    n = found.units
    if not text or found.marked or h[2] % 100 >= 100 - PLAIN:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = found.end_of(low), found.end_of(high)
    form = "spm" if h[3] % 100 < SUFFIX_FIRST else "psm"
    return n, form, a, b - a, assembled(form, text[:a], text[a:b], text[b:])


def _mapped(docs: DataFrame, units: Units, seed: int, row, fields: str) -> DataFrame:
    """doc_id and what ``row(scanner, text, draws)`` gives for each text."""
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, {fields}"
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    types = [kinds[f.split()[1]] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(units)
        for batch in batches:
            out = [row(scanner, text.as_py() or "", h.as_py()) for text, h in zip(batch.column(1), batch.column(2))]
            columns = zip(*out) if out else ([] for _ in types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=names)

    return docs.select("doc_id", "text", draws(seed).alias("_draws")).mapInArrow(run, schema)


def transformed(docs: DataFrame, units: Units = CODE_POINTS, seed: int = 1) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row of ``docs(doc_id, text)``.

    A null text is empty; an empty text, or one that holds a sentinel, stays plain. Rows are judged
    one by one, by their ids alone: rows that repeat an id are cut alike, those without one as if
    it were empty. Other columns are left out. No rows give none.
    """
    return _mapped(docs, units, seed, _cut, "n long, form string, prefix_chars long, middle_chars long, output string")


def restored(outputs: DataFrame) -> DataFrame:
    """(doc_id, text) from ``outputs(doc_id, form, output)``."""
    schema = f"doc_id {dict(outputs.dtypes)['doc_id']}, text string"

    def run(batches):
        for batch in batches:
            texts = [rebuilt(form, output) for form, output in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return outputs.select("doc_id", "form", "output").mapInArrow(run, schema)


def digests(docs: DataFrame, units: Units = CODE_POINTS, seed: int = 1) -> DataFrame:
    """The figures of ``transformed``, with digests of the output and of the text rebuilt from it;
    neither leaves the task."""
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()

    def row(scanner, text, h):
        n, form, prefix, middle, output = _cut(scanner, text, h)
        return n, form, prefix, middle, sha(output), sha(rebuilt(form, output))

    return _mapped(docs, units, seed, row, "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


_H = ", ".join(f"CAST('0x' || substr(g, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))
ORACLE_SQL = f"""
WITH g AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS g FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, {_H} FROM g),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {100 - PLAIN} THEN 'plain'
  WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM h),
o AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1, n - b) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM o"""
