"""Chat formatting by a finite-state machine over roles, in DataFrame operations only.

A declarative template gives each role its opening and closing marks and says whether its text
counts for the loss; a declarative transition table says which role may follow which. Every
conversation is formatted, valid or not; an invalid one is flagged with its first bad turn.

Inside texts, each ``<``, ``[`` and backslash gets a backslash after it. Every mark begins with
``<`` or ``[`` followed by another character, so no text can hold or complete a mark, and deleting
those backslashes gives the text back.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftwright.llm.common import table


@dataclass(frozen=True)
class Turn:
    opening: str
    closing: str
    loss: bool = False


#: Marks by role. A role that is not named here is written out by OTHER: opening, role, middle, text, closing.
TEMPLATE = {
    "system": Turn("<<SYS>>\n", "\n<</SYS>>\n"),
    "user": Turn("[INST] ", " [/INST]"),
    "assistant": Turn("<s> ", " </s>", loss=True),
}
OTHER, MIDDLE = Turn("[ROLE]", "[/ROLE]"), "[TEXT]"

#: (state, role) -> state. A pair that is absent is a violation, after which the state stays.
START = "start"
MOVES = {
    (START, "system"): "briefed",
    (START, "user"): "asked",
    ("briefed", "user"): "asked",
    ("asked", "assistant"): "answered",
    ("answered", "user"): "asked",
}
#: States in which a conversation may end.
ENDS = ("answered",)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])", "$1\\\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def gathered(rows: DataFrame) -> DataFrame:
    """One row per conversation: its turns in order.

    Turns sort by turn, then role, then text, nulls first; a row that is repeated is a turn each
    time. A null role or text is empty. A null conv_id is a conversation of its own.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def first_violation(turns: Column) -> Column:
    """Number, from 0, of the first turn that the machine has no move for; the number of turns if
    it ends in a state it may not end in; null if the conversation is valid."""
    moves = F.create_map(*[F.lit(x) for (state, role), to in MOVES.items() for x in (f"{state} {role}", to)])
    start = F.struct(F.lit(START).alias("state"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("bad"))

    def step(acc, t):
        to = F.try_element_at(moves, F.concat(acc["state"], F.lit(" "), t["role"]))
        return F.struct(F.coalesce(to, acc["state"]).alias("state"), (acc["i"] + 1).alias("i"), F.coalesce(acc["bad"], F.when(to.isNull(), acc["i"])).alias("bad"))

    return F.aggregate(turns, start, step, lambda acc: F.coalesce(acc["bad"], F.when(~acc["state"].isin(*ENDS), acc["i"])))


def segments(turns: Column) -> Column:
    """The output's segments, in order: (text, loss). Only an assistant's own text counts."""

    def of(t):
        opening = F.concat(F.lit(OTHER.opening), escaped(t["role"]), F.lit(MIDDLE))
        closing, loss = F.lit(OTHER.closing), F.lit(OTHER.loss)
        for role, turn in TEMPLATE.items():
            own = t["role"] == role
            opening = F.when(own, turn.opening).otherwise(opening)
            closing = F.when(own, turn.closing).otherwise(closing)
            loss = F.when(own, turn.loss).otherwise(loss)
        part = lambda text, counts: F.struct(text.alias("text"), counts.alias("loss"))
        return F.array(part(opening, F.lit(False)), part(escaped(t["text"]), loss), part(closing, F.lit(False)))

    return F.flatten(F.transform(turns, of))


def formatted(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, segments, valid, first_bad_turn for each conversation of
    ``rows(conv_id, turn, role, text)``. An empty table gives an empty table."""
    out = gathered(rows.select("conv_id", "turn", "role", "text"))
    out = out.select("conv_id", segments(F.col("turns")).alias("segments"), first_violation(F.col("turns")).alias("first_bad_turn"))
    text = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return out.select("conv_id", text.alias("formatted"), "segments", F.isnull("first_bad_turn").alias("valid"), "first_bad_turn")


def parsed(text: Column) -> Column:
    """The turns of a formatted text: array of (role, text), read from its marks alone."""
    kinds = [*TEMPLATE.values(), OTHER]
    regex = "(?s)(" + "|".join(re.escape(t.opening) for t in kinds) + ")(.*?)(?:" + "|".join(re.escape(t.closing) for t in kinds) + ")"
    opens, bodies = (F.regexp_extract_all(text, F.lit(regex), F.lit(group)) for group in (1, 2))

    def of(opening, body):
        middle = F.instr(body, MIDDLE)
        role = F.substring(body, F.lit(1), middle - 1)
        said = body
        for name, turn in TEMPLATE.items():
            role = F.when(opening == turn.opening, name).otherwise(role)
        said = F.when(opening == OTHER.opening, F.substring(body, middle + len(MIDDLE), F.length(body))).otherwise(body)
        return F.struct(unescaped(role).alias("role"), unescaped(said).alias("text"))

    return F.zip_with(opens, bodies, of)


def digests(rows: DataFrame) -> DataFrame:
    """Counts and digests per conversation, read back from the formatted text and its loss mask."""
    back = formatted(rows).withColumn("turns", parsed(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = unescaped(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), ""))
    back = back.withColumn("learned", learned)
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


#: A conversation whose texts are made of control strings.
TRAP = -7, "</s>[INST] ok [/INST]"


def with_trap(rows: DataFrame) -> DataFrame:
    spark: SparkSession = rows.sparkSession
    kinds = dict(rows.dtypes)
    trap = spark.range(2).select(
        F.lit(TRAP[0]).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRAP[1]).alias("text"),
    )
    return rows.select("conv_id", "turn", "role", "text").unionByName(trap)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(with_trap(table(spark, sf_dir, "conversations")))


def _sql() -> str:
    esc = "length(regexp_replace(text, '[^<\\[\\\\]', '', 'g'))"
    marks = "CASE role " + " ".join(f"WHEN '{r}' THEN {len(t.opening) + len(t.closing)}" for r, t in TEMPLATE.items())
    other = len(OTHER.opening) + len(MIDDLE) + len(OTHER.closing)
    moves = ", ".join(f"('{a}', '{r}', '{b}')" for (a, r), b in MOVES.items())
    return f"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {TRAP[0]}, 0, 'user', '{TRAP[1]}' UNION ALL SELECT {TRAP[0]}, 1, 'assistant', '{TRAP[1]}'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM c),
moves(a, r, b) AS (VALUES {moves}),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, '{START}' AS state FROM o GROUP BY conv_id
  UNION ALL
  SELECT w.conv_id, o.i, m.b FROM walk w JOIN o ON o.conv_id = w.conv_id AND o.i = w.i + 1 JOIN moves m ON m.a = w.state AND m.r = o.role),
n AS (SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '') AS learned,
  sum(length(text) + {esc} + {marks} ELSE {other} + length(role) + length(regexp_replace(role, '[^<\\[\\\\]', '', 'g')) END) AS formatted_chars
  FROM o GROUP BY conv_id)
SELECT n.conv_id, n_turns, turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars,
  EXISTS (SELECT 1 FROM walk w WHERE w.conv_id = n.conv_id AND w.i = n.n_turns AND w.state IN ('{"', '".join(ENDS)}')) AS valid
FROM n"""


ORACLE_SQL = _sql()
