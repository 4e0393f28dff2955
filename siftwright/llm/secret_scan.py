"""Secret scans over a trigram index, in DataFrame operations only.

Each rule's regular expression yields a Boolean trigram query (``trigrams``). One pass over the
texts makes the postings of the trigrams that some query names; intersecting them decides which
rules a text can match, and only those are verified on it. A rule without a mandatory trigram scans
every text.

The postings stand in the texts' own order: beside each text, a bit for each trigram that the rules
name. So intersecting and verifying move no text, and neither a common trigram nor a repeated or
null id gathers anywhere. ``postings`` gives the same index inverted, as rows of (trigram, document).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from siftwright.llm import trigrams

#: Trigrams kept of each conjunction of a rule's query.
GRAMS_PER_CONJUNCTION = 3
#: Trigrams to a 64-bit word of a document's postings.
WORD = 60


@dataclass(frozen=True)
class Rule:
    """``regex`` must mean the same to Java as to RE2. A match counts if its group ``group`` (0:
    the whole) has ``least`` characters or more; its span is that of the whole match."""

    kind: str
    regex: str
    least: int = 1
    group: int = 0

    @property
    def query(self):
        return trigrams.thinned(trigrams.query_of(self.regex), GRAMS_PER_CONJUNCTION)


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + f"|{_either_case('api')}_?{_either_case('key')}"

#: Kinds that every scan reports first, in this order.
BASE = (
    Rule("assign", rf"(?:{_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", least=8, group=1),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]{32,}", least=32),
)
#: Further kinds, found through the index alone.
MORE = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    Rule("forge_token", r"gh[opsu]_[A-Za-z0-9]{20,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


def grams_of(rules: tuple[Rule, ...]) -> list[str]:
    """The trigrams that the rules' queries name, in order."""
    return sorted(set().union(*(trigrams.grams_of(r.query) for r in rules)))


def words_of(low: Column, grams: list[str]) -> list[Column]:
    """The postings of a lower-cased text as 64-bit words: a bit for each of ``grams``."""
    bits = [F.contains(low, F.lit(g)).cast("long") * F.lit(1 << i % WORD) for i, g in enumerate(grams)]
    return [sum(bits[at + 1 : at + WORD], bits[at]) for at in range(0, len(grams), WORD)]


def postings(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The inverted index, restricted to the rules' trigrams: a row of (gram, doc_id) for each
    document that has one."""
    grams = grams_of(rules)
    held = docs.select("doc_id", F.lower("text").alias("low")).select("doc_id", *[w.alias(f"w{i}") for i, w in enumerate(words_of(F.col("low"), grams))])
    each = [F.when(F.col(f"w{i // WORD}").bitwiseAND(F.lit(1 << i % WORD)) != 0, F.lit(g)) for i, g in enumerate(grams)]
    return held.select(F.explode(F.array_compact(F.array(*each))).alias("gram"), "doc_id")


def _holds(query, at: dict[str, int]) -> Column:
    if isinstance(query, str):
        return F.col(f"_w{at[query] // WORD}").bitwiseAND(F.lit(1 << at[query] % WORD)) != 0
    word, parts = query
    out = None
    for x in (_holds(p, at) for p in parts):
        out = x if out is None else (out & x if word == "and" else out | x)
    return out


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of a rule's leftmost non-overlapping matches, as an array of (start, rank, end) in
    code points, end exclusive. The matches and what lies between them tile the text, so running
    sums of their lengths are the positions."""
    regex = F.lit(rule.regex)
    found = F.transform(F.regexp_extract_all(text, regex, F.lit(0)), F.length)
    counted = F.transform(F.regexp_extract_all(text, regex, F.lit(rule.group)), F.length)
    gaps = F.transform(F.split(text, rule.regex, -1), F.length)
    steps = F.zip_with(F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, n: F.struct(g.alias("gap"), n.alias("n"))), counted, lambda a, c: F.struct(a["gap"].alias("gap"), a["n"].alias("n"), c.alias("c")))
    span = "struct<start:int,rank:int,end:int>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("spans"))

    def step(acc, x):
        at = acc["at"] + x["gap"]
        end = at + x["n"]
        one = F.array(F.struct(at.alias("start"), F.lit(rank).alias("rank"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["c"] >= rule.least, F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate(steps, start, step, lambda acc: acc["spans"])
    return F.when(F.rlike(text, regex), spans).otherwise(F.array().cast(f"array<{span}>"))


def _scanned(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(_row, _spans): each row of ``docs`` as a struct, so that none of its columns can clash."""
    grams = grams_of(rules)
    at = {g: i for i, g in enumerate(grams)}
    kept = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.coalesce(docs["text"], F.lit("")).alias("_text"), F.lower(F.coalesce(docs["text"], F.lit(""))).alias("_low"))
    words = [w.alias(f"_w{i}") for i, w in enumerate(words_of(F.col("_low"), grams))]
    held = kept.select("_row", "_text", *words)
    empty = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    each = []
    for rank, rule in enumerate(rules):
        spans = spans_of(F.col("_text"), rule, rank)
        each.append(spans if rule.query is True else F.when(_holds(rule.query, at), spans).otherwise(empty))
    return held.select("_row", F.array_sort(F.concat(*each)).alias("_spans"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, name: str = "secrets") -> DataFrame:
    """Adds the column ``name`` to each row of ``docs``: its spans as (start, rank, end), by start,
    then in the order of ``rules``.

    ``docs`` has a column text; its other columns stay as they are, but for one called ``name``,
    which is replaced. A null or empty text has no spans. Rows are independent of each other, so
    repeated and null ids need no care; an empty table gives an empty table.
    """
    return _scanned(docs, rules).select(*[F.col("_row")[c].alias(c) for c in docs.columns if c != name], F.col("_spans").alias(name))


def named(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """Per document: counts by base kind, a digest of the base spans, and all spans."""
    rules = BASE + MORE
    found = scan(docs.select("doc_id", "text"), rules)
    count = lambda rank: F.size(F.filter("secrets", lambda s: s["rank"] == rank)).cast("long")
    base = F.filter("secrets", lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(named(base, rules), 256).alias("base_sha256"), named(F.col("secrets"), rules).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with each span replaced by ``mark``; overlapping spans become one mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col("_row")["text"]

    def step(acc, s):
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        fresh = s["start"] >= acc["at"]
        first = (s["start"] == 0) & (acc["at"] == 0)
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh | first, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("_spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    masked = F.when(F.size("_spans") > 0, clean).otherwise(text)
    return _scanned(docs, BASE + MORE).select(*[(masked if c == "text" else F.col("_row")[c]).alias(c) for c in docs.columns])


def _sql() -> str:
    """The same digests in DuckDB SQL, by scanning every text for every rule."""
    rules = BASE + MORE
    parts = []
    for rank, r in enumerate(rules):
        regex = r.regex.replace("'", "''")
        parts.append(f"""
  SELECT rid, {rank} AS rank, '{r.kind}' AS kind, m.a AS s, m.b AS e FROM (
    SELECT rid, unnest(list_filter(list_transform(range(1, len(ms) + 1), lambda i: {{
      'a': coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0),
      'b': coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i], lambda x: length(x))), 0),
      'c': length(cs[i])}}), lambda y: y.c >= {r.least})) AS m
    FROM (SELECT rid, regexp_split_to_array(t, '{regex}') AS gaps, regexp_extract_all(t, '{regex}') AS ms, regexp_extract_all(t, '{regex}', {r.group}) AS cs FROM d WHERE regexp_matches(t, '{regex}')))""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({' UNION ALL '.join(parts)}),
g AS (SELECT rid,
  count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
  string_agg(kind || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(e AS BIGINT) AS VARCHAR), ',' ORDER BY s, rank) FILTER (WHERE rank < {len(BASE)}) AS base,
  string_agg(kind || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(e AS BIGINT) AS VARCHAR), ',' ORDER BY s, rank) AS spans
  FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)"""


ORACLE_SQL = _sql()
