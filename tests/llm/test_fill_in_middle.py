import re

import pytest
from hypothesis import given, settings, strategies as st

from siftwright.llm import fill_in_middle as fim

#: Each kind's units as a regular expression.
KINDS = {
    "code_points": (fim.CODE_POINTS, r"(?s)."),
    "words": (fim.WORDS, r"[ \t\n\v\f\r]+|[^ \t\n\v\f\r]+"),
    "pieces": (fim.PIECES, r"[0-9]{1,3}|[ \t\n\v\f\r]|[!-/:-@\[-`{-~]|[^0-9 \t\n\v\f\r!-/:-@\[-`{-~]+"),
}


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab1234 \n<PSM>é漢\U0001f600.\x00"), max_size=40))
def test_units_are_those_of_a_pattern(text):
    for units, pattern in KINDS.values():
        found = fim.Scanner(units).scan(text)
        ends = [m.end() for m in re.finditer(pattern, text)]
        assert found.units == len(ends) and found.marked == any(s in text for s in fim.SENTINELS)
        assert [found.end_of(i) for i in range(len(ends) + 2)] == [0, *ends, len(text)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("a<PSM>é"), max_size=6), min_size=3, max_size=3))
def test_outputs_are_reversible(parts):
    text = "".join(parts)
    if not any(s in text for s in fim.SENTINELS):
        for form in ("psm", "spm"):
            assert fim.rebuilt(form, fim.assembled(form, *parts)) == text


def test_refused():
    for marks in (("<a>", ">b"), ("ab", "xabx"), ("",)):
        with pytest.raises(ValueError):
            fim.Scanner(sentinels=marks)
    with pytest.raises(ValueError):
        fim.Units(("é",), (1, 1))


def test_odd_rows(spark):
    """Null and empty texts, sentinels, repeated and null ids, a long text, clashing columns, no rows."""
    texts = [(1, None), (2, ""), (3, "a<S>b"), (4, "é漢" * 60000), (4, "é漢" * 60000), (None, "some words here"), (6, "\U0001f600" * 9)]
    docs = spark.createDataFrame([(i, t, "psm", 7) for i, t in texts], "doc_id long, text string, form string, n long")
    out = fim.transformed(docs)
    got = {(r["doc_id"], r["form"], r["n"]) for r in out.collect()}
    assert {(1, "plain", 0), (2, "plain", 0), (3, "plain", 5)} <= got and out.count() == len(texts)
    assert sorted(fim.restored(out).collect(), key=str) == sorted(docs.selectExpr("doc_id", "coalesce(text, '') AS text").collect(), key=str)
    for r in out.collect():
        if r["form"] != "plain":
            assert 0 <= r["prefix_chars"] <= r["prefix_chars"] + r["middle_chars"] <= r["n"] and len(r["output"]) == r["n"] + 9
    assert fim.digests(docs).count() == len(texts) and fim.digests(docs.limit(0)).count() == 0
