"""Field normalisers on the edge rows of case data."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from casemill.functions import cases as C


def one(spark, column, **values):
    schema = ", ".join(f"`{k}` {'string' if v is None or isinstance(v, str) else 'double'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "shown", "imported", "analysed"), [("easy", "Easy", "Easy", "Easy"), ("HARD", "Hard", "Hard", "Hard"), (None, "Medium", "Medium", "UNKNOWN"), ("", "Medium", "Medium", "UNKNOWN"), ("odd", "Odd", "Medium", "UNKNOWN")])
def test_difficulty(spark, raw, shown, imported, analysed):
    assert one(spark, C.capitalised("d"), d=raw) == shown
    assert one(spark, C.difficulty("d"), d=raw) == imported
    assert one(spark, C.analysed_difficulty("d"), d=raw) == analysed


@pytest.mark.parametrize(("raw", "code", "rest", "prefix"), [("W7:Confounding", "W7", "Confounding", "W7"), ("W10", "W10", None, "W10"), ("AMBIG:TIMING", "AMBIG", "TIMING", "A"), ("T9: a:b ", "T9", "a:b", "T9"), ("", None, None, None), (None, None, None, None)])
def test_trap(spark, raw, code, rest, prefix):
    assert one(spark, C.trap_code("t"), t=raw) == code
    assert one(spark, C.trap_rest("t"), t=raw) == rest
    assert one(spark, C.trap_prefix("t"), t=raw) == prefix


@pytest.mark.parametrize(("level", "raw", "label"), [("L1", "YES", "YES"), ("L2", "YES", "NO"), ("L2", None, "NO"), ("L3", "YES", "VALID"), ("L3", "AMBIGUOUS", "CONDITIONAL"), ("L3", "VALID", "VALID"), ("L9", "x", "x")])
def test_label(spark, level, raw, label):
    assert one(spark, C.export_label("l", "g"), l=level, g=raw) == label


def test_variables(spark):
    v = one(spark, C.variables("v", "l"), v='{"X": "rain", "Y": {"name": "wet", "role": "r"}, "Z": "cloud", "X\'": "sun"}', l="L3")
    assert (v["X"]["name"], v["X"]["role"], v["Y"]["role"], v["Z"], v["X'"]) == ("rain", "exposure", "r", ["cloud"], "sun")
    w = one(spark, C.variables("v", "l"), v='{"X": "a", "Z": ["p", "q"], "X\'": "sun"}', l="L1")
    assert w["Y"] is None and w["Z"] == ["p", "q"] and w["X'"] is None
    assert one(spark, C.variables("v", "l"), v="N/A", l="L1") is None
    assert one(spark, C.variables("v", "l"), v=None, l="L1") is None


@pytest.mark.parametrize(("raw", "pair"), [('["a","b"]', ["a", "b"]), ('["a"]', ["a", None]), ('{"ifScenarioA":"a","answer_if_condition_2":"b"}', ["a", "b"]), ("N/A", [None, None]), ("{bad", [None, None]), (None, [None, None])])
def test_conditional_answers(spark, raw, pair):
    assert one(spark, C.conditional_answers("c"), c=raw) == pair


def test_claim(spark):
    assert one(spark, C.claim("s"), s="Some text.\nClaim: 'rain causes mud'\n") == "rain causes mud"
    assert one(spark, C.claim("s"), s='They say "heat causes thirst" often.') == "heat causes thirst"
    assert one(spark, C.claim("s"), s="nothing") == "Causal claim extracted from scenario"
    assert one(spark, C.without_claim("s"), s="Text.\nClaim: it is so\nmore") == "Text.\nmore"


def test_numbers(spark):
    assert one(spark, C.half_up("x"), x=-2.5) == -2.0
    assert one(spark, C.half_up("x", 1), x=0.25) == 0.3
    assert one(spark, C.progress("a", "b"), a=1.0, b=0.0) == 0
    assert one(spark, C.progress("a", "b"), a=9.0, b=3.0) == 100
    assert one(spark, C.accuracy("a", "b"), a=1.0, b=3.0) == 33
    assert one(spark, C.minutes_seconds("x"), x=61000.0) == "1:01"
    assert one(spark, C.remaining("a", "b"), a=1.0, b=5.0) == 0


def test_texts(spark):
    assert one(spark, C.subdomain("s"), s="  equity   markets ") == "Equity Markets"
    assert one(spark, C.subdomain("s"), s=" ") == "UNKNOWN"
    assert one(spark, C.n_words("s"), s="") == 0
    assert one(spark, C.rendered("{a} of {b}", a="s", b=F.lit(None)), s="x") == "x of "
    assert one(spark, C.json_in_text("s", "struct<a:int>"), s='Sure: [{"a": 1}] done')[0]["a"] == 1
    assert one(spark, C.json_in_text("s", "struct<a:int>"), s="no list") == []
    assert one(spark, C.with_claim("s", "c"), s="x", c="") == "x"


def test_uniform_is_even(spark):
    u = spark.range(4000).select(C.uniform("id", 1).alias("u")).agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= u[0] and u[1] < 1 and abs(u[2] - 0.5) < 0.03
