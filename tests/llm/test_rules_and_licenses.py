"""Quality rules against SQL and by hand; licence scans against brute force."""

from __future__ import annotations

import re

import pytest

from casemill.llm import license_scan as L
from casemill.llm import quality_rules as Q
from casemill.llm.queries import ORACLE_SQL, QUERIES
from tests.comparing import assert_same, duck
from tests.llm.frames import awkward, documents, empty, prose


def slow_rules(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {i + j for i, w in enumerate(windows) for j in range(3) if windows.count(w) > 1} if len(words) < 3000 else None
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), None if again is None else len(again)


@pytest.mark.parametrize("name", ["op2_quality_rules"])
def test_same_as_sql(name, spark, small):
    assert_same(QUERIES[name](spark, small).toPandas(), duck(small).execute(ORACLE_SQL[name]).fetchdf())


def test_counts(spark):
    texts = ["a b c a b c", "a b c d a b c", "x\nx\n \nx", "#a |b\x0bc", prose(3, 400) + " " + prose(3, 40), "aa aa aa aa", "ab cd\x0cef"]
    for x in Q.judge(documents(spark, texts)).collect():
        n, chars, symbols, lines, again = slow_rules(texts[x["doc_id"]])
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == (n, chars, symbols, lines, again)


def test_awkward_rules(spark):
    docs = awkward(spark)
    texts = {x["doc_id"]: x["text"] for x in docs.collect() if x["doc_id"] is not None}
    rows = Q.judge(docs).collect()
    assert len(rows) == docs.count()
    for x in rows:
        if x["doc_id"] is not None:
            expected = slow_rules(texts[x["doc_id"]])
            assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"]) == expected[:4]
        assert x["base_failed"] == (x["n_words"] < 50 or 100 * x["n_repeat_words"] > 50 * x["n_words"]) and not (x["base_failed"] and x["kept"])
    assert Q.judge(empty(spark)).count() == 0
    assert Q.judge(docs, rules=[]).where("not base_failed and not kept").count() == 0


def test_rule_table(spark):
    ok = " ".join(["the", *prose(5, 99).split()])
    kept = {x["doc_id"]: x["kept"] for x in Q.judge(documents(spark, [ok + " and of the", prose(5, 99).upper(), ok + " | # $ %" * 20])).collect()}
    assert kept == {0: True, 1: False, 2: False}


def slow_words(text):
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def slow_base(text):
    w = slow_words(text)
    hits = [(i, label) for i in range(len(w)) for phrase, label in L.PHRASES if w[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in hits]
    return len(w), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hits}))


LICENCES = [
    "x Released under the MIT License. y CC-BY-NC 4.0", "GNU General Public License, GNU general public\nlicense", "cc cc by by", "mit licensed apache licenses", "the APACHE-LICENSE",
    prose(1, 300) + " Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal " + prose(2, 50),
    "Redistribution and use in source and binary forms, with or without any modification, are permitted provided that the following conditions are met", prose(4, 200),
]


def test_licences(spark):
    found = {x["doc_id"]: x for x in L.scan(documents(spark, LICENCES)).collect()}
    for i, text in enumerate(LICENCES):
        x = found[i]
        assert (x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"]) == slow_base(text)
    assert found[5]["labels"] == "mit" and found[5]["n_base"] == 0 and 0.6 <= found[5]["score"] <= 1
    assert found[6]["labels"] == "bsd"  # a word put in moves the diagonal
    assert found[7]["labels"] == "" and found[7]["score"] == 0


def test_spans_against_brute_force(spark):
    spans = {(x["doc_id"], x["template"]): x for x in L.spans(documents(spark, LICENCES)).collect()}
    for i, text in enumerate(LICENCES):
        w = slow_words(text)
        grams = {tuple(w[j : j + L.K]) for j in range(len(w))}
        for t, (_, template) in enumerate(L.TEMPLATES):
            tw = template.split()
            held = {p + k for p in range(len(tw) - L.K + 1) if tuple(tw[p : p + L.K]) in grams for k in range(L.K)}
            if len(held) / len(tw) < L.COVERAGE:
                assert (i, t) not in spans
            elif (i, t) in spans:
                assert spans[i, t]["coverage"] == pytest.approx(len(held) / len(tw))


def test_awkward_licences(spark):
    docs = awkward(spark)
    rows = L.scan(docs).collect()
    assert len(rows) == docs.count() and L.scan(empty(spark)).count() == 0
    texts = {x["doc_id"]: x["text"] for x in docs.collect() if x["doc_id"] is not None}
    for x in rows:
        if x["doc_id"] is not None:
            assert (x["n_words"], x["n_base"]) == slow_base(texts[x["doc_id"]])[:2]


def test_license_rows_under_null_and_shared_ids(spark):
    texts = ["x redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "nothing of the kind here"]
    docs = spark.createDataFrame([(i, t) for i in (None, 7) for t in texts], "doc_id long, text string")
    got = sorted((str(x["doc_id"]), x["n_words"], x["labels"], x["n_spans"]) for x in L.scan(docs).collect())
    assert got == [("7", 5, "", 0), ("7", 22, "bsd", 1), ("None", 5, "", 0), ("None", 22, "bsd", 1)]
