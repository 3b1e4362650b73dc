"""Classifiers' scores against plain reimplementations, and their bounds."""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from casemill.llm import fitting, ngrams
from casemill.llm import quality_classifier as C
from casemill.llm import toxicity as T
from tests.llm.frames import awkward, documents, prose
from tests.llm.test_models_and_packing import labelled

MASK = (1 << 64) - 1


def slow_grams(text):
    """Buckets of character n-grams inside words, one by one."""
    out = set()
    ends = set(" \t\n\r\x0b\x0c.,;:!?\"'()[]{}<>/\\|-_+=~`") | set(map(chr, range(32)))
    t = "".join(" " if c in ends else c for c in f" {(text or '').lower()} ")
    for n in ngrams.WORD_ORDERS:
        for i in range(len(t) - n + 1):
            if " " in t[i + 1 : i + n - 1]:
                continue
            h = 0
            for c in t[i : i + n]:
                h = (h * 1_000_003 + ord(c) + 1) & MASK
            out.add(((h + (n << 40)) * 0x9E3779B97F4A7C15 & MASK) >> (64 - ngrams.WORD_BITS))
    return sorted(out)


@pytest.mark.parametrize("text", [None, "", "a", "The idiot-proof CAF\u00c9 \u4e2d\u6587\u6587\u5b57 word\u2014dash", prose(3, 60), "x" * 40, "\U0001f600 smile"])
def test_grams(text, monkeypatch):
    assert ngrams.word_grams(text).tolist() == slow_grams(text)
    monkeypatch.setattr(ngrams, "_PIECE", 7)  # seams change nothing
    assert ngrams.word_grams(text).tolist() == slow_grams(text)


def test_toxicity_scores(spark):
    docs, labels = labelled(spark)
    model = T.train(docs, labels)
    texts = {x["doc_id"]: x["text"] for x in docs.collect()}
    y = {x["doc_id"]: x["toxic"] for x in labels.collect() if zlib.crc32(str(x["doc_id"]).encode()) % 5}
    rows = {d: slow_grams(texts[d]) for d in y}
    n = {v: sum(x == v for x in y.values()) for v in (0, 1)}
    for bucket in rows[min(y)][:20]:
        seen = {v: sum(bucket in rows[d] for d in y if y[d] == v) for v in (0, 1)}
        ratio = math.log((seen[1] + 1) / (n[1] + 2) * (n[0] + 2) / (seen[0] + 1))
        assert T.log_count_ratios([np.array(rows[d]) for d in y], np.array(list(y.values())))[bucket] == pytest.approx(ratio)
    for x in T.score(docs, model).where("doc_id < 20").collect():
        own = slow_grams(texts[x["doc_id"]])
        z = sum(float(model.weights[b]) for b in own) / math.sqrt(len(own)) + model.bias
        assert x["score"] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-4) and x["predicted"] == int(x["score"] >= 0.5)


def test_held_out_toxicity_of_rare_words(spark):
    draw = np.random.Generator(np.random.PCG64(5))
    texts, toxic = [], []
    for i in range(600):
        words = prose(i, 150).split()
        toxic.append(int(i % 3 == 0))
        if toxic[-1]:  # one word of a family that shares its start only
            words[int(draw.integers(150))] = "vrelk" + prose(1000 + i, 1)
        texts.append(" ".join(words))
    docs, labels = documents(spark, texts), spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    rows = [x for x in T.score(docs, T.train(docs, labels)).collect() if x["held_out"]]
    right = {v: np.mean([x["predicted"] == v for x in rows if toxic[x["doc_id"]] == v]) for v in (0, 1)}
    assert right[1] >= 0.9 and right[0] >= 0.95


def test_grades(spark):
    marks = ["splendid", "thorough", "wellmade"]
    docs = documents(spark, [" ".join([prose(i, 40), *marks[: i % 4], prose(500 + i, 10)]) for i in range(400)])
    labels = spark.createDataFrame([(i, i % 4) for i in range(400)], "doc_id long, quality int")
    model = C.train(docs, labels)
    assert model.grades.tolist() == [0, 1, 2, 3] and (np.diff(model.thresholds) > 0).all()
    texts, grade = {x["doc_id"]: x["text"] for x in docs.collect()}, {x["doc_id"]: x["quality"] for x in labels.collect()}
    rows = C.grade(docs, model, tail=0.6).collect()
    for x in rows[:40]:
        own = C.features(texts[x["doc_id"]])
        z = sum(float(model.weights[b]) for b in own) / math.sqrt(len(own))
        tails = [1.0, *(1 / (1 + math.exp(-(z - t))) for t in model.thresholds), 0.0]
        p = [a - b for a, b in zip(tails, tails[1:], strict=False)]
        assert x["expected_grade"] == pytest.approx(sum(g * q for g, q in zip(model.grades, p, strict=True)), rel=1e-3, abs=1e-4)
        assert x["tail_probability"] == pytest.approx(tails[1], rel=1e-3, abs=1e-6) and x["selected"] == (x["tail_probability"] >= 0.6)
        assert x["predicted"] == model.grades[int(np.argmax(p))]
    held = [x for x in rows if x["held_out"]]
    assert np.corrcoef([x["expected_grade"] for x in held], [grade[x["doc_id"]] for x in held])[0, 1] > 0.8


def test_fractions_are_grades_and_endless_scales_are_refused(spark):
    docs, labels = labelled(spark)
    halves = labels.select("doc_id", (F.col("quality") / 2 + 0.25).alias("quality"))
    assert C.train(docs, halves).grades.tolist() == [0.25, 0.75, 1.25, 1.75]
    with pytest.raises(ValueError, match="different values"):
        C.train(docs, labels.select("doc_id", F.col("doc_id").alias("quality")))


def test_sample_is_bounded_by_bytes(spark, monkeypatch):
    docs, labels = labelled(spark)
    size = {x["doc_id"]: len(x["text"].encode()) for x in docs.collect()}
    monkeypatch.setattr(fitting, "BYTES_PER_LABEL", 20_000)
    x, y = fitting.labelled_sample(docs, labels, "toxic", ngrams.word_grams)
    whole = sorted(size.values())
    assert len(x) == len(y) and 20_000 // whole[-1] - 1 <= (y == 1).sum() <= 20_000 // whole[0] and (y == 0).sum() > 0
    monkeypatch.setattr(fitting, "BYTES_PER_LABEL", 1)
    assert sorted(fitting.labelled_sample(docs, labels, "toxic", ngrams.word_grams)[1].tolist()) == [0.0, 1.0]
    assert re.fullmatch("[01]", str(T.score(awkward(spark), T.train(docs, labels)).first()["predicted"]))


def test_labels_of_very_many_values(spark):
    """Toxicity needs a label's sign alone; ratings of more values than the scale has are cut at quantiles."""
    texts = [f"{'bad vile ' if i % 3 == 0 else 'good fine '}{prose(i, 6)}" for i in range(400)]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, (i % 3 == 0) * (1 + i / 7), i / 4 + (200 if i % 3 == 0 else 0)) for i in range(400)], "doc_id long, toxic double, quality double")
    found = T.score(docs, T.train(docs, labels)).collect()
    assert all(x["predicted"] == (x["doc_id"] % 3 == 0) for x in found)
    scaled = fitting.graded(labels, "quality").collect()
    assert len(scaled) == 400 and 50 < len({x["quality"] for x in scaled}) <= fitting.MOST_GRADES
    far = [x for x in scaled if abs(x["quality"] - (x["doc_id"] / 4 + (200 if x["doc_id"] % 3 == 0 else 0))) >= 3]
    assert len(far) <= 5  # one grade may lie over the gap
    graded = C.grade(docs, C.train(docs, labels, rows=20, any_scale=True)).collect()
    high = [x["expected_grade"] for x in graded if x["doc_id"] % 3 == 0]
    low = [x["expected_grade"] for x in graded if x["doc_id"] % 3]
    assert sum(high) / len(high) > sum(low) / len(low) + 40
