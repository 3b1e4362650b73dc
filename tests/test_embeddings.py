"""Hashed TF-IDF and its directions against numpy."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from casemill.operators import embeddings as E


def _texts(n, seed=1):
    draw = random.Random(seed)
    topics = [[f"w{t}x{i}" for i in range(25)] for t in range(6)]
    return [" ".join(draw.choice(topics[d % 6]) if draw.random() < 0.8 else f"rare{draw.randrange(200)}" for _ in range(draw.randrange(8, 60))) for d in range(n)]


def _dense(rows, places):
    x = np.zeros((len(rows), places))
    for i, r in enumerate(sorted(rows, key=lambda r: r["id"])):
        x[i, r["at"]] = r["w"]
    return x


def test_tfidf(spark):
    texts = ["a b b, c", "B a", None, "", "--"]
    df = spark.createDataFrame([*enumerate(texts), (None, "a")], "id long, t string")
    got = {r["id"]: r for r in E.tfidf(df, "id", "t", 1 << 20).collect()}
    assert set(got) == {0, 1, 2, 3, 4} and [len(got[i]["at"]) for i in range(5)] == [3, 2, 0, 0, 0]
    weight = lambda tf, seen: (1 + np.log(tf)) * (np.log(6 / (1 + seen)) + 1)
    want = np.array([weight(1, 2), weight(2, 2), weight(1, 1)])
    assert np.allclose(sorted(got[0]["w"]), sorted(want / np.linalg.norm(want)))


def test_directions_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(E, "FAN", 2)  # parts are added up in several rounds
    df = spark.createDataFrame(list(enumerate(_texts(240))), "id long, t string").repartition(7)
    rows = E.tfidf(df, "id", "t", 256)
    basis, values = E.directions(rows.repartition(7), 256, 6)
    x = _dense(rows.collect(), 256)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    assert basis.shape == (256, 6) and np.allclose(basis.T @ basis, np.eye(6), atol=1e-9)
    assert np.allclose(values, s[:6], rtol=1e-3)
    error = np.linalg.norm(x - x @ basis @ basis.T)
    best = np.linalg.norm(x - x @ vt[:6].T @ vt[:6])
    assert error <= 1.001 * best


def test_embeddings_bring_topics_together(spark):
    df = spark.createDataFrame([*enumerate(_texts(120)), (500, None)], "id long, t string").withColumn("k", F.lit(1)).withColumn("v", F.lit(2))
    got = {r["id"]: np.array(r["embedding"]) for r in E.embedded(df, "id", "t", 512, 6).collect()}
    assert len(got) == 121 and not got.pop(500).any()
    assert all(abs(np.linalg.norm(v) - 1) < 1e-9 for v in got.values())
    x = np.array([got[i] for i in range(120)])
    s = x @ x.T
    same = np.arange(120)[:, None] % 6 == np.arange(120)[None] % 6
    assert s[same].mean() > s[~same].mean() + 0.5
    assert E.embedded(df.limit(0), "id", "t", 64, 3).count() == 0


def test_weights_without_a_shuffle(spark):
    """Rows are counted and weighed where they are: the plan of the weights moves no row."""
    df = spark.createDataFrame([*enumerate(_texts(20)), (30, None)], "id long, t string")
    rows = E.tfidf(df, "id", "t", 64)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert len(rows.collect()) == 21
