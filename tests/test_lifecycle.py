"""Requests' lives as a stream, trigger by trigger, and as tables."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from casemill.streaming import lifecycle as L

T0 = datetime(2026, 1, 1)


def _at(hours):
    return T0 + timedelta(hours=hours)


@pytest.fixture
def stores(spark):
    names = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _streamed(spark, tmp_path, batches, hours=24):
    """All news of events that arrive in one file after the other."""
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema(L.EVENT).option("maxFilesPerTrigger", 1).parquet(str(source / "*"))
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, L.EVENT).coalesce(1).write.parquet(str(source / f"{i:03d}"))
        query = L.followed(stream, hours).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    return [tuple(x) for x in spark.read.schema(L.NEWS).parquet(str(tmp_path / "out")).collect()]


def test_late_repeated_and_missing_answers(spark, tmp_path, stores):
    ask = lambda i, h: (i, "request", False, _at(h))
    tell = lambda i, h, bad=False: (i, "response", bad, _at(h))
    batches = [
        [ask("quick", 0), tell("quick", 1), ask("bad", 0), ask("never", 0), ask("slow", 0), ask("early", 3), tell("stranger", 2)],
        [tell("bad", 5, True), tell("quick", 6), ask("quick", 7)],
        [ask("clock", 26)],
        [tell("slow", 30), ask("clock", 30)],
        [ask("clock2", 80)],
        [ask("clock3", 120)],
    ]
    news = _streamed(spark, tmp_path, batches)
    by = {}
    for i, outcome, asked, at in news:
        by.setdefault(i, []).append((outcome, asked, at))
    assert by["quick"] == [("answered", _at(0), _at(1)), ("repeated", _at(0), _at(6))]
    assert by["bad"] == [("failed", _at(0), _at(5))]
    assert by["never"] == [("missing", _at(0), _at(24))]
    assert sorted(by["slow"]) == [("late", _at(0), _at(30)), ("missing", _at(0), _at(24))]
    assert by["stranger"] == [("unasked", None, _at(2))]
    assert by["early"][0][0] == "missing" and by["clock"] == [("missing", _at(26), _at(50))]


def test_stream_agrees_with_tables(spark, tmp_path, stores):
    draw, rows = random.Random(6), []
    for i in range(60):
        asked = draw.uniform(0, 40)
        rows.append((f"r{i}", "request", False, _at(asked)))
        for _ in range(draw.choice([0, 1, 1, 1, 2, 3])):
            rows.append((f"r{i}", "response", draw.random() < 0.2, _at(asked + draw.choice([0.01, 1, 5, 23.9, 30, 40]) * draw.uniform(0.5, 1))))
    rows.sort(key=lambda x: x[3])
    batches = [rows[i : i + 70] for i in range(0, len(rows), 70)] + [[("end", "request", False, _at(500))], [("end2", "request", False, _at(900))]]
    news = [x for x in _streamed(spark, tmp_path, batches) if not x[0].startswith("end")]
    df = spark.createDataFrame(rows, L.EVENT)
    want = {x["custom_id"]: x for x in L.outcomes(df.where("kind = 'request'"), df.where("kind = 'response'")).collect()}
    got = {i: Counter(x[1] for x in news if x[0] == i) for i in want}
    for i, x in want.items():
        assert got[i][x["outcome"]] == 1 and got[i]["repeated"] == x["repeated"] and got[i]["late"] == x["late"], (i, x, got[i])
        assert sum(got[i][o] for o in ("answered", "failed", "missing", "unasked")) == 1


def test_tables(spark):
    asks = spark.createDataFrame([("a", _at(0)), ("a", _at(9)), ("b", _at(0)), ("c", _at(0)), (None, _at(0)), ("d", None)], "custom_id string, at timestamp")
    tells = spark.createDataFrame([("a", None, _at(24)), ("a", True, _at(25)), ("b", True, _at(2)), ("b", False, _at(3)), ("x", False, _at(1))], "custom_id string, failed boolean, at timestamp")
    got = {x["custom_id"]: tuple(x)[1:] for x in L.outcomes(asks, tells).collect()}
    assert got == {"a": ("answered", 86400.0, 0, 1), "b": ("failed", 7200.0, 1, 0), "c": ("missing", None, 0, 0), "x": ("unasked", None, 0, 0)}
    assert L.outcomes(asks.limit(0), tells.limit(0)).count() == 0 and L.events(asks, tells).where(F.col("custom_id") == "d").count() == 0
