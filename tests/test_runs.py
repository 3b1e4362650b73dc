"""Runs in chunks: cancelled, failed and taken up again."""

from __future__ import annotations

import threading
import time

import pytest
from pyspark.sql import functions as F

from casemill.operators import runs

SCHEMA = "id long, twice long"


def _doubled(rows):
    return rows.select("id", (F.col("id") * 2).alias("twice"))


class Counting:
    """Work that notes which rows it was given, and does something at its nth chunk."""

    def __init__(self, at=None, then=None):
        self.seen, self.at, self.then = [], at, then

    def __call__(self, rows):
        self.seen.append(sorted(x["id"] for x in rows.collect()))
        if len(self.seen) == self.at:
            self.then()
        return _doubled(rows)


def _run(spark, tmp_path, n=200, chunks=8, name="r"):
    run = runs.Run(spark, str(tmp_path), name)
    run.prepare(spark.range(n), "id", chunks)
    return run


def test_cancelled_run_resumes_without_repeating(spark, tmp_path):
    run = _run(spark, tmp_path)
    assert run.progress().state == runs.PENDING and run.progress().percent == 0
    other = runs.Run(spark, str(tmp_path), "r")
    first = Counting(3, other.cancel)
    at = run.go(first)
    assert (at.state, at.done, at.chunks, at.rows) == (runs.CANCELLED, 3, 8, 200) and at.rows_done == sum(map(len, first.seen))
    assert 0 < at.percent < 100 and other.progress() == at
    assert run.result(SCHEMA).count() == at.rows_done
    second = Counting()
    end = other.go(second)
    assert (end.state, end.done, end.percent) == (runs.COMPLETED, 8, 100)
    assert sorted(x for part in first.seen + second.seen for x in part) == list(range(200))
    assert sorted(tuple(x) for x in run.result(SCHEMA).collect()) == [(i, 2 * i) for i in range(200)]
    third = Counting()
    assert run.go(third).state == runs.COMPLETED and third.seen == []
    assert {(x["finished"], x["seconds"] is not None) for x in run.ledger().collect()} == {(True, True)}


def test_failed_chunk_is_worked_off_again(spark, tmp_path):
    run = _run(spark, tmp_path, 50, 4)

    def broken():
        raise RuntimeError("service is away")

    first = Counting(2, broken)
    with pytest.raises(RuntimeError, match="away"):
        run.go(first)
    at = run.progress()
    assert (at.state, at.done, at.error) == (runs.FAILED, 1, "service is away")
    second = Counting()
    assert run.go(second).state == runs.COMPLETED
    assert second.seen[0] == first.seen[1] and run.result(SCHEMA).count() == 50


def test_cancelled_now_stops_the_jobs_at_work(spark, tmp_path):
    run = _run(spark, tmp_path, 40, 2)

    def slow(rows):
        def wait(batches):
            for pdf in batches:
                time.sleep(30)
                yield pdf.assign(twice=pdf["id"] * 2)

        return rows.mapInPandas(wait, SCHEMA)

    def stop():
        time.sleep(6)
        runs.Run(spark, str(tmp_path), "r").cancel(now=True)

    began = time.monotonic()
    thread = threading.Thread(target=stop)
    thread.start()
    at = run.go(slow)
    thread.join()
    assert time.monotonic() - began < 28 and (at.state, at.done) == (runs.CANCELLED, 0)
    assert run.go(_doubled).state == runs.COMPLETED and run.result(SCHEMA).count() == 40


def test_hot_key_and_nothing(spark, tmp_path):
    hot = spark.range(300).select(F.lit(1).alias("k"), "id")
    run = runs.Run(spark, str(tmp_path), "hot")
    run.prepare(hot, "k", 5)
    assert max(x["n"] for x in run.ledger().collect()) < 120
    assert run.go(_doubled).percent == 100 and run.result(SCHEMA).count() == 300
    none = runs.Run(spark, str(tmp_path), "none")
    none.prepare(spark.range(0), "id", 3)
    assert none.go(_doubled).state == runs.COMPLETED and none.progress().percent == 0 and none.result(SCHEMA).count() == 0
    with pytest.raises(ValueError, match="prepare"):
        runs.Run(spark, str(tmp_path), "unknown").go(_doubled)
