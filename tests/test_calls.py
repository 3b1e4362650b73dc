"""Outside calls: how often, how fast, and what a task that dies leaves."""

from __future__ import annotations

import glob
import json
import os
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from casemill.operators import calls

FIELDS = {"twice": "long", "note": "string"}


def _caller(log, fails=(), dies=None):
    """A service that notes every call; fails for some keys the first n times, and ends its process at one key, once."""

    def call(row, key):
        with open(f"{log}/{key}-{time.time_ns()}-{os.getpid()}", "w") as out:
            out.write("x")
        n = len(glob.glob(f"{log}/{key}-*"))
        if dies == key and not os.path.exists(f"{log}/died"):
            with open(f"{log}/died", "w"):
                os._exit(1)
        if n <= dict(fails).get(key, 0):
            raise ConnectionError("busy")
        return {"twice": row["id"] * 2, "note": f"{row['name']}!"}

    return call


def _calls(log):
    return Counter(os.path.basename(x).split("-")[0] for x in glob.glob(f"{log}/*-*"))


@pytest.fixture
def places(tmp_path):
    for x in ("log", "journal"):
        (tmp_path / x).mkdir()
    return str(tmp_path / "log"), str(tmp_path / "journal")


def _rows(spark, n):
    return spark.range(n).withColumn("name", F.concat(F.lit("n"), F.col("id").cast("string")))


QUICK = calls.Pace(rate=1000, callers=3, tries=3, pause=0.01)


def test_every_key_once(spark, places):
    log, folder = places
    df = _rows(spark, 30).union(_rows(spark, 5)).union(spark.createDataFrame([(None, "none")], "id long, name string"))
    got = calls.called(df, "id", _caller(log, {"7": 1}), FIELDS, folder, QUICK).collect()
    assert len(got) == 36 and all(x["twice"] == 2 * x["id"] and x["note"] == f"n{x['id']}!" for x in got if x["id"] is not None)
    assert [tuple(x) for x in got if x["id"] is None] == [(None, "none", None, None, None, None)]
    assert _calls(log) == Counter({str(i): 1 + (i == 7) for i in range(30)})
    assert {x["tries"] for x in got if x["id"] == 7} == {2}
    # A second action, with rows that are new: only those are called.
    more = calls.called(_rows(spark, 33), "id", _caller(log), FIELDS, folder, QUICK)
    assert more.where("twice = 2 * id").count() == 33 and sum(_calls(log).values()) == 34


def test_given_up_and_called_again(spark, places):
    log, folder = places
    got = {x["id"]: x for x in calls.called(_rows(spark, 4), "id", _caller(log, {"2": 5}), FIELDS, folder, QUICK).collect()}
    assert got[2]["twice"] is None and got[2]["error"] == "ConnectionError: busy" and got[2]["tries"] == 3 and got[1]["error"] is None
    again = {x["id"]: x for x in calls.called(_rows(spark, 4), "id", _caller(log, {"2": 5}), FIELDS, folder, QUICK).collect()}
    assert again[2]["twice"] == 4 and again[2]["error"] is None
    assert _calls(log) == Counter({"0": 1, "1": 1, "2": 6, "3": 1})


def test_task_that_dies_calls_no_answered_row_twice(spark, places):
    log, folder = places
    with pytest.raises(Exception):  # noqa: B017 - a local master tries no task again
        calls.called(_rows(spark, 40), "id", _caller(log, dies="11"), FIELDS, folder, QUICK)
    before = _calls(log)
    got = calls.called(_rows(spark, 40), "id", _caller(log, dies="11"), FIELDS, folder, QUICK)
    assert got.where("twice = 2 * id").count() == 40
    # The row at which the task died was never answered; every other one is called once.
    assert 0 < len(before) < 40 and _calls(log) == Counter({str(i): 1 + (i == 11) for i in range(40)})


def test_a_task_tried_again_passes_over_its_journal(tmp_path):
    book = calls.Journal(str(tmp_path), 3)
    for key, error, action in (("a", None, "old"), ("b", "x", "old"), ("c", "x", "now"), ("d", None, "now")):
        book.add({"key": key, "answer": None, "error": error, "tries": 1, "action": action})
    book.out.write(b'{"key": "torn", "ans')
    book.close()
    assert calls.Journal(str(tmp_path), 3).keys("now") == {"a", "c", "d"} and calls.Journal("file:" + str(tmp_path), 4).keys("now") == set()
    assert len(json.loads(open(glob.glob(f"{tmp_path}/part=3/*")[0]).readline())) == 5


class _Clock:
    def __init__(self):
        self.now, self.slept = 100.0, []

    def __call__(self):
        return self.now

    def sleep(self, x):
        self.slept.append(round(x, 6))
        self.now += x


def test_rate_and_pauses():
    clock = _Clock()
    turns = calls.Turns(calls.Pace(rate=8, callers=2), clock, clock.sleep)
    at = []
    for took in (0, 0, 0.1, 1.0, 0, 0):
        turns.wait()
        at.append(clock.now)
        clock.now += took
    assert all(b - a >= 0.25 - 1e-9 for a, b in zip(at, at[1:], strict=False)) and at[4] - at[3] == pytest.approx(1.0)

    class Busy(Exception):
        retry_after = 7.0

    errors = iter([ValueError("a"), ValueError("b"), Busy("c")])

    clock = _Clock()
    pace = calls.Pace(rate=1e9, callers=1, tries=4, pause=0.5)
    answer, error, n = calls.tried(lambda: {"ok": 1} if (x := next(errors, None)) is None else (_ for _ in ()).throw(x), pace, calls.Turns(pace, clock, clock.sleep))
    assert (answer, error, n) == ({"ok": 1}, None, 4) and [x for x in clock.slept if x > 1e-3] == [0.5, 1.0, 7.0]
    with pytest.raises(ValueError, match="rate"):
        calls.Pace(rate=0)


def test_callers_together_keep_the_rate(spark, places):
    log, folder = places
    calls.called(_rows(spark, 24), "id", _caller(log), FIELDS, folder, calls.Pace(rate=12, callers=3)).count()
    times = sorted(int(x.split("-")[-2]) / 1e9 for x in glob.glob(f"{log}/*-*"))
    # In any stretch each caller has at most one call more than its part of the rate.
    assert all(times[j] - times[i] >= (j - i + 1 - 3 - 3) / 12 - 0.05 for i in range(24) for j in range(i, 24))
