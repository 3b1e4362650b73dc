"""Calls of an outside service for each row: at a bounded rate, tried again after a pause, and never twice for one key.

Every answer is written to a journal in the shared folder as soon as it is there, and the result is read from the journal. A
task that is tried again passes over what its journal holds; a later action first joins the journal and calls for the
keys that it lacks. Only a task that dies between an answer and its line of the journal leaves a call unknown: the key
goes along with each call, so that a service can tell.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pace:
    """calls a second of all callers together, callers at a time, tries for a call, and the first pause (doubled each time)."""

    rate: float = 10.0
    callers: int = 4
    tries: int = 4
    pause: float = 0.5
    longest_pause: float = 60.0

    def __post_init__(self) -> None:
        if self.rate <= 0 or self.callers < 1 or self.tries < 1:
            raise ValueError("rate is above 0, callers and tries are 1 or more")


class Turns:
    """The times at which one caller may call: never more than its part of the rate, whatever the calls take."""

    def __init__(self, pace: Pace, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.gap, self.clock, self.sleep, self.next = pace.callers / pace.rate, clock, sleep, clock()

    def wait(self) -> None:
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
        self.next = max(now, self.next) + self.gap


def tried(call: Callable[[], dict], pace: Pace, turns: Turns) -> tuple[dict | None, str | None, int]:
    """A call's answer, or the last error, and how often it was tried.

    Between tries it pauses twice as long each time, or as long as the error's retry_after says.
    """
    pause = pace.pause
    for n in range(1, pace.tries + 1):
        turns.wait()
        try:
            return call(), None, n
        except Exception as error:  # the outside service may fail in any way
            if n == pace.tries:
                return None, f"{type(error).__name__}: {error}", n
            turns.sleep(min(pace.longest_pause, getattr(error, "retry_after", None) or pause))
            pause *= 2
    raise AssertionError


def _local(path: str) -> str:
    return "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path


class Journal:
    """Lines of answers of one part, a file for each task that wrote some; the last line of a task that died may be torn."""

    def __init__(self, folder: str, part: int) -> None:
        from pyarrow import fs

        self.fs, path = fs.FileSystem.from_uri(_local(folder))
        self.path, self.out = f"{path}/part={part}", None

    def keys(self, since: str) -> set[str]:
        """Keys with a line written by this action (answered or given up), or answered by any."""
        from pyarrow import fs

        found = set()
        for x in self.fs.get_file_info(fs.FileSelector(self.path, allow_not_found=True)):
            if x.type == fs.FileType.File:
                with self.fs.open_input_stream(x.path) as source:
                    for line in source.read().decode("utf-8", "replace").split("\n"):
                        try:
                            entry = json.loads(line)
                        except ValueError:
                            continue
                        if entry.get("error") is None or entry.get("action") == since:
                            found.add(entry["key"])
        return found

    def add(self, entry: dict) -> None:
        if self.out is None:
            self.fs.create_dir(self.path)
            self.out = self.fs.open_output_stream(f"{self.path}/{uuid.uuid4().hex}.json")
        self.out.write(json.dumps(entry).encode() + b"\n")
        self.out.flush()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def journal(df: DataFrame, folder: str, fields: dict[str, str]) -> DataFrame:
    """key, answer, error, tries of every key in the journal, one row each: its answer if there is one, else an error."""
    kind = ", ".join(f"`{k}`: {v}" for k, v in fields.items())
    schema = f"key string, answer struct<{kind}>, error string, tries int, part int"
    try:
        lines = df.sparkSession.read.schema(schema).option("mode", "DROPMALFORMED").json(folder)
        lines.isEmpty()
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        lines = df.sparkSession.createDataFrame([], schema)
    best = F.min_by(F.struct("answer", "error", "tries"), F.struct(F.col("error").isNotNull(), "tries"))
    return lines.where(F.col("key").isNotNull()).groupBy("key").agg(best.alias("_b")).select("key", "_b.*")


def called(df: DataFrame, key: str, caller: Callable[[dict, str], dict], fields: dict[str, str], folder: str, pace: Pace | None = None) -> DataFrame:
    """df with the fields that caller(row, key) answers, and the columns error and tries.

    A key is called once: rows that share one share its answer, and the row that is given is the first in the order of its
    columns. Rows with a null key aren't called. Keys given up with an error are called again by the next action over the
    same folder, answered ones never. The work is dealt by a hash over pace.callers parts, each of which keeps to its part of
    the rate; the session must not run tasks twice at once (speculation).
    """
    pace, spark = pace or Pace(), df.sparkSession
    if spark.conf.get("spark.speculation", "false") == "true":
        raise ValueError("speculative tasks would call twice")
    action, columns = uuid.uuid4().hex, list(df.columns)
    keyed = df.where(F.col(key).isNotNull()).withColumn("_key", F.col(key).cast("string"))
    answered = journal(df, folder, fields).where(F.col("error").isNull()).select(F.col("key").alias("_key"))
    todo = keyed.groupBy("_key").agg(F.min(F.struct(*columns)).alias("_row")).join(answered, "_key", "left_anti")
    dealt = todo.withColumn("_part", F.pmod(F.xxhash64("_key"), F.lit(pace.callers)).cast("int"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turns, journals, seen = Turns(pace), {}, {}
        try:
            for pdf in batches:
                for part, name, row in zip(pdf["_part"], pdf["_key"], pdf["_row"], strict=True):
                    if part not in journals:
                        journals[part] = Journal(folder, part)
                        seen[part] = journals[part].keys(action)
                    if name in seen[part]:
                        continue
                    answer, error, n = tried(lambda row=row, name=name: caller(dict(row), name), pace, turns)
                    entry = {"key": name, "answer": answer, "error": error, "tries": n, "action": action}
                    journals[part].add(entry)
                yield pd.DataFrame({"n": [len(pdf)]})
        finally:
            for x in journals.values():
                x.close()

    # The calls are made by one action, here; what comes after reads their answers.
    placed = dealt.repartition(pace.callers, "_part").select("_part", "_key", F.struct(*[F.col(f"_row.{c}").alias(c) for c in columns]).alias("_row"))
    placed.mapInPandas(run, "n long").agg(F.sum("n")).collect()
    answers = journal(df, folder, fields).select(F.col("key").alias("_key"), *[F.col(f"answer.{f}").alias(f) for f in fields], "error", "tries")
    return df.withColumn("_key", F.col(key).cast("string")).join(answers, "_key", "left").drop("_key")
