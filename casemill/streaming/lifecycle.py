"""The life of batch requests: from asking to an answer, a failure, or nothing in time.

As a stream, each request is a key with state: when it was asked, whether it is answered, and a timer at its deadline, after
which it is missing; for as long again it is remembered, so that an answer then is late and no stranger. As tables, the same
outcomes come from one aggregation and a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Hours that an answer may take.
HOURS = 24
#: What a row of the stream says of a request; the first four are said once, the others once for each answer.
ANSWERED, FAILED, MISSING, UNASKED, REPEATED, LATE = "answered", "failed", "missing", "unasked", "repeated", "late"

EVENT = "custom_id string, kind string, failed boolean, at timestamp"
NEWS = "custom_id string, outcome string, asked timestamp, at timestamp"
_STATE = "asked long, first long, failed boolean, said string, more long"


def events(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests (custom_id, at) and responses (custom_id, failed, at) as events; without an id or a time there is none."""
    asked = requests.select(F.col("custom_id").cast("string").alias("custom_id"), F.lit("request").alias("kind"), F.lit(False).alias("failed"), "at")
    told = responses.select(F.col("custom_id").cast("string").alias("custom_id"), F.lit("response").alias("kind"), F.coalesce("failed", F.lit(False)).alias("failed"), "at")
    return asked.unionByName(told).where(F.col("custom_id").isNotNull() & F.col("at").isNotNull())


class Life(StatefulProcessor):
    """State of a request: asked and first answer in milliseconds (0: not yet), whether that failed, what was said, answers held back."""

    def __init__(self, hours: float) -> None:
        self.wait = int(hours * 3_600_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("life", _STATE)

    def close(self) -> None:
        pass

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - names given by Spark
        asked, first, failed, said, more = self.state.get() if self.state.exists() else (0, 0, False, "", 0)
        out: list[tuple[str, int, int]] = []
        for pdf in rows:
            pdf = pdf.sort_values(["at", "kind"])
            for kind, bad, at in zip(pdf["kind"], pdf["failed"], pdf["at"].astype("datetime64[ms]").astype("int64"), strict=True):
                at = int(at)
                if kind == "request":
                    if asked:
                        continue
                    asked = at
                    self._timer(at + self.wait)
                    if first:  # an answer that came before its request was read
                        self._forget(first + self.wait)
                        late = first > asked + self.wait
                        said = "" if late else FAILED if failed else ANSWERED
                        out.append((LATE if late else said, asked, first))
                        out += [(REPEATED, asked, first)] * more
                        first, more = 0 if late else first, 0
                elif not asked:
                    if first:
                        more += 1
                    else:
                        first, failed = at, bool(bad)
                        self._timer(at + self.wait)
                elif said == MISSING or at > asked + self.wait:
                    out.append((LATE, asked, at))
                elif first:
                    out.append((REPEATED, asked, at))
                else:
                    first, failed, said = at, bool(bad), FAILED if bad else ANSWERED
                    out.append((said, asked, at))
        self.state.update((asked, first, failed, said, more))
        yield self._news(key, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        asked, first, failed, said, more = self.state.get()
        at, out = expiredTimerInfo.getExpiryTimeInMs(), []
        if not asked:
            out = [(UNASKED, 0, first)]
            self.state.clear()
        elif at >= asked + 2 * self.wait:
            self.state.clear()
        else:
            if not said:
                out = [(MISSING, asked, at)]
                self.state.update((asked, first, failed, MISSING, more))
            self._timer(asked + 2 * self.wait)
        yield self._news(key, out)

    def _timer(self, at: int) -> None:
        self.handle.registerTimer(at)

    def _forget(self, at: int) -> None:
        self.handle.deleteTimer(at)

    @staticmethod
    def _news(key: Any, rows: list[tuple[str, int, int]]) -> pd.DataFrame:
        time = lambda x: pd.Timestamp(x, unit="ms") if x else pd.NaT
        # Texts as objects: the serializer takes no columns of Arrow's own.
        text = lambda x: pd.Series(x, dtype=object)
        return pd.DataFrame({"custom_id": text([key[0]] * len(rows)), "outcome": text([r[0] for r in rows]), "asked": pd.Series([time(r[1]) for r in rows], dtype="datetime64[ns]"), "at": pd.Series([time(r[2]) for r in rows], dtype="datetime64[ns]")})


def followed(stream: DataFrame, hours: float = HOURS, delay: str = "1 hour") -> DataFrame:
    """News of requests from a stream of events; events older than the watermark, delay behind the newest, are left out.

    One row says answered, failed, missing (at the deadline) or unasked (an answer whose request never came), and one
    each says repeated (a further answer in time) or late (one after the deadline, as long as the request is remembered).
    The session's state store must be RocksDB, which stateful processors of this kind need.
    """
    timed = stream.withWatermark("at", delay)
    return timed.groupBy("custom_id").transformWithStateInPandas(statefulProcessor=Life(hours), outputStructType=NEWS, outputMode="Append", timeMode="EventTime")


def outcomes(requests: DataFrame, responses: DataFrame, hours: float = HOURS) -> DataFrame:
    """custom_id, outcome, waited (seconds to the first answer in time), repeated, late: every request's end, from whole tables.

    Answers whose request is nowhere are unasked. Of several requests of one id the first counts.
    """
    both = events(requests, responses)
    asked = both.where(F.col("kind") == "request").groupBy("custom_id").agg(F.min("at").alias("asked"))
    told = both.where(F.col("kind") == "response").alias("r").join(asked.alias("q"), "custom_id", "full_outer")
    due = F.col("q.asked") + F.expr(f"INTERVAL {int(hours * 3600)} SECONDS")
    intime = F.col("r.at") <= due
    per = told.groupBy("custom_id").agg(
        F.min("q.asked").alias("asked"),
        F.min(F.when(intime, F.struct("r.at", "r.failed"))).alias("first"),
        F.count_if(intime).alias("n"),
        F.count_if(F.col("r.at") > due).alias("late"),
    )
    outcome = F.when(F.col("asked").isNull(), UNASKED).when(F.col("first").isNull(), MISSING).when(F.col("first.failed"), FAILED).otherwise(ANSWERED)
    waited = F.col("first.at").cast("double") - F.col("asked").cast("double")
    return per.select("custom_id", outcome.alias("outcome"), waited.alias("waited"), F.greatest(F.lit(0), F.col("n") - 1).cast("long").alias("repeated"), "late")
