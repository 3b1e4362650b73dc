"""Long runs over a table in chunks: progress, cancelling, and going on where a run stopped.

The input is written once, a folder for each chunk, and each chunk's result is a Parquet table of its own in the shared
folder. Spark's commit decides whether a chunk is finished: its _SUCCESS file stands only once all its tasks are committed.
What is finished is the ledger; a run that is started again works the other chunks off and no finished one twice.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: States of a run.
PENDING, RUNNING, COMPLETED, CANCELLED, FAILED = "pending", "running", "completed", "cancelled", "failed"


class Folder:
    """A folder that driver and executors share, on any file system Spark can write."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def __contains__(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(name))) if name in self else []

    def write(self, name: str, value: dict) -> None:
        """A small JSON file, under its name only once it is whole."""
        part = self._path(f"_{name}.part")
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        self._fs.delete(self._path(name), False)
        self._fs.rename(part, self._path(name))

    def read(self, name: str) -> dict | None:
        if name not in self:
            return None
        source = self._fs.open(self._path(name))
        text = self._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        source.close()
        return json.loads(text)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


@dataclass
class Progress:
    state: str
    done: int
    chunks: int
    rows_done: int
    rows: int
    error: str | None = None

    @property
    def percent(self) -> int:
        """Rows worked off of all, as a whole number of hundredths; 0 when there is nothing to do."""
        return int(self.rows_done * 100 / self.rows + 0.5) if self.rows else 0


class Run:
    """A named run in a folder; other sessions that name the same folder see and cancel it."""

    def __init__(self, spark: SparkSession, folder: str, name: str) -> None:
        self.spark, self.name, self.folder = spark, name, Folder(spark, f"{folder.rstrip('/')}/{name}")
        self.tag = f"run-{name}"

    def prepare(self, df: DataFrame, key: str, chunks: int) -> None:
        """Write df in chunks, dealt by a hash of key; once it is written, later calls change nothing."""
        if chunks < 1:
            raise ValueError("chunks is 1 or more")
        if "plan.json" in self.folder:
            return
        # A key may hold many rows: they are dealt over chunks by all that they hold.
        dealt = df.withColumn("_chunk", F.pmod(F.xxhash64(F.col(key), *[F.col(c) for c in df.columns if c != key]), F.lit(chunks)).cast("int"))
        dealt.write.mode("overwrite").partitionBy("_chunk").parquet(f"{self.folder.path}/input")
        sizes = {str(x["_chunk"]): x["n"] for x in self._input(df).groupBy("_chunk").agg(F.count("*").alias("n")).collect()} if self.folder.names("input") != ["_SUCCESS"] else {}
        self.folder.write("plan.json", {"chunks": chunks, "sizes": sizes, "schema": df.schema.json()})

    def _input(self, df: DataFrame) -> DataFrame:
        return self.spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema.fields)}, _chunk int").parquet(f"{self.folder.path}/input")

    def _sizes(self) -> dict[int, int]:
        plan = self.folder.read("plan.json")
        return {int(k): v for k, v in plan["sizes"].items()} if plan else {}

    def finished(self) -> list[int]:
        """The chunks whose results are committed."""
        return [c for c in sorted(self._sizes()) if f"result/part={c}/_SUCCESS" in self.folder]

    def progress(self) -> Progress:
        sizes, done = self._sizes(), self.finished()
        state = self.folder.read("state.json") or {"state": PENDING}
        return Progress(state["state"], len(done), len(sizes), sum(sizes[c] for c in done), sum(sizes.values()), state.get("error"))

    def ledger(self) -> DataFrame:
        """chunk, n, finished, seconds: one row for each chunk that has rows."""
        rows, done = [], set(self.finished())
        for c, n in sorted(self._sizes().items()):
            rows.append((c, n, c in done, (self.folder.read(f"times-{c}.json") or {}).get("seconds")))
        return self.spark.createDataFrame(rows, "chunk int, n long, finished boolean, seconds double")

    def cancel(self, now: bool = False) -> None:
        """Stop after the chunk at work; with now its jobs are cancelled too, and that chunk is worked off again later."""
        self.folder.write("cancelled.json", {"at": time.time()})
        if now:
            self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def _cancelled(self) -> bool:
        return "cancelled.json" in self.folder

    def go(self, work: Callable[[DataFrame], DataFrame]) -> Progress:
        """Work off the chunks that aren't finished, one after the other; work turns a chunk's rows into its result's.

        A chunk that fails ends the run as failed, and the error goes on to the caller; what is finished stays.
        """
        plan = self.folder.read("plan.json")
        if not plan:
            raise ValueError("prepare the run first")
        self.folder.delete("cancelled.json")
        done, context = set(self.finished()), self.spark.sparkContext
        schema = StructType.fromJson(json.loads(plan["schema"]))
        self.folder.write("state.json", {"state": RUNNING})
        for c in sorted(self._sizes()):
            if c in done:
                continue
            if self._cancelled():
                self.folder.write("state.json", {"state": CANCELLED})
                return self.progress()
            rows, began = self.spark.read.schema(schema).parquet(f"{self.folder.path}/input/_chunk={c}"), time.monotonic()
            context.addJobTag(self.tag)
            try:
                work(rows).write.mode("overwrite").parquet(f"{self.folder.path}/result/part={c}")
            except Exception as error:
                stopped = self._cancelled()
                self.folder.write("state.json", {"state": CANCELLED} if stopped else {"state": FAILED, "error": str(error)[:2000]})
                if stopped:
                    return self.progress()
                raise
            finally:
                context.removeJobTag(self.tag)
            self.folder.write(f"times-{c}.json", {"seconds": round(time.monotonic() - began, 3)})
        self.folder.write("state.json", {"state": COMPLETED})
        return self.progress()

    def result(self, schema: str) -> DataFrame:
        """The rows of all finished chunks; none finished: no rows."""
        paths = [f"{self.folder.path}/result/part={c}" for c in self.finished()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

