"""Shared helpers: tables in the cluster's shared folder, Arrow batches, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import casemill

# Executors need no copy of this package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(casemill)

#: Rows of an Arrow batch that a function is given at a time; Spark bounds the batches themselves by bytes.
BATCH_ROWS = 256

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one on local masters without the setting."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="spark-"))
    return _own_folder[0]


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots as double underscores) for the actions inside; afterwards they are as before."""
    named = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in named}
    try:
        for k, v in named.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def cut(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here, and lost executors cost nothing.

    Once the table stands, the shuffle files of its making are deleted. codec: Parquet's, if not the session's.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.parquet(path, compression=codec)
    table = spark.read.schema(df.schema).parquet(path)
    table.shared_path = path
    return table


def forget(table: DataFrame) -> None:
    """Delete a table that cut() wrote and that nothing reads any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.shared_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_batches(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow of a function of a small batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = each(batch)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


def computed(value: Column) -> Column:
    """value as a column of its own, worked out once a row.

    Spark may copy a projected expression into the lambda functions of a later projection and work it out for every
    element there; it doesn't do so through a generator.
    """
    return F.explode(F.array(value))


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of an edge table (a long, b long): one row (node, root) per node, root the smallest node.

    Alternating large-star and small-star rounds: each is a pre-aggregated minimum and one equi-join, so no
    group of neighbours is ever gathered. Each round is cut into the shared folder; only an edge count and a
    checksum reach the driver. Self-loops, repeated edges and nulls are ignored; an empty table gives an empty result.
    """
    low, high = F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")
    now = cut(edges.where(F.col("a") != F.col("b")).select(high, low).distinct(), name)
    before = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if seen == before or seen["n"] == 0:
            break
        before = seen
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        stars = cut(large, name)
        root = stars.groupBy("u").agg(F.min("v").alias("m"))
        small = stars.join(root, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(root.select("u", F.col("m").alias("v"))).distinct()
        then, now = now, cut(small, name)
        forget(then)
        forget(stars)
    rooted = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return rooted.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
