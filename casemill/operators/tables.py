"""Tables written once in the cluster's shared folder and read from there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import casemill

# Executors need no copy of this package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(casemill)

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; on local masters without the setting a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="spark-"))
    return _own[0]


def settled(df: DataFrame, name: str) -> DataFrame:
    """df as it is now, worked out once: written as Parquet, so that a lost executor costs nothing and no memory is held."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
