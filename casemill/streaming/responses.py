"""Batch responses as a stream: files that arrive in a folder become scores and running counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from casemill.sources.readers import RESPONSE_SCHEMA, parsed_responses


def arriving(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Scores of response files as they arrive, with the time of their reading."""
    raw = spark.readStream.schema(RESPONSE_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    return parsed_responses(raw).withColumn("readAt", F.current_timestamp())


def progress_by_window(scores: DataFrame, late: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """Answers and failures by time window; state of windows older than the watermark is dropped."""
    return scores.withWatermark("readAt", late).groupBy(F.window("readAt", width)).agg(F.count("*").alias("n"), F.count_if("failed").alias("failed"))


def collect_available(scores: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append all that has arrived to a Parquet folder, once each, and stop."""
    return scores.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
