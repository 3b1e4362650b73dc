"""Rows from counts, quotas and mixes; set operators; diversity against a history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.operators.windows import numbered


def expanded(matrix: DataFrame, count: str, name: str = "copy") -> DataFrame:
    """Each row as many times as its count says, numbered from 1; counts of 0 or less and nulls give none."""
    return matrix.where(F.col(count) > 0).withColumn(name, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(count).cast("bigint"))))


def share_of(index: Column, n: Column, percents: dict[str, float]) -> Column:
    """The class of row index (from 0) of n rows dealt by percent in turn; percents are scaled to 100, and the last class takes the rest."""
    if sum(percents.values()) <= 0:
        raise ValueError("some percent is above 0")
    total, end = sum(percents.values()), F.lit(0)
    *names, last = percents
    label = None
    for name in names:
        end = end + F.floor(F.lit(percents[name] * 100 / total) * n / F.lit(100) + F.lit(0.5))
        label = F.when(index < end, name) if label is None else label.when(index < end, name)
    return F.lit(last) if label is None else label.otherwise(last)


def mixed(spark: SparkSession, n: int, percents: dict[str, float]) -> DataFrame:
    """n rows (index, class) dealt to classes by percent."""
    if n < 1:
        raise ValueError("n is 1 or more")
    return spark.range(n).select(F.col("id").alias("index"), share_of(F.col("id"), F.lit(n), percents).alias("class"))


def dealt(df: DataFrame, order: list[Column], percents: dict[str, float], name: str = "class") -> DataFrame:
    """Rows of df dealt to classes by percent in a unique order; they are numbered over many tasks."""
    n = df.agg(F.count("*")).scalar()
    return numbered(df, order, "_at").withColumn(name, share_of(F.col("_at") - 1, n, percents)).drop("_at")


def quotas(shares: DataFrame, total: int, share: str = "share") -> DataFrame:
    """A whole number of rows for each share of a total, rounded."""
    return shares.withColumn("quota", F.floor(F.col(share) * total + 0.5).cast("bigint"))


def assigned(seeds: DataFrame, order: list, slots: DataFrame, slot_order: list) -> DataFrame:
    """The i-th seed takes the i-th slot; seeds or slots beyond the shorter side are left out. Both orders are unique."""
    return numbered(seeds, order, "_at").join(numbered(slots, slot_order, "_at"), "_at").drop("_at")


def every(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, by column name; what a frame lacks is null."""
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def distinct_of(*frames: DataFrame) -> DataFrame:
    return every(*frames).distinct()


def without(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of a that b lacks."""
    return a.subtract(b)


def diversity_issues(seeds: DataFrame, history: DataFrame) -> DataFrame:
    """seed id and issue: an entity of the history again, or an event with the same first 50 characters.

    seeds and history: id, entities (array), event.
    """
    event = F.lower(F.substring("event", 1, 50)).alias("event")
    used = history.select(F.explode("entities").alias("entity")).select(F.lower("entity").alias("_key")).distinct()
    own = seeds.select("id", F.explode("entities").alias("entity"))
    twice = own.withColumn("_key", F.lower("entity")).join(used, "_key", "left_semi").select("id", F.concat(F.lit("Duplicate entity: "), F.col("entity")).alias("issue"))
    again = seeds.select("id", event).join(history.select(event).distinct(), "event", "left_semi").select("id", F.lit("Similar event already used").alias("issue"))
    return twice.unionByName(again)


def check_size(n: int, most: int, least: int = 1) -> int:
    """n itself, if a request of that size is allowed."""
    if not least <= n <= most:
        raise ValueError(f"size must lie between {least} and {most}")
    return n
