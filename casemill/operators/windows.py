"""Numbering, first rows of groups, recency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.operators.tables import settled


def numbered(df: DataFrame, order: list[Column], name: str = "number", buckets: int | None = None) -> DataFrame:
    """Rows numbered from 1 in a total order, without one task that holds them all.

    Rows are range-partitioned by the order and written so; each partition is numbered by itself and moved by the
    count of those before it. The order must be unique. buckets: the session's shuffle partitions if not given.
    """
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settled(df.repartitionByRange(buckets, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(before), "_part").withColumn(name, (own + F.col("_before")).cast("bigint")).drop("_part", "_before")


def numbered_in(df: DataFrame, by: list[str], order: list[Column], name: str = "number") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def first_of_each(df: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group; Spark keeps n rows a group before the shuffle."""
    return numbered_in(df, by, order, "_at").where(F.col("_at") <= n).drop("_at")


def repeated(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that more than one row has, and their counts."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def most_recent(df: DataFrame, order: list[Column], k: int = 20) -> DataFrame:
    return df.orderBy(*order).limit(k)


def recent_before(df: DataFrame, by: list[str], order: list[Column], value: str, k: int = 20, name: str = "recent", buckets: int | None = None) -> DataFrame:
    """Each row with the values of the k rows before it in its group, nulls left out, without one task that holds a large group.

    Rows are range-partitioned by group and order; a partition's rows see each other by themselves, and its first k rows of
    a group that began before get the last k rows of the parts before, the halo. Only groups that go on from one partition to
    the next have one. The order is unique in a group; k is small: a halo row gathers up to k lists of k.
    """
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settled(df.repartitionByRange(buckets, *by, *order).withColumn("_part", F.spark_partition_id()), "recent")
    inside = Window.partitionBy("_part", *by).orderBy(*order)
    key = F.struct(*by)
    sizes = ranged.groupBy(key.alias("_group"), "_part").agg(F.count("*").alias("_n"))
    # Groups of one part need no halo; those of several are at most two for each partition.
    split = sizes.groupBy("_group").agg(F.count("*").alias("_parts")).where(F.col("_parts") > 1).select("_group")
    own = ranged.join(F.broadcast(split), key.eqNullSafe(F.col("_group")), "left_semi")
    back = F.count("*").over(Window.partitionBy("_part", *by)) - F.row_number().over(inside)
    ends = own.withColumn("_back", back).where(F.col("_back") < k)
    tails = ends.groupBy(key.alias("_group"), "_part").agg(F.sort_array(F.collect_list(F.struct((-F.col("_back")).alias("b"), F.col(value).alias("v")))).alias("_tail"))
    parts = Window.partitionBy("_group").orderBy("_part").rowsBetween(-k, -1)
    before = F.flatten(F.collect_list("_tail").over(parts))
    halo = tails.select("_group", F.col("_part").alias("_at_part"), _last(F.transform(before, lambda x: x["v"]), k).alias("_halo"))
    seen = ranged.withColumns({"_own": F.row_number().over(inside), "_list": F.collect_list(F.struct(F.col(value).alias("v"))).over(inside.rowsBetween(-k, -1))})
    # A broadcast of at most two lists of k values for each partition.
    joined = seen.join(F.broadcast(halo), (F.col("_part") == F.col("_at_part")) & key.eqNullSafe(F.col("_group")), "left")
    listed = F.transform("_list", lambda x: x["v"])
    whole = F.when((F.col("_own") <= k) & F.col("_halo").isNotNull(), _last(F.concat("_halo", listed), k)).otherwise(listed)
    return joined.withColumn(name, F.filter(whole, lambda x: x.isNotNull())).drop("_part", "_at_part", "_group", "_own", "_list", "_halo")


def _last(values: Column, k: int) -> Column:
    return F.slice(values, F.greatest(F.lit(1), F.size(values) - k + 1), k)


def numbered_across(df: DataFrame, by: list[str], order: list[Column], name: str = "number", buckets: int | None = None) -> DataFrame:
    """Rows numbered from 1 in each group, without one task that holds a large group.

    As numbered(), with the rows of the group's earlier range partitions counted; only a group that goes on from one
    partition to the next has any, so there is one at most for each partition. The order must be unique in a group.
    """
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settled(df.repartitionByRange(buckets, *by, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    key = F.struct(*by)
    counts = ranged.groupBy(key.alias("_group"), F.col("_part").alias("_at_part")).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_group").orderBy("_at_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_group", "_at_part", F.sum("_n").over(earlier).alias("_before")).where(F.col("_before") > 0)
    own = F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order))
    joined = ranged.withColumn("_own", own).join(F.broadcast(before), (F.col("_part") == F.col("_at_part")) & key.eqNullSafe(F.col("_group")), "left")
    return joined.withColumn(name, (F.col("_own") + F.coalesce("_before", F.lit(0))).cast("bigint")).drop("_part", "_at_part", "_group", "_own", "_before")


def round_robin(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "turn") -> DataFrame:
    """Rows of each group dealt in turn to 0 .. k - 1."""
    return numbered_across(df, by, order, "_at").withColumn(name, ((F.col("_at") - 1) % k).cast("int")).drop("_at")
