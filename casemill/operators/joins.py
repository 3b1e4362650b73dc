"""Joins of facts with evaluations, taxonomies and histories.

Catalyst picks the strategy: small sides are broadcast under the session's threshold, others are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def not_in(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key other lacks: to skip what is evaluated, or to insert without repeats."""
    return df.join(other.select(key).distinct(), key, "left_anti")


def found_in(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key).distinct(), key, "left_semi")


def nested(parents: DataFrame, children: DataFrame, key: str, order: list[str], name: str = "children") -> DataFrame:
    """Each parent with its ordered array of child structs, empty without any; a parent's children form one row."""
    fields = [*order, *[c for c in children.columns if c not in order and c != key]]
    lists = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    kind = lists.schema[name].dataType.simpleString()
    return parents.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def scaffolded(dimension: DataFrame, counts: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Every row of the dimension with its counts, 0 where none were seen."""
    return dimension.join(counts, keys, "left").fillna(0, measures)


def looked_up(df: DataFrame, dimension: DataFrame, keys: list[str], column: str, default: Column | None = None) -> DataFrame:
    """df with a column of a dimension by its keys, or the default."""
    joined = df.join(dimension.select(*keys, column), keys, "left")
    return joined if default is None else joined.withColumn(column, F.coalesce(F.col(column), default))


def by_priority(parents: DataFrame, children: DataFrame, key: str, details: DataFrame, detail_key: str, priority: str) -> DataFrame:
    """Each parent with its children in the order of priority, and each child's detail row; parents without children stay, once."""
    own = children.join(details, detail_key, "left")
    at = F.row_number().over(Window.partitionBy(key).orderBy(F.col(priority).asc_nulls_last(), detail_key))
    return parents.join(own.withColumn("at", at), key, "left")


def unmapped(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Distinct values of key that the dimension lacks."""
    return df.select(key).where(F.col(key).isNotNull()).distinct().join(dimension.select(key), key, "left_anti")


def pairs(df: DataFrame, key: str, columns: list[str], blocks: int = 16) -> DataFrame:
    """All pairs of different keys once, the smaller as a: for matrices that are wanted whole.

    Rows are dealt into blocks, and each pair of blocks is joined by its own key, so that the quadratic work is
    spread evenly over blocks * (blocks + 1) / 2 groups.
    """
    block = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    rows = df.select(key, *columns, block.alias("_own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_other"))
    tile = rows.withColumn("_tile", F.least("_own", "_other") * blocks + F.greatest("_own", "_other"))
    left = tile.select("_tile", F.col("_own").alias("_own_a"), *[F.col(c).alias(f"{c}_a") for c in (key, *columns)])
    right = tile.select("_tile", F.col("_own").alias("_own_b"), *[F.col(c).alias(f"{c}_b") for c in (key, *columns)])
    # A tile of two blocks holds only pairs of one row from each.
    own = F.least("_own_a", "_own_b") * blocks + F.greatest("_own_a", "_own_b") == F.col("_tile")
    return left.join(right, "_tile").where(own & (F.col(f"{key}_a") < F.col(f"{key}_b"))).drop("_tile", "_own_a", "_own_b")
