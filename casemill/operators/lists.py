"""Long lists in numbered chunks: the values of a group in order, none of whose rows holds more than a chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.operators.windows import numbered_across

#: Values of a chunk.
CHUNK = 1000


def chunked(df: DataFrame, by: list[str], order: list[Column], values: list[Column], size: int = CHUNK, name: str = "items") -> DataFrame:
    """by, chunk (from 0), n (values in the chunk), and the values in order, at most size of them, as structs or plain values.

    Rows are numbered over range partitions, so that a group of half the table lies in as many tasks as its rows need. The
    order is unique in a group. Null keys are a group; an empty table gives no rows.
    """
    if size < 1:
        raise ValueError("size is 1 or more")
    at = numbered_across(df, by, order, "_at")
    value = F.struct(*values) if len(values) > 1 else values[0].alias("v")
    listed = F.sort_array(F.collect_list(F.struct("_at", value.alias("v"))))
    chunk = F.floor((F.col("_at") - 1) / size).cast("long").alias("chunk")
    found = at.groupBy(*by, chunk).agg(F.count("*").alias("n"), listed.alias("_all"))
    return found.select(*by, "chunk", "n", F.transform("_all", lambda x: x["v"]).alias(name))


def grouped(df: DataFrame, key: str, ids: str, size: int = CHUNK, unknown: str = "unknown") -> DataFrame:
    """The ids of each key in order, in chunks; rows whose key is null or empty are those of unknown. Ids are unique."""
    named = df.select(F.coalesce(F.nullif(F.col(key), F.lit("")), F.lit(unknown)).alias(key), ids)
    return chunked(named, [key], [F.col(ids)], [F.col(ids)], size, ids)


def merged(df: DataFrame, keys: list[str], n: str, order: str, id_: str, size: int = CHUNK, most_examples: int = 5) -> DataFrame:
    """Patterns of equal keys as one: keys, chunk, total (n summed over the whole pattern), ids in order, and the first examples.

    Totals are summed by themselves and joined; examples stand with a pattern's first chunk only.
    """
    totals = df.groupBy(*keys).agg(F.sum(n).alias("total"))
    lists = chunked(df, keys, [F.col(order), F.col(id_)], [F.col(id_)], size, "ids")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    joined = lists.alias("l").join(totals.alias("t"), same)
    examples = F.when(F.col("l.chunk") == 0, F.slice("l.ids", 1, most_examples))
    return joined.select(*[f"l.{k}" for k in keys], "l.chunk", "t.total", "l.ids", examples.alias("examples"))


def children(parents: DataFrame, rows: DataFrame, key: str, order: list[str], size: int = CHUNK, name: str = "children") -> DataFrame:
    """Each parent with its children's chunks: one row for each chunk, and one of chunk 0 without children for a parent that has none."""
    fields = [*order, *[c for c in rows.columns if c not in order and c != key]]
    lists = chunked(rows.where(F.col(key).isNotNull()), [key], [F.col(c) for c in order], [F.col(c) for c in fields], size, name)
    joined = parents.join(lists, key, "left")
    kind = lists.schema[name].dataType.simpleString()
    return joined.withColumns({"chunk": F.coalesce("chunk", F.lit(0)), "n": F.coalesce("n", F.lit(0)), name: F.coalesce(name, F.array().cast(kind))})
