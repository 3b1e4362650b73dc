"""Exact quantiles by counting: ranges that hold a wanted rank are narrowed, pass by pass, until they hold one value.

No group's values are ever gathered or sorted. A pass counts, for each open range of a group, the rows in each of its
parts; whole numbers over a range of up to PARTS values take one pass after the bounds, other numbers a few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.operators.tables import settled

#: Parts that a range is cut into.
PARTS = 1024
#: Groups whose open ranges, a few for each, may be broadcast.
SMALL = 10_000


def _ranks(n: Column, shares: list[float]) -> Column:
    """The ranks, from 0, whose values a quantile lies between."""
    at = [F.lit(x) * (n - 1) for x in shares]
    return F.array_distinct(F.flatten(F.array(*[F.array(F.floor(x), F.ceil(x)) for x in at])))


def quantiles(df: DataFrame, by: list[str], value: str, shares: list[float], name: str = "q") -> DataFrame:
    """by and an array of the quantiles of each group, interpolated between the two values that they lie between.

    Null values don't count, nor do groups without others; a null key is a group. shares lie between 0 and 1. Tables of
    the passes hold a few rows for each group.
    """
    if not all(0 <= x <= 1 for x in shares):
        raise ValueError("shares lie between 0 and 1")
    group = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(1).alias("_all"))
    rows = df.where(F.col(value).isNotNull()).select(group.alias("g"), F.col(value).cast("double").alias("x"))
    ends = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    wanted = ends.select("g", "low", "high", F.lit(0).cast("long").alias("before"), "n", F.explode(_ranks(F.col("n"), shares)).alias("rank"))
    state = settled(wanted.select("g", "low", "high", "before", "rank"), "quantile-ranges")
    sizes = settled(ends.select("g", "n"), "quantile-sizes")
    few, done = sizes.count() <= SMALL, None
    while True:
        closed, open_ = state.where(F.col("low") == F.col("high")), state.where(F.col("low") < F.col("high"))
        done = closed if done is None else done.unionByName(closed)
        if open_.isEmpty():
            break
        ranges = open_.select("g", "low", "high", "before").distinct()
        # Few ranges are broadcast: a large group would go to one task of a shuffled join.
        ranges = F.broadcast(ranges) if few else ranges
        held = rows.alias("r").join(ranges.alias("s"), F.col("r.g").eqNullSafe(F.col("s.g")) & F.col("r.x").between(F.col("s.low"), F.col("s.high")))
        # Halved before they are taken apart, so that the widest range doesn't overflow.
        part = F.least(F.lit(PARTS - 1), F.floor((F.col("x") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * PARTS))
        counts = held.select("s.g", "low", "high", "before", part.alias("part"), "x").groupBy("g", "low", "high", "before", "part").agg(F.count("*").alias("m"), F.min("x").alias("least"), F.max("x").alias("most"))
        upto = F.expr("sum(m) OVER (PARTITION BY g, low, high ORDER BY part)")
        parts = counts.select("g", "low", "high", (F.col("before") + upto - F.col("m")).alias("first"), (F.col("before") + upto).alias("end"), "least", "most")
        found = open_.alias("o").join(parts.alias("p"), F.col("o.g").eqNullSafe(F.col("p.g")) & (F.col("o.low") == F.col("p.low")) & (F.col("o.high") == F.col("p.high")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
        state = settled(found.select("o.g", F.col("least").alias("low"), F.col("most").alias("high"), F.col("first").alias("before"), "rank"), "quantile-ranges")
    known = done.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", F.col("low").alias("x")))).alias("at"))
    joined = sizes.alias("z").join(known.alias("k"), F.col("z.g").eqNullSafe(F.col("k.g")))

    def between(share: float) -> Column:
        at = F.lit(share) * (F.col("n") - 1)
        low, high = F.element_at("at", F.floor(at)), F.element_at("at", F.ceil(at))
        return low + (high - low) * (at - F.floor(at))

    return joined.select(*[F.col(f"z.g.{c}").alias(c) for c in by], F.array(*[between(x) for x in shares]).alias(name))
