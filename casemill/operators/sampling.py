"""Samplers whose draws are hashes of a key and a seed: repeatable, and independent of partitioning."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casemill.functions import vocab
from casemill.functions.cases import uniform


def drawn(u: Column, shares: list[tuple[str, float]]) -> Column:
    """The value whose part of [0, 1) holds u; shares are parts of their sum."""
    total, out = sum(s for _, s in shares), F.lit(shares[-1][0])
    for (value, _), end in reversed(list(zip(shares, accumulate(s for _, s in shares), strict=True))[:-1]):
        out = F.when(u < end / total, value).otherwise(out)
    return out


def picked(u: Column, values: list[str]) -> Column:
    """One of the values, each as likely."""
    return F.element_at(F.array(*[F.lit(x) for x in values]), (F.floor(u * len(values)) + 1).cast("int"))


def weighted_sample(df: DataFrame, key: str, weight: Column, n: int, seed: int) -> DataFrame:
    """n rows without repeats, likelier by weight: an exponential race."""
    return df.where(weight > 0).orderBy(-F.log(F.greatest(uniform(key, seed), F.lit(1e-12))) / weight, key).limit(n)


def least_used(df: DataFrame, column: str, values: DataFrame, seed: int, k: int = 3) -> DataFrame:
    """One of the k least used values, weighted k to 1 from the least used on."""
    counts = values.join(df.groupBy(column).agg(F.count("*").alias("n")), column, "left").fillna(0, ["n"])
    low = counts.orderBy("n", column).limit(k)
    rank = F.array_position(F.transform(F.sort_array(F.collect_list(F.struct("n", column)).over(Window.partitionBy(F.lit(1)))), lambda x: x[column]), F.col(column))
    return weighted_sample(low.withColumn("weight", (F.lit(k + 1) - rank).cast("double")), column, F.col("weight"), 1, seed).select(column, "n")


def level_shares(needs: dict[str, tuple[int, int]]) -> list[tuple[str, float]]:
    """Open needs (needed, current) by level; all alike when none is open."""
    open_ = [(level, float(max(0, needed - current))) for level, (needed, current) in needs.items()]
    return open_ if sum(x for _, x in open_) else [(level, 1.0) for level in needs]


# Shares of answers by level and of difficulties.
ANSWER_SHARES = {"L1": [("YES", 0.5), ("NO", 0.4), ("AMBIGUOUS", 0.1)], "L2": [("NO", 1.0)], "L3": [("VALID", 0.35), ("INVALID", 0.25), ("CONDITIONAL", 0.4)]}
DIFFICULTY_SHARES = [("Easy", 0.25), ("Medium", 0.5), ("Hard", 0.25)]


def hierarchical(spark: SparkSession, n: int, needs: dict[str, tuple[int, int]], seed: int, level: str | None = None, answer: str | None = None, difficulty: str | None = None) -> DataFrame:
    """n draws (draw from 0), as drawn_for()."""
    return drawn_for(spark.range(n).withColumnRenamed("id", "draw"), "draw", needs, seed, level, answer, difficulty)


def drawn_for(rows: DataFrame, key: str, needs: dict[str, tuple[int, int]], seed: int, level: str | None = None, answer: str | None = None, difficulty: str | None = None) -> DataFrame:
    """rows with a draw each: level by need, answer by level, difficulty, then a trap type, family and ambiguity that suit them.

    What a row draws hangs on its key and the seed alone; needs (needed, current) are three pairs of counts.
    """
    u = lambda i: uniform(key, seed * 10 + i)
    rows = rows.withColumn("level", F.lit(level) if level else drawn(u(0), level_shares(needs)))
    by_level = F.coalesce(*[F.when(F.col("level") == k, drawn(u(1), v)) for k, v in ANSWER_SHARES.items()])
    rows = rows.withColumn("answer", F.lit(answer) if answer else by_level)
    rows = rows.withColumn("difficulty", F.lit(difficulty) if difficulty else drawn(u(2), DIFFICULTY_SHARES))
    at = lambda lv, an: (F.col("level") == lv) & (F.col("answer") == an)
    wolves, sheep = [c for c in vocab.L1_TRAPS if c[0] == "W"], [c for c in vocab.L1_TRAPS if c[0] == "S"]
    kind = F.when(at("L1", "NO"), picked(u(3), wolves)).when(at("L1", "YES"), picked(u(3), sheep)).when(at("L2", "NO"), picked(u(3), list(vocab.L2_TRAPS)))
    for a in vocab.LABELS["L3"]:
        kind = kind.when(at("L3", a), picked(u(3), [f for f, own in vocab.L3_ANSWERS.items() if a in own]))
    unsure = F.when(F.col("answer").isin("AMBIGUOUS", "CONDITIONAL"), picked(u(4), vocab.AMBIGUITIES))
    return rows.withColumn("type", kind).withColumn("ambiguity", unsure)
