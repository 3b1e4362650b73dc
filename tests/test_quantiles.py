"""Exact quantiles and halo windows against numpy and plain lists."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from casemill.operators import quantiles as Q
from casemill.operators import windows

SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize("parts", [4, 1024])
def test_quantiles_are_exact(spark, monkeypatch, parts):
    monkeypatch.setattr(Q, "PARTS", parts)
    draw = np.random.default_rng(4)
    groups = {
        "whole": draw.integers(0, 50, 400).astype(float), "real": draw.normal(0, 1e6, 300), "same": np.full(90, 3.5), "one": np.array([-2.0]),
        "wide": np.array([-1.7e308, 1e-300, 0.0, 1.7e308, 5.0]), "close": 1 + np.arange(40) * 2.0**-52, None: draw.normal(size=33), "hot": np.concatenate([np.zeros(700), draw.normal(size=5)]),
    }
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("whole", None), ("none", None)]
    got = {x["g"]: x["q"] for x in Q.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", SHARES).collect()}
    assert got.keys() == groups.keys()
    for g, xs in groups.items():
        if g != "wide":
            assert np.allclose(got[g], np.quantile(xs, SHARES), rtol=1e-12, atol=0), g
    assert got["wide"][3] == 1e-300 and got["wide"][-1] == 1.7e308


def test_quantiles_of_all_and_of_nothing(spark):
    df = spark.range(11).select(F.col("id").cast("double").alias("v"), F.lit(1).alias("n"), F.lit(2).alias("low"), F.lit(3).alias("x"))
    assert Q.quantiles(df, [], "v", [0.5, 0.25]).collect()[0]["q"] == [5.0, 2.5]
    assert [tuple(x) for x in Q.quantiles(df, ["n", "low", "x"], "v", [1.0]).collect()] == [(1, 2, 3, [10.0])]
    assert Q.quantiles(df.limit(0), ["n"], "v", [0.5]).collect() == []
    with pytest.raises(ValueError, match="between"):
        Q.quantiles(df, [], "v", [1.5])


@pytest.mark.parametrize(("k", "buckets"), [(1, 6), (3, 6), (20, 9), (3, 40)])
def test_recent_in_a_hot_group(spark, k, buckets):
    """One group of two thirds of all rows lies in most partitions; forty partitions leave some with fewer than k rows of it."""
    rows = [("hot" if i % 3 else f"g{i % 5}" if i % 2 else None, i * 7 % 90, i, None if i % 11 == 0 else f"v{i}") for i in range(90)]
    df = spark.createDataFrame(rows, "g string, t long, id long, v string")
    got = {x["id"]: x["recent"] for x in windows.recent_before(df, ["g"], [F.col("t"), F.col("id")], "v", k, buckets=buckets).collect()}
    plain = df.withColumn("recent", F.collect_list("v").over(Window.partitionBy("g").orderBy("t", "id").rowsBetween(-k, -1)))
    assert got == {x["id"]: x["recent"] for x in plain.collect()}


def test_recent_spreads_a_hot_group(spark):
    df = spark.range(400).select(F.lit("a").alias("g"), "id")
    ranged = df.repartitionByRange(4, "g", "id").select(F.spark_partition_id().alias("p")).distinct()
    assert ranged.count() == 4
    got = windows.recent_before(df, ["g"], [F.col("id").desc()], "id", 2, buckets=4).collect()
    assert all(x["recent"] == [y for y in (x["id"] + 2, x["id"] + 1) if y < 400] for x in got) and len(got) == 400
