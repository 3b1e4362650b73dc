"""Lists in chunks, templates by row, and tables of which a change rewrites a part."""

from __future__ import annotations

import glob
import os

import pytest
from pyspark.sql import functions as F

from casemill.operators import lists, templates
from casemill.sources.buckets import BucketedTable


def test_chunks_of_a_hot_group(spark):
    rows = [("hot" if i % 2 else f"g{i % 7}" if i % 3 else None, i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, id long")
    got = lists.chunked(df, ["g"], [F.col("id").desc()], [F.col("id")], 30).collect()
    for g in {r[0] for r in rows}:
        want = sorted((i for k, i in rows if k == g), reverse=True)
        own = sorted((x for x in got if x["g"] == g), key=lambda x: x["chunk"])
        assert [x["chunk"] for x in own] == list(range(len(own))) and [i for x in own for i in x["items"]] == want
        assert all(x["n"] == len(x["items"]) == 30 for x in own[:-1])
    assert lists.chunked(df.limit(0), ["g"], [F.col("id")], [F.col("id")]).count() == 0
    with pytest.raises(ValueError, match="size"):
        lists.chunked(df, ["g"], [F.col("id")], [F.col("id")], 0)


def test_a_hot_group_lies_in_many_tasks(spark):
    """Half of all rows are one group: no range partition of the numbering holds more than its share."""
    df = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), F.col("id").cast("string"))).alias("g"), "id")
    ranged = df.repartitionByRange(8, "g", "id").groupBy(F.spark_partition_id().alias("p")).agg(F.count_if(F.col("g") == "hot").alias("n")).where("n > 0").collect()
    assert len(ranged) >= 4 and max(x["n"] for x in ranged) < 1200


def test_grouped_merged_and_children(spark):
    df = spark.createDataFrame([("a", 1, 5), ("", 2, 6), (None, 3, 7), ("a", 4, 8)], "k string, id long, n long")
    assert {(x["k"], x["chunk"]): x["id"] for x in lists.grouped(df, "k", "id", 1).collect()} == {("a", 0): [1], ("a", 1): [4], ("unknown", 0): [2], ("unknown", 1): [3]}
    got = {(x["k"], x["chunk"]): (x["total"], x["ids"], x["examples"]) for x in lists.merged(df, ["k"], "n", "n", "id", 1, 5).collect()}
    assert got == {("a", 0): (13, [1], [1]), ("a", 1): (13, [4], None), ("", 0): (6, [2], [2]), (None, 0): (7, [3], [3])}
    parents = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    tree = {(x["k"], x["chunk"]): [c["id"] for c in x["children"]] for x in lists.children(parents, df, "k", ["id"], 1).collect()}
    assert tree == {("a", 0): [1], ("a", 1): [4], ("b", 0): [], (None, 0): []}


def test_templates_by_row(spark):
    made = [("x", "L1", "One {name}: {a}."), ("x", None, "Any level {name}{a}"), (None, None, "Else {other} {name}"), ("y", "L2", ""), ("z", "L1", None)]
    t = spark.createDataFrame(made, "kind string, level string, template string")
    rows = [(1, "x", "L1", "Ann", "1"), (2, "x", "L9", "Bob", None), (3, "q", None, "C{a}", "$1"), (4, "y", "L2", "D", "\\"), (5, None, "L1", None, "e"), (6, "z", "L1", "F", "f"), (7, "x", None, "G", "g")]
    df = spark.createDataFrame(rows, "id int, kind string, level string, name string, a string")
    fields = {"name": F.col("name"), "a": F.col("a")}
    got = {x["id"]: x["prompt"] for x in templates.rendered(df, t, ["kind", "level"], fields).collect()}
    assert got == {1: "One Ann: 1.", 2: "Any level Bob", 3: "Else {other} C{a}", 4: "", 5: "Else {other} ", 6: "Else {other} F", 7: "Any level Gg"}
    none = templates.rendered(df, t.where("kind = 'y'"), ["kind", "level"], fields)
    assert {x["id"]: x["prompt"] for x in none.collect()} == {**dict.fromkeys(range(1, 8)), 4: ""}
    assert [tuple(x) for x in templates.unknown_fields(t, ["name", "a"]).collect()] == [(None, None, "other")]


def _files(path):
    return {os.path.relpath(x, path): os.stat(x).st_mtime_ns for x in glob.glob(f"{path}/_bucket=*/*.parquet")}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    table = BucketedTable(spark, path, "id", 16)
    table.create(spark.range(400).select("id", (F.col("id") * 2).alias("n"), F.lit("old").alias("s")))
    before = _files(path)
    changes = spark.createDataFrame([(3, None, "new"), (4, 8, "old"), (1000, 1, None)], "id long, n long, s string")
    at = table.upsert(changes)
    after = _files(path)
    assert 1 <= len(at) <= 2  # the second row is there just so
    kept = {f for f in before if int(f.split("=")[1].split("/")[0]) not in at}
    assert kept and all(after.get(f) == before[f] for f in kept) and not ({f for f in before if f not in kept} & set(after))
    got = {x["id"]: (x["n"], x["s"]) for x in table.read().collect()}
    assert len(got) == 401 and got[3] == (6, "new") and got[4] == (8, "old") and got[1000] == (1, None)
    assert table.upsert(changes.where("id = 4")) == [] and _files(path) == after


def test_deleted_rows_and_emptied_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    table = BucketedTable(spark, path, "id", 8)
    table.create(spark.range(20).withColumn("n", F.lit(1)))
    own = table.touched(spark.createDataFrame([(5,)], "id long"))
    gone = [x["id"] for x in table.read(own).collect()]
    assert table.delete(spark.createDataFrame([(i,) for i in [*gone, 999]], "id long")) == own
    assert sorted(x["id"] for x in table.read().collect()) == sorted(set(range(20)) - set(gone)) and table.read(own).count() == 0
    assert table.delete(spark.createDataFrame([(999,)], "id long")) == []
