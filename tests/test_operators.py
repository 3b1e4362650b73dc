"""Operators on small frames."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from casemill.functions import vocab
from casemill.operators import aggregates, external, filters, generation, joins, mutations, sampling, validation, windows
from casemill.plans.curation import questions
from casemill.sources import readers, sinks


def findings(spark, **changes):
    row = {
        "id": "T3-BucketLarge-G-1.1", "case_id": "1.1", "bucket": "BucketLarge-G", "pearl_level": "L1", "domain": "Markets", "subdomain": None, "scenario": "s" * 60,
        "claim": "c", "label": "YES", "is_ambiguous": False, "variables": {"X": {"name": "x", "role": "r"}, "Y": {"name": "y", "role": "r"}, "Z": [], "X'": None},
        "trap": {"type": "W7", "type_name": None, "subtype": None, "subtype_name": None}, "difficulty": "Easy", "causal_structure": None, "key_insight": None,
        "hidden_timestamp": None, "conditional_answers": None, "wise_refusal": "w", "gold_rationale": None, "initial_author": "a", "validator": "v", "final_score": 9.0,
    } | changes
    df = spark.read.schema(vocab.CASE_SCHEMA).json(spark.sparkContext.parallelize([json.dumps(row)]))
    return {(x["rule"], x["severity"]) for x in validation.broken_rules(df, validation.case_rules(df.columns), "id").collect()}


@pytest.mark.parametrize(
    ("changes", "expected"),
    [
        ({}, set()),
        ({"validator": None}, {("required", "error")}),
        ({"pearl_level": "L9"}, {("level", "error")}),
        ({"label": "VALID"}, {("label_L1", "error")}),
        ({"pearl_level": "L2", "trap": {"type": "T1"}}, {("label_L2", "error")}),
        ({"pearl_level": "L3", "trap": {"type": "F1"}}, {("label_L3", "error")}),
        ({"difficulty": "easy"}, {("difficulty", "warning")}),
        ({"is_ambiguous": True}, {("ambiguous", "error"), ("hidden_timestamp", "error"), ("conditional_answers", "error")}),
        ({"label": "AMBIGUOUS", "is_ambiguous": True, "hidden_timestamp": "N/A", "conditional_answers": {"answer_if_condition_1": "a"}}, {("hidden_timestamp", "error")}),
        ({"variables": {"X": None, "Y": {"name": "y"}, "Z": None}}, {("variable_X", "error"), ("variable_Z", "error")}),
        ({"trap": {"type": "T1"}}, {("trap_L1", "warning")}),
        ({"scenario": "s" * 49}, {("scenario_length", "warning")}),
        ({"scenario": "s" * 50}, set()),
        ({"final_score": 10.5}, {("score_range", "error")}),
        ({"final_score": 5.9}, {("score_low", "warning")}),
        ({"final_score": 0.0}, {("score_low", "warning")}),
        ({"id": "G-1"}, {("id_format", "warning")}),
        ({"wise_refusal": ""}, {("wise_refusal", "warning")}),
    ],
)
def test_rules(spark, changes, expected):
    assert findings(spark, **changes) == expected


def test_dataset_rules(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "id string")
    assert {(x["id"], x["rule"]) for x in validation.dataset_rules(df, "id").collect()} == {(None, "few_cases"), ("a", "duplicate_id")}


def test_rubric(spark):
    parts = {name: F.lit(9.0) for name, _, _ in vocab.RUBRIC}
    score = lambda amb, p: spark.range(1).select(validation.rubric_score(F.lit(amb), p).alias("x")).first()["x"]
    assert score(False, parts) == 10.0
    assert score(True, dict.fromkeys(parts, F.lit(-1.0))) == 0.0
    assert score(False, dict.fromkeys(parts, F.lit(None))) == 4.0


def test_word_rules(spark):
    df = spark.createDataFrame([("alpha beta gamma", "beta only", "It cannot be", "YES")], "a string, b string, e string, l string")
    row = df.select(validation.unmatched_terms(F.col("a"), F.col("b")), validation.contradicts(F.col("e"), F.col("l")), validation.overlapping(F.col("a"), F.col("a")), validation.repeated_values(F.array(F.lit("A-b"), F.lit("ab")))).first()
    assert tuple(row) == (2, True, True, True)


def test_semi_and_anti_make_all(spark):
    left, right = spark.range(10).withColumnRenamed("id", "k"), spark.range(5, 20).withColumnRenamed("id", "k")
    assert joins.not_in(left, right, "k").count() + joins.found_in(left, right, "k").count() == 10


def test_pairs(spark):
    assert joins.pairs(spark.range(40).withColumnRenamed("id", "k"), "k", [], blocks=5).distinct().count() == 780
    assert joins.pairs(spark.range(40).withColumnRenamed("id", "k"), "k", [], blocks=5).count() == 780


def test_nested(spark):
    parents = spark.createDataFrame([(1,), (2,)], "k int")
    children = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "k int, n int, v string")
    assert {x["k"]: [c["v"] for c in x["children"]] for x in joins.nested(parents, children, "k", ["n"]).collect()} == {1: ["a", "b"], 2: []}


def test_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), (None, 4.0)], "k string, v double")
    assert {x["k"]: x["n"] for x in aggregates.top_and_other(df, "k", 1).collect()} == {"a": 2, "OTHER": 1, None: 1}
    assert aggregates.panel(df, big=F.col("v") > 2).first().asDict() == {"total": 4, "big": 2}
    assert sorted(x["n"] for x in aggregates.histogram(df, "v", 2).collect()) == [2, 2]
    assert [x["agrees"] for x in aggregates.totals_agree(df, ["k"]).collect()] == [True]
    empty = df.limit(0)
    assert aggregates.histogram(empty, "v").collect() == [] and aggregates.panel(empty).first()["total"] == 0
    ids = spark.createDataFrame([("G.9",), ("G.10",), ("none",)], "id string")
    assert aggregates.next_number(ids, "id").first()["next"] == 11
    bands = spark.createDataFrame([(x,) for x in (10.0, 9.5, 8.0, 6.0, 5.9, None)], "s double").select(aggregates.score_band(F.col("s"))).collect()
    assert [x[0] for x in bands] == ["10", "9-10", "8-9", "6-8", "<6", None]


def test_tag_counts_ignore_bad_json(spark):
    df = spark.createDataFrame([('["x","y"]',), ("{bad",), (None,)], "t string")
    assert {x["tag"]: x["n"] for x in aggregates.tag_counts(df, "t").collect()} == {"x": 1, "y": 1}


def test_filters(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "n int, s string")
    assert filters.where_equal(df, n=[1, 2], s="all").count() == 2
    assert df.where(filters.missing("s")).count() == 2
    assert filters.page(df, [F.col("n")], limit=900, offset=1).count() == 2
    with pytest.raises(ValueError, match="0 or more"):
        filters.page(df, [F.col("n")], offset=-1)
    assert filters.where_any(df, ["a"], "s").count() == 1
    assert filters.where_score(spark.range(12), "medium", "id").count() == 2


def test_windows(spark):
    df = spark.range(100)
    assert [x["number"] for x in windows.numbered(df, [F.col("id").desc()], buckets=7).orderBy(F.col("id").desc()).collect()] == list(range(1, 101))
    assert windows.first_of_each(df.withColumn("g", F.col("id") % 3), ["g"], [F.col("id")], 2).count() == 6
    assert windows.repeated(df.withColumn("g", F.col("id") % 99), ["g"]).count() == 1


def test_generation(spark):
    m = spark.createDataFrame([("a", 2), ("b", 0), ("c", -1), ("d", None)], "k string, n long")
    assert [x["copy"] for x in generation.expanded(m, "n").orderBy("copy").collect()] == [1, 2]
    mix = generation.mixed(spark, 10, {"x": 30, "y": 30, "z": 40}).groupBy("class").count().collect()
    assert {x["class"]: x["count"] for x in mix} == {"x": 3, "y": 3, "z": 4}
    with pytest.raises(ValueError, match="between"):
        generation.check_size(201, 200)
    seeds = spark.createDataFrame([(1, ["Acme"], "E" * 60), (2, ["New"], "other")], "id int, entities array<string>, event string")
    old = spark.createDataFrame([(0, ["ACME"], "e" * 55)], "id int, entities array<string>, event string")
    assert {(x["id"], x["issue"]) for x in generation.diversity_issues(seeds, old).collect()} == {(1, "Duplicate entity: Acme"), (1, "Similar event already used")}


def test_mutations(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert sorted(map(tuple, mutations.upserted(df, new, "k").collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert mutations.delete_where(df, F.lit(None).cast("boolean")).count() == 2
    assert sorted(map(tuple, mutations.update_where(df, F.col("k") == 1, v=F.lit("z")).collect())) == [(1, "z"), (2, "b")]
    assert mutations.inserted(df, new, "k").count() == 3
    assert sorted(map(tuple, mutations.patched(df, spark.createDataFrame([(1, "p", 9)], "k int, v string, other int"), "k", ["v"]).collect())) == [(1, "p"), (2, "b")]


def test_sampling(spark):
    draws = sampling.hierarchical(spark, 3000, {"L1": (1, 1), "L2": (3, 0), "L3": (1, 0)}, seed=4)
    by = {x["level"]: x["count"] for x in draws.groupBy("level").count().collect()}
    assert set(by) == {"L2", "L3"} and abs(by["L2"] / 3000 - 0.75) < 0.03
    assert draws.where((F.col("level") == "L2") & (F.col("answer") != "NO")).count() == 0
    assert draws.where(F.col("type").isNull()).count() == 0
    assert draws.where((F.col("type") == "F6") & (F.col("answer") != "CONDITIONAL")).count() == 0
    assert draws.where(F.col("ambiguity").isNotNull() != (F.col("answer") == "CONDITIONAL")).count() == 0
    forced = sampling.hierarchical(spark, 10, {"L1": (0, 0)}, 1, level="L1", answer="YES", difficulty="Hard")
    assert {x["type"][0] for x in forced.collect()} == {"S"}
    assert sampling.weighted_sample(spark.range(50), "id", F.col("id").cast("double"), 10, 1).distinct().count() == 10


def test_external(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "bad")], "k int, s string")

    def scorer(row):
        if row["s"] == "bad":
            raise RuntimeError("service is down")
        return dict.fromkeys(external.CAUTIOUS_SCORES, 1.0)

    got = {x["k"]: x["wiseRefusalScore"] for x in external.score_rubric(df, scorer).collect()}
    assert got == {1: 1.0, 2: 1.0}
    assert {x["s"] for x in external.rewritten(df, "s", str.upper).collect()} == {"OK", "BAD"}
    flags = spark.createDataFrame([("APPROVE", 0.9), ("APPROVE", 0.8), ("REJECT", 0.99), (None, None)], "d string, c double")
    assert [x[0] for x in flags.select(external.auto_verified(F.col("d"), F.col("c"))).collect()] == [True, False, False, False]


def test_readers(spark, tmp_path):
    (tmp_path / "ann.json").write_text(json.dumps([{"id": "1"}, {"id": "2"}]))
    (tmp_path / "combined.json").write_text(json.dumps({"questions": [{"id": "3"}]}))
    assert sorted(x["id"] for x in readers.json_cases(spark, [str(tmp_path / "ann.json"), str(tmp_path / "combined.json")], "id string").collect()) == ["1", "2", "3"]
    rows = readers.json_folder(spark, str(tmp_path), "id string")
    assert {(x["id"], x["a"]) for x in rows.select("id", readers.author_of(F.col("source_file"), {"ann": "Ann"}).alias("a")).collect()} == {("1", "Ann"), ("2", "Ann")}
    line = json.dumps({"custom_id": "c", "response": {"body": {"choices": [{"message": {"content": 'Here: {"wiseRefusalScore": 2, "notes": "n"}'}}]}}})
    (tmp_path / "out.jsonl").write_text(line + "\nnot json\n" + json.dumps({"custom_id": "d", "error": {"message": "x"}}))
    got = {x["custom_id"]: (x["failed"], x["wiseRefusalScore"]) for x in readers.batch_responses(spark, str(tmp_path / "out.jsonl")).collect()}
    assert got == {"c": (False, 2.0), "d": (True, None)}
    answers = spark.createDataFrame([('x [{"id": "s1", "entities": ["A"]}]',), ("none",)], "answer string")
    assert [(x["id"], x["difficulty"]) for x in readers.ideas(answers).collect()] == [("s1", "medium")]


def test_sinks(spark, small, tmp_path):
    q = questions(spark, small)
    cases = sinks.export_cases(q, vocab.traps(spark), vocab.legacy_traps(spark))
    sinks.write_json(cases, str(tmp_path / "cases"))
    again = spark.read.schema(vocab.CASE_SCHEMA).json(str(tmp_path / "cases"))
    assert again.count() == q.count() and again.where(F.col("variables.X.role") != "exposure").count() == 0
    hidden = sinks.export_annotated(q, for_eval=True).first().asDict(recursive=True)
    assert "groundTruth" not in hidden and "trapType" not in hidden["annotations"]
    request = json.loads(sinks.request_lines(q.limit(1), "id", F.col("scenario"), "m", temperature=0.1).first()["value"])
    assert request["body"]["messages"][0]["role"] == "user"
    assert "final_score" in json.loads(sinks.case_schema_document())["required"]
    small_table = spark.createDataFrame([("a_b", 1)], "k string, n int")
    assert sinks.markdown_table(small_table).endswith("| a_b | 1 |")
    assert "a\\_b" in sinks.latex_table(small_table)
    with pytest.raises(ValueError, match="at most"):
        sinks.markdown_table(spark.range(300))
    assert sinks.report("R", {"S": small_table}).startswith("# R")


def test_stream(spark, tmp_path):
    from casemill.streaming import responses

    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.json").write_text(json.dumps({"custom_id": str(i), "response": {"body": {"choices": [{"message": {"content": '{"finalLabelScore": 1}'}}]}}}))
    for _ in range(2):  # the second run finds nothing new
        responses.collect_available(responses.arriving(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_a_large_group_is_numbered_in_several_tasks(spark):
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "false")
    try:
        df = spark.range(1000).select(F.when(F.col("id") < 900, "hot").when(F.col("id") < 990, "b").alias("g"), (-F.col("id")).alias("o"))
        rows = windows.round_robin(df, ["g"], [F.col("o")], 3).withColumn("task", F.spark_partition_id()).collect()
        for g in ("hot", "b", None):
            own = sorted((x for x in rows if x["g"] == g), key=lambda x: x["o"])
            assert [x["turn"] for x in own] == [i % 3 for i in range(len(own))] and len(own) in (900, 90, 10)
        assert len({x["task"] for x in rows if x["g"] == "hot"}) > 1
        pairs = generation.assigned(spark.range(500), [F.col("id").desc()], spark.range(400).select(F.col("id").alias("slot")), [F.col("slot")]).withColumn("task", F.spark_partition_id()).collect()
        assert sorted((x["slot"], x["id"]) for x in pairs) == [(i, 499 - i) for i in range(400)]
        plan = generation.assigned(spark.range(500), [F.col("id")], spark.range(400).select(F.col("id").alias("slot")), [F.col("slot")])._jdf.queryExecution().toString()
        assert "_all" not in plan
    finally:
        spark.conf.set(conf, before)
