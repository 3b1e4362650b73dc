"""Readers, exports, updates and similarity tiles on small inputs."""

from __future__ import annotations

import json
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from casemill.functions import cases, vocab
from casemill.operators import aggregates, external, filters, mutations, similarity
from casemill.plans.catalog import QUERIES
from casemill.sources import readers, sinks
from casemill.streaming import responses


def write(path, value):
    path.write_text(json.dumps(value))


def test_folder_of_wrapped_files(spark, tmp_path):
    write(tmp_path / "ann.json", {"questions": [{"id": "1", "author": "a@x.org"}, {"id": "2", "author": None}]})
    write(tmp_path / "bob_2.json", [{"id": "3", "author": "b@x.org"}])
    write(tmp_path / "Combined-all.json", {"questions": [{"id": "1", "author": "a@x.org"}]})
    rows = readers.json_folder(spark, str(tmp_path), "id string, author string")
    assert {(x["id"], x["source_file"]) for x in rows.collect()} == {("1", "ann.json"), ("2", "ann.json"), ("3", "bob_2.json")}
    names = rows.select("id", readers.named_author(F.col("author"), {"a@x.org": "Ann"}).alias("name"))
    assert {x["id"]: x["name"] for x in names.collect()} == {"1": "Ann", "2": "Unknown", "3": "b@x.org"}


def test_combined_file_alone(spark, tmp_path):
    write(tmp_path / "combined.json", {"questions": [{"id": "1"}, {"id": "2"}]})
    rows = readers.json_folder(spark, str(tmp_path), "id string")
    assert {(x["id"], x["source_file"]) for x in rows.collect()} == {("1", "combined.json"), ("2", "combined.json")}


def test_jdbc_in_ranges(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/store;create=true"
    df = spark.range(1, 101).select(F.col("id").alias("N"), (F.col("id") * 2).alias("M"))
    df.write.mode("overwrite").jdbc(url, "NUMBERS")
    df.limit(0).write.mode("overwrite").jdbc(url, "NOTHING")
    parts = readers.jdbc_table(spark, url, "NUMBERS", key="N", rows_per_read=30)
    assert parts.rdd.getNumPartitions() == 4 and sorted(x["N"] for x in parts.collect()) == list(range(1, 101))
    assert readers.jdbc_table(spark, url, "NUMBERS").count() == 100 and readers.jdbc_table(spark, url, "NOTHING", key="N").count() == 0


def test_seeds_go_in_or_over(spark, tmp_path):
    write(tmp_path / "seeds.json", [{"sourceCase": "1", "claim": "new", "variables": {"X": "a", "Y": "b", "Z": ["c"]}}, {"sourceCase": "9", "claim": "ninth"}])
    held = spark.createDataFrame([("1", "old", "{}", "kept"), ("2", "two", None, None)], "sourceCase string, claim string, variables string, domain string")
    got = {x["sourceCase"]: x for x in readers.with_seeds(held, readers.seed_cases(spark, str(tmp_path / "seeds.json"))).collect()}
    assert sorted(got) == ["1", "2", "9"] and got["1"]["claim"] == "new" and got["1"]["domain"] == "kept" and got["2"]["claim"] == "two"
    assert json.loads(got["1"]["variables"]) == {"X": "a", "Y": "b", "Z": ["c"]}


@pytest.mark.parametrize(
    ("level", "raw", "code", "name"),
    [
        ("L1", "NONE", "NONE", "NONE"), ("L3", "none", "none", "none"), ("L1", "Selection Bias", "W1", "Selection Bias"), ("L2", "conf-med", "T9", "Conf-Med"), ("L2", "T8:SIMPSON'S", "T8", "Simpson's"),
        ("L1", "W99:My Own: Name", "W99", "My Own: Name"), ("L2", "MORAL", "MORAL", "MORAL"), ("L3", "MORAL", "F8", "Moral/Legal"), ("L9", "T1:x", "T1", "x"), ("L1", "", None, None), ("L1", None, None, None),
    ],
)
def test_exported_trap(spark, level, raw, code, name):
    q = spark.createDataFrame([(level, raw)], "pearlLevel string, trapType string")
    row = sinks.with_trap(q, vocab.traps(spark), vocab.legacy_traps(spark)).first()
    assert (row["trap_code"], row["trap_name"]) == (code, name)


@pytest.mark.parametrize(("level", "raw", "code"), [("L1", "NONE", "S1"), ("L1", None, "S1"), ("L2", "NONE", "S1"), ("L2", "odd", "T7"), ("L2", "collider", "T3"), ("L1", "collider", "W7"), ("L3", "odd one", "ODD_ONE"), ("L1", "T4", "T4")])
def test_imported_trap(spark, level, raw, code):
    df = spark.createDataFrame([(raw, level)], "t string, l string")
    assert df.select(cases.imported_trap("t", "l").alias("x")).first()["x"] == code


@pytest.mark.parametrize(("raw", "name"), [("macro-finance", "Macro-Finance"), ("o'neil  & sons", "O'Neil & Sons"), (" R&D ", "R&D"), ("", "UNKNOWN"), (None, "UNKNOWN"), ("énergie solaire", "Énergie Solaire")])
def test_subdomain(spark, raw, name):
    assert spark.createDataFrame([(raw,)], "s string").select(cases.subdomain("s").alias("x")).first()["x"] == name


def test_schema_document():
    doc = json.loads(sinks.case_schema_document())
    p = doc["properties"]
    assert doc["$schema"].endswith("draft-07/schema#") and doc["required"] == vocab.REQUIRED_FIELDS and set(doc["required"]) <= set(p)
    assert p["pearl_level"]["enum"] == ["L1", "L2", "L3"] and p["final_score"] == {"type": ["number", "null"], "minimum": 0, "maximum": 10}
    assert p["variables"]["properties"]["Z"] == {"type": "array", "items": {"type": "string"}} and p["is_ambiguous"]["type"] == "boolean" and p["subdomain"]["type"] == ["string", "null"]


@pytest.mark.parametrize("n", [0, 1, 50])
def test_json_array_of_files(spark, tmp_path, n):
    df = spark.range(n).select("id", F.concat(F.lit('q"'), F.col("id").cast("string")).alias("text"))
    sinks.write_json_array(df, str(tmp_path / "out"), [F.col("id").desc()])
    whole = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert json.loads(whole) == [{"id": i, "text": f'q"{i}'} for i in reversed(range(n))]


def test_tables_and_results(spark, tmp_path):
    df = spark.createDataFrame([("a", 10), ("long name", None)], "k string, n int")
    assert sinks.text_table(df).split("\n") == ["k          n", "a          10", "long name"]
    with pytest.raises(ValueError, match="at most"):
        sinks.text_table(spark.range(300))
    assert sinks.score_header().count(",") == 13
    sinks.write_results(df, {"status": "done"}, str(tmp_path / "run"))
    assert spark.read.json(str(tmp_path / "run/results")).count() == 2
    assert json.loads(spark.read.text(str(tmp_path / "run/state")).first()["value"]) == {"status": "done"}


def test_backfilled_calls_for_missing_texts_only(spark):
    df = spark.createDataFrame([(1, "has"), (2, ""), (3, None), (4, None)], "k int, s string")

    def writer(row):
        assert not row["s"]
        if row["k"] == 4:
            raise RuntimeError
        return f"made {row['k']}"

    assert {x["k"]: x["s"] for x in external.backfilled(df, "s", writer).collect()} == {1: "has", 2: "made 2", 3: "made 3", 4: None}


def test_evaluated_falls_back(spark):
    rows = external.evaluated(spark.range(2), lambda row: {"clarityScore": 5, "reportTags": ["x"]} if row["id"] else 1 / 0).orderBy("id").collect()
    assert rows[0]["overallVerdict"] == rows[1]["overallVerdict"] == "NEEDS_REVIEW" and rows[0]["clarityScore"] is None and rows[1]["reportTags"] == ["x"]


def test_backfilled_ambiguity(spark):
    rows = [(1, "AMBIGUOUS", True, None, None, "", "A -> B"), (2, "YES", False, None, "when?", None, "C"), (3, None, None, "me", None, "[]", None)]
    df = spark.createDataFrame(rows, "k int, groundTruth string, isLLMGenerated boolean, author string, hiddenTimestamp string, conditionalAnswers string, causalStructure string")
    got = {x["k"]: tuple(x)[3:] for x in mutations.backfilled_ambiguity(df).collect()}
    assert got == {1: ("LLM", "TBD", "TBD", None), 2: (None, "when?", "N/A", "C"), 3: ("me", "N/A", "[]", None)}


def test_lists(spark):
    df = spark.createDataFrame([(1, ["b", "a"]), (2, ["c", "a", None]), (1, None)], "k int, items array<string>").withColumn("source", F.lit(1))
    assert [x["item"] for x in aggregates.union_in_order(df, "source", ["k"], "items").orderBy("at").collect()] == ["b", "a", "c"]
    assert filters.sorted_page(spark.range(5).withColumn("createdAt", F.col("id")), "no such sort", "id", 1).first()["id"] == 4


@pytest.mark.parametrize("n", [0, 1, 2, 40])
def test_similarity_tiles(spark, monkeypatch, n):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 7)
    v = np.random.Generator(np.random.PCG64(1)).normal(size=(n, 5))
    df = spark.createDataFrame([*((i, x.tolist()) for i, x in enumerate(v)), (None, [1.0] * 5), (99, None)], "k long, v array<double>")
    s = {(i, j): float(v[i] @ v[j]) for i in range(n) for j in range(i + 1, n)}
    row = similarity.summary(df, "k", "v", 0.5).first()
    assert row["pairs"] == len(s) and row["near"] == sum(x > 0.5 for x in s.values())
    found = {(x["a"], x["b"]): x["similarity"] for x in similarity.pairs_above(df, "k", "v", 0.5).collect()}
    assert found == pytest.approx({k: x for k, x in s.items() if x > 0.5})
    assert sum(x["n"] for x in similarity.histogram(df, "k", "v", 6).collect()) == len(s)
    if s:
        assert row["mean"] == pytest.approx(np.mean(list(s.values()))) and row["deviation"] == pytest.approx(np.std(list(s.values())), abs=1e-9) and row["greatest"] == pytest.approx(max(s.values()))


def test_tiles_send_few_copies():
    """A row was sent to a tile for every 1,000 rows: 600 times of 600,000."""
    assert [similarity.blocks_of(n) for n in (0, 1, 2500, 100_000, 600_000)] == [1, 1, 3, 16, 37]


def test_bins_by_their_edges():
    """Counting by the edges of bins is the same as rounding and binning each product, on the edges too."""
    low, high, bins = -0.3, 0.7, 7
    edges = similarity._edges(low, high, bins, 9)
    s = np.concatenate([np.random.default_rng(1).uniform(low, high, 5000), edges, np.nextafter(edges, -1), np.nextafter(edges, 1), [low, high]])
    want = np.minimum(bins - 1, np.floor((np.round(s, 9) - low) * bins / (high - low)))
    assert (sum((s >= x).astype(int) for x in edges) == want).all()
    assert similarity._edges(0.5, 0.5, 3, 9) == [np.inf] * 2


def test_progress_by_window(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "0.json", {"custom_id": "0", "error": {"message": "x"}})
    write(folder / "1.json", {"custom_id": "1", "response": {"body": {"choices": [{"message": {"content": '{"finalLabelScore": 1}'}}]}}})
    counts = responses.progress_by_window(responses.arriving(spark, str(folder)))
    counts.writeStream.format("memory").queryName("progress").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.table("progress").collect()
    assert sum(x["n"] for x in rows) == 2 and sum(x["failed"] for x in rows) == 1


def test_evaluation_report(spark):
    rows = [
        ("APPROVED", "L1", "YES", "W1", False, False, False, False, False, False, 5, '["clear"]', 3, "1.1", "s" * 200, None),
        ("REJECTED", "L1", "YES", "W1", True, None, False, True, False, False, 2, '["vague","clear"]', 1, "1.2", "wet streets", "say when"),
        ("NEEDS_REVIEW", "L2", "NO", None, False, False, False, False, False, True, None, "not json", 2, "1.3", None, None),
    ]
    names = "overallVerdict string, pearlLevel string, groundTruth string, trapType string, pearlLevelMismatch boolean, trapTypeMismatch boolean, groundTruthMismatch boolean, hasAmbiguity boolean, hasLogicalIssues boolean, hasDomainErrors boolean, clarityScore int, reportTags string, priorityLevel int, sourceCase string, scenario string, suggestedCorrections string"
    text = sinks.evaluation_report(spark.createDataFrame(rows, names))
    for part in ("3 cases evaluated.", "| APPROVED | 1 (33.3 %) |", "| W1 | 2 (66.7 %) |", "| hasAmbiguity | 1 (33.3 %) |", "Mean clarity: 3.50", "- clear: 2", "1 urgent.", "- 1.2: wet streets... say when", "1 for the usual review.", "- L1-YES: 2 (under 30)", "With issues: 2 (66.7 %).", "pearlLevelMismatch: above", "trapTypeMismatch: within", "hasAmbiguity: above"):
        assert part in text, part
    assert [text.index(f"({x})") for x in "ABCDE"] == sorted(text.index(f"({x})") for x in "ABCDE")
    assert "No cases" in sinks.evaluation_report(spark.createDataFrame([], names))


def test_snapshot_is_loaded_once_until_refreshed(spark):
    loads = []

    def load():
        loads.append(len(loads))
        if len(loads) == 3:
            raise OSError("away")
        return spark.range(len(loads)).withColumn("load", F.lit(len(loads)))

    seeds = readers.Snapshot(spark, "seeds_view", load)
    before = seeds.rows()
    assert before.count() == 1 and seeds.rows().count() == 1 and seeds.n == 1 and loads == [0]
    assert seeds.refresh() == 2 and spark.table("seeds_view").count() == 2 and before.count() == 1
    with pytest.raises(OSError, match="away"):
        seeds.refresh()
    assert seeds.rows().count() == 2
    seeds.clear()
    assert not spark.catalog.tableExists("seeds_view") and seeds.rows().count() == 4


def test_iso_time_of_far_years(spark):
    """Years of more than four digits, and years before 0, as toISOString writes them."""
    at = [0, 253402300799999, 253402300800000, -62167219200000, -62167219200001]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in at], "ms long").select(cases.iso_time("ms")).collect()]
    assert got == ["1970-01-01T00:00:00.000Z", "9999-12-31T23:59:59.999Z", "+010000-01-01T00:00:00.000Z", "0000-01-01T00:00:00.000Z", "-000001-12-31T23:59:59.999Z"]


def test_scores_hang_on_no_order_of_rows(spark, tmp_path):
    """Sums of the same discounts in any order: as doubles some fall below a rounding to one decimal, some on it."""
    own = sorted(set(permutations([0.0, 0.01, 0.01, 0.08])))
    keys = [k for k in range(1, 1000, 3) if k % 11][: len(own)]
    lines = [(k, 6.0, d) for k, p in zip(keys, own, strict=True) for d in p]
    for name, rows, schema in (("lineitem", lines, "l_orderkey long, l_quantity double, l_discount double"), ("orders", [(k, "P") for k in keys], "o_orderkey long, o_orderstatus string")):
        spark.createDataFrame(rows, schema).coalesce(1).toPandas().to_parquet(tmp_path / f"{name}.parquet")
    assert len({r["score"] for r in QUERIES["scored_by_responses"](spark, str(tmp_path)).collect()}) == 1
