"""Queries of long runs, outside calls, batches' lives, long lists, templates and changed tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.operators import calls, embeddings, lists, templates
from casemill.operators import external as E
from casemill.operators import windows as W
from casemill.operators.runs import Run
from casemill.operators.tables import shared_folder
from casemill.plans.registry import query
from casemill.sources.buckets import BucketedTable
from casemill.sources.readers import table
from casemill.streaming import lifecycle


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id, n_chars // 100 AS hundreds, n_chars > 1000 AS long FROM documents")
def run_in_chunks(spark: SparkSession, d: str) -> DataFrame:
    """A run over all documents that is cancelled after two of its chunks and taken up again."""
    run, worked = Run(spark, _place(spark, "runs"), "hundreds"), []

    def work(rows: DataFrame) -> DataFrame:
        worked.append(1)
        if len(worked) == 2:
            run.cancel()
        return rows.select("doc_id", F.expr("n_chars div 100").alias("hundreds"), (F.col("n_chars") > 1000).alias("long"))

    run.prepare(table(spark, d, "documents", "doc_id", "n_chars"), "doc_id", 5)
    run.go(work)
    run.go(work)
    return run.result("doc_id long, hundreds long, long boolean")


@query("SELECT doc_id, CASE WHEN doc_id % 97 <> 0 THEN n_chars % 10 ELSE -1 END AS score, CASE WHEN doc_id % 97 = 0 THEN 'RuntimeError: refused' END AS error, CASE WHEN doc_id % 97 = 0 THEN 2 ELSE 1 END AS tries FROM documents")
def rated_calls(spark: SparkSession, d: str) -> DataFrame:
    """Every document scored by a stand-in for an outside service, which refuses some of them."""

    def service(row: dict, _key: str) -> dict:
        if row["doc_id"] % 97 == 0:
            raise RuntimeError("refused")
        return {"score": row["n_chars"] % 10}

    rows = table(spark, d, "documents", "doc_id", "n_chars")
    pace = calls.Pace(rate=1e9, callers=8, tries=2, pause=0.0)
    return calls.called(rows, "doc_id", service, {"score": "long"}, _place(spark, "calls"), pace).select("doc_id", F.coalesce("score", F.lit(-1)).alias("score"), "error", "tries")


@query("""WITH r AS (SELECT conv_id, min(turn) AS asked FROM conversations WHERE role = 'user' GROUP BY 1),
 a AS (SELECT conv_id, turn, NOT regexp_matches(text, '[.!?]\\s*$') AS bad FROM conversations WHERE role = 'assistant'),
 p AS (SELECT coalesce(r.conv_id, a.conv_id) AS conv_id, asked, (turn - asked) * 10 <= 24 AS intime, turn, bad FROM r FULL JOIN a ON r.conv_id = a.conv_id),
 s AS (SELECT conv_id, min(asked) AS asked, min(turn) FILTER (intime) AS first, arg_min(bad, turn) FILTER (intime) AS bad, count(*) FILTER (intime) AS n, count(*) FILTER (NOT intime) AS late FROM p GROUP BY 1)
 SELECT conv_id::VARCHAR AS custom_id, CASE WHEN asked IS NULL THEN 'unasked' WHEN first IS NULL THEN 'missing' WHEN bad THEN 'failed' ELSE 'answered' END AS outcome,
 (first - asked) * 36000.0::DOUBLE AS waited, greatest(0, n - 1) AS repeated, late FROM s""")
def batch_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as requests, asked with the first user turn; assistant turns, ten hours apart, are their answers."""
    rows = table(spark, d, "conversations").withColumn("at", F.timestamp_seconds(F.col("turn") * 36000))
    asked = rows.where(F.col("role") == "user").select(F.col("conv_id").alias("custom_id"), "at")
    told = rows.where(F.col("role") == "assistant").select(F.col("conv_id").alias("custom_id"), (~F.col("text").rlike("[.!?]\\s*$")).alias("failed"), "at")
    return lifecycle.outcomes(asked, told)


@query("""WITH r AS (SELECT coalesce(nullif(source, ''), 'unknown') AS source, doc_id FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM r)
 SELECT source, i // 50 AS chunk, count(*) AS n, string_agg(doc_id, ',' ORDER BY doc_id) AS ids FROM n GROUP BY 1, 2""")
def source_id_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Each source's documents in order, fifty to a row: a hot source is many rows in many tasks."""
    found = lists.grouped(table(spark, d, "documents", "source", "doc_id"), "source", "doc_id", 50)
    return found.select("source", "chunk", "n", F.array_join(F.col("doc_id").cast("array<string>"), ",").alias("ids"))


@query("""WITH g AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY source) - 1 AS i, sum(n) OVER (PARTITION BY lang) AS total FROM g)
 SELECT lang, i // 8 AS chunk, any_value(total)::BIGINT AS total, string_agg(source, ',' ORDER BY source) AS ids, CASE WHEN i // 8 = 0 THEN array_to_string(list(source ORDER BY source)[1:5], ',') END AS examples FROM r GROUP BY lang, i // 8""")
def pattern_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Languages as patterns: their sources in order, eight to a row, and all their documents counted."""
    rows = table(spark, d, "documents", "lang", "source").groupBy("lang", "source").agg(F.count("*").alias("n"))
    found = lists.merged(rows, ["lang"], "n", "source", "source", 8)
    return found.select("lang", "chunk", "total", F.array_join("ids", ",").alias("ids"), F.array_join("examples", ",").alias("examples"))


@query("""WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)
 SELECT conv_id, i // 3 AS chunk, count(*) AS n, string_agg(role, ',' ORDER BY turn) AS roles FROM r GROUP BY 1, 2""")
def turn_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Conversations with their turns, three to a row."""
    rows = table(spark, d, "conversations", "conv_id", "turn", "role")
    tree = lists.children(rows.select("conv_id").distinct(), rows, "conv_id", ["turn"], 3)
    return tree.select("conv_id", "chunk", "n", F.array_join(F.transform("children", lambda x: x["role"]), ",").alias("roles"))


@query("SELECT conv_id, turn, array_to_string(list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ',') AS recent FROM conversations")
def recent_turns(spark: SparkSession, d: str) -> DataFrame:
    """The roles of the three turns before each."""
    rows = W.recent_before(table(spark, d, "conversations", "conv_id", "turn", "role"), ["conv_id"], [F.col("turn")], "role", 3)
    return rows.select("conv_id", "turn", F.when(F.size("recent") > 0, F.array_join("recent", ",")).alias("recent"))


_TEMPLATES = [
    ("en", "long", "Read {id} from {source}, all {chars} characters."), ("en", None, "Read {id} ({chars})."),
    ("de", "long", "{source}: {id}, lang"), (None, None, "{id}/{source}/{other}"),
]


@query("""SELECT doc_id, CASE WHEN lang = 'en' AND n_chars > 2000 THEN 'Read ' || doc_id || ' from ' || coalesce(source, '') || ', all ' || n_chars || ' characters.' WHEN lang = 'en' THEN 'Read ' || doc_id || ' (' || n_chars || ').'
 WHEN lang = 'de' AND n_chars > 2000 THEN coalesce(source, '') || ': ' || doc_id || ', lang' ELSE doc_id || '/' || coalesce(source, '') || '/{other}' END AS prompt FROM documents""")
def row_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Each document's prompt from the template of its language and length, of its language, or of all."""
    made = spark.createDataFrame(_TEMPLATES, "lang string, kind string, template string")
    rows = table(spark, d, "documents", "doc_id", "lang", "source", "n_chars").withColumn("kind", F.when(F.col("n_chars") > 2000, "long").otherwise("short"))
    fields = {"id": F.col("doc_id"), "source": F.col("source"), "chars": F.col("n_chars")}
    return templates.rendered(rows, made, ["lang", "kind"], fields).select("doc_id", "prompt")


@query("""SELECT doc_id, CASE WHEN doc_id % 40 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars, CASE WHEN doc_id % 80 = 0 THEN 'changed' ELSE source END AS source FROM documents WHERE doc_id % 77 <> 5
 UNION ALL SELECT -1 - doc_id, n_chars, 'new' FROM documents WHERE doc_id % 100 = 0""")
def changed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents kept in buckets, some changed, some new, some deleted; buckets without a change stay as they are."""
    rows = table(spark, d, "documents", "doc_id", "n_chars", "source")
    kept = BucketedTable(spark, _place(spark, "bucketed"), "doc_id", 32)
    kept.create(rows)
    changed = rows.where(F.col("doc_id") % 40 == 0).select("doc_id", (F.col("n_chars") + 1).alias("n_chars"), F.when(F.col("doc_id") % 80 == 0, "changed").alias("source"))
    new = rows.where(F.col("doc_id") % 100 == 0).select((-1 - F.col("doc_id")).alias("doc_id"), "n_chars", F.lit("new").alias("source"))
    kept.upsert(changed.unionByName(new))
    kept.delete(rows.where(F.col("doc_id") % 77 == 5))
    return kept.read().select("doc_id", "n_chars", "source")


@query("SELECT doc_id, CASE WHEN source = 'src7' THEN source ELSE upper(source) END AS source FROM documents")
def rewritten_sources(spark: SparkSession, d: str) -> DataFrame:
    """A column rewritten by a stand-in for a service that fails on one of its values, which stays."""

    def rewriter(text: str) -> str:
        if text == "src7":
            raise RuntimeError("the service is down")
        return text.upper()

    return E.rewritten(table(spark, d, "documents", "doc_id", "source"), "source", rewriter)


@query()
def text_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Every document's vector of hashed TF-IDF in its sixteen leading directions; compared with numpy in the tests."""
    found = embeddings.embedded(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", 2048, 16)
    return found.select("doc_id", F.transform("embedding", lambda x: F.round(x, 5)).alias("embedding"))
