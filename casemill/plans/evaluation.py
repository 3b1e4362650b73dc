"""Evaluation queries: panels, roll-ups, coverage and gaps.

The case store's tables are stood in for by the test tables: questions by documents or orders, evaluations by
labels, answers by lineitem, sessions by orders, the taxonomy by part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.functions.cases import accuracy, half_up, progress, remaining
from casemill.operators import aggregates as A
from casemill.operators import joins as J
from casemill.operators.mutations import counted
from casemill.plans.registry import query
from casemill.sources.readers import table

_ANSWERED = "FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus = 'F'"


def _answered(spark: SparkSession, d: str) -> DataFrame:
    sessions = table(spark, d, "orders", "o_orderkey", "o_orderstatus").where(F.col("o_orderstatus") == "F")
    answers = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_returnflag")
    kinds = table(spark, d, "part", "p_partkey", "p_type", "p_brand")
    return sessions.join(answers, sessions["o_orderkey"] == answers["l_orderkey"]).join(kinds, F.col("l_partkey") == F.col("p_partkey"))


@query(f"SELECT p_type, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS correct, floor(100.0 * count(*) FILTER (l_returnflag = 'R') / count(*) + 0.5)::BIGINT AS accuracy {_ANSWERED} GROUP BY p_type")
def accuracy_by_type(spark: SparkSession, d: str) -> DataFrame:
    counts = _answered(spark, d).groupBy("p_type").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("correct"))
    return counts.withColumn("accuracy", accuracy("correct", "n"))


@query(f"SELECT p_type, p_brand, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS correct {_ANSWERED} GROUP BY GROUPING SETS ((p_type), (p_brand), ())")
def accuracy_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    rows = _answered(spark, d)
    sets = rows.groupingSets([["p_type"], ["p_brand"], []], "p_type", "p_brand")
    return sets.agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("correct"))


@query("SELECT count(DISTINCT o_orderkey) AS sessions, count(l_orderkey) AS answers, count(DISTINCT CASE WHEN l_orderkey IS NULL THEN o_orderkey END) AS empty_sessions FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def completed_sessions_incl_empty(spark: SparkSession, d: str) -> DataFrame:
    sessions = table(spark, d, "orders", "o_orderkey", "o_orderstatus").where(F.col("o_orderstatus") == "F")
    counts = table(spark, d, "lineitem", "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    joined = sessions.join(counts, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return joined.agg(F.count("*").alias("sessions"), F.coalesce(F.sum("n"), F.lit(0)).alias("answers"), F.count_if(F.col("n").isNull()).alias("empty_sessions"))


@query("""SELECT count(*) AS total, count(*) FILTER (quality = 1) AS approved, count(*) FILTER (quality = 0) AS rejected, count(*) FILTER (toxic = 1) AS flagged,
 count(*) FILTER (quality = 1 AND toxic = 0) AS clean, count(*) FILTER (n_chars < 50) AS short, count(*) FILTER (lang = 'en') AS english,
 avg(n_chars) AS mean_chars, avg(quality) AS approval FROM labels JOIN documents USING (doc_id)""")
def eval_panel(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents", "doc_id", "n_chars", "lang"), "doc_id")
    q, t = F.col("quality"), F.col("toxic")
    tests = {"approved": q == 1, "rejected": q == 0, "flagged": t == 1, "clean": (q == 1) & (t == 0), "short": F.col("n_chars") < 50, "english": F.col("lang") == "en"}
    counts = [F.count_if(x).alias(k) for k, x in tests.items()]
    return rows.agg(F.count("*").alias("total"), *counts, F.avg("n_chars").alias("mean_chars"), F.avg("quality").alias("approval"))


@query("SELECT lang, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic, n FROM (SELECT lang, quality, toxic, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((lang, quality), (toxic), ()))")
def eval_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents", "doc_id", "lang"), "doc_id")
    sets = rows.groupingSets([["lang", "quality"], ["toxic"], []], "lang", "quality", "toxic").agg(F.count("*").alias("n"))
    return sets.fillna(-1, ["quality", "toxic"])


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def skip_evaluated_anti(spark: SparkSession, d: str) -> DataFrame:
    return J.not_in(table(spark, d, "documents", "doc_id", "lang"), table(spark, d, "labels", "doc_id"), "doc_id")


@query("SELECT doc_id, quality, toxic FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE source = 'src0')")
def relation_filter_semi(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "source").where(F.col("source") == "src0")
    return J.found_in(table(spark, d, "labels"), docs, "doc_id")


@query("SELECT source, count(*) AS total, count(*) FILTER (quality = 1) AS verified FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def dataset_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents", "doc_id", "source").join(table(spark, d, "labels", "doc_id", "quality"), "doc_id", "left")
    return A.panel(rows, ["source"], verified=F.col("quality") == 1)


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders", "o_orderstatus").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def crosstab_pivot(spark: SparkSession, d: str) -> DataFrame:
    return A.crosstab(table(spark, d, "orders", "o_orderpriority", "o_orderstatus"), ["o_orderpriority"], "o_orderstatus", {"f": "F", "o": "O", "p": "P"})


@query("SELECT lang, source, count(*) AS n, (2 - (GROUPING(lang) + GROUPING(source)))::INTEGER AS depth FROM documents GROUP BY ROLLUP (lang, source)")
def rollup_totals(spark: SparkSession, d: str) -> DataFrame:
    return A.rolled_up(table(spark, d, "documents", "lang", "source"), "lang", "source")


@query("SELECT k.family, count(p_partkey) AS n, count(DISTINCT p_brand) AS brands FROM (VALUES ('A', 1), ('A', 2), ('B', 3), ('C', 4)) k(family, size) LEFT JOIN part ON p_size = k.size GROUP BY k.family")
def family_subtotals(spark: SparkSession, d: str) -> DataFrame:
    families = spark.createDataFrame([("A", 1), ("A", 2), ("B", 3), ("C", 4)], "family string, p_size int")
    parts = table(spark, d, "part", "p_partkey", "p_size", "p_brand")
    return families.join(parts, "p_size", "left").groupBy("family").agg(F.count("p_partkey").alias("n"), F.countDistinct("p_brand").alias("brands"))


_SCAFFOLD = [(lang, q) for lang in ("en", "fr", "de", "es", "it") for q in (0, 1)]


@query(f"""SELECT k.lang, k.quality, count(x.doc_id) AS n FROM (VALUES {", ".join(f"('{a}', {b})" for a, b in _SCAFFOLD)}) k(lang, quality)
 LEFT JOIN (SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)) x ON x.lang = k.lang AND x.quality = k.quality GROUP BY 1, 2""")
def scaffold_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "documents", "doc_id", "lang").join(table(spark, d, "labels", "doc_id", "quality"), "doc_id").groupBy("lang", "quality").agg(F.count("*").alias("n"))
    return J.scaffolded(spark.createDataFrame(_SCAFFOLD, "lang string, quality int"), counts, ["lang", "quality"], ["n"])


_SIZES = [(x,) for x in (1, 7, 49, 50, 51, 99)]


@query("SELECT size FROM (VALUES (1), (7), (49), (50), (51), (99)) k(size) WHERE size NOT IN (SELECT p_size FROM part)")
def missing_types(spark: SparkSession, d: str) -> DataFrame:
    return J.not_in(spark.createDataFrame(_SIZES, "size int"), table(spark, d, "part", F.col("p_size").alias("size")), "size")


@query("SELECT count(*) FILTER (size IN (SELECT p_size FROM part)) AS covered, count(*) AS total, (count(*) FILTER (size IN (SELECT p_size FROM part)))::DOUBLE / count(*) AS ratio FROM (VALUES (1), (7), (49), (50), (51), (99)) k(size)")
def coverage_ratio(spark: SparkSession, d: str) -> DataFrame:
    return A.coverage(table(spark, d, "part", F.col("p_size").alias("size")), spark.createDataFrame(_SIZES, "size int"), "size")


@query("SELECT count(DISTINCT nullif(p_brand, '')) AS brands, count(DISTINCT nullif(p_type, '')) AS types, count(DISTINCT p_size) AS sizes FROM part")
def distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").agg(A.distinct_present("p_brand").alias("brands"), A.distinct_present("p_type").alias("types"), F.countDistinct("p_size").alias("sizes"))


@query("SELECT p_type, p_size, count(*) AS n, CASE WHEN count(*) = 1 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, 3 - count(*) AS needed FROM part GROUP BY 1, 2 HAVING count(*) < 3")
def coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    return A.sparse_cells(table(spark, d, "part", "p_type", "p_size"), ["p_type", "p_size"])


@query("""SELECT source, count(DISTINCT lang) AS n_domains, avg((length(text) > 1500)::INT) AS long_share,
 concat_ws('; ', CASE WHEN count(DISTINCT lang) < 4 THEN 'limited domain diversity' END, CASE WHEN avg((length(text) > 1500)::INT) < 0.5 THEN 'few complex scenarios' END) AS gaps FROM documents GROUP BY source""")
def gap_flags(spark: SparkSession, d: str) -> DataFrame:
    found = A.gap_flags(table(spark, d, "documents", "source", "lang", "text"), "source", "lang", "text", least_domains=4, long_chars=1500, long_share=0.5)
    return found.withColumn("gaps", F.array_join("gaps", "; "))


@query("SELECT lang, count(*) AS n, avg((coalesce(bad, false))::INT) AS rate FROM documents LEFT JOIN (SELECT doc_id, bool_or(quality = 0 OR toxic = 1) AS bad FROM labels GROUP BY 1) USING (doc_id) GROUP BY lang")
def instability_rate(spark: SparkSession, d: str) -> DataFrame:
    return A.instability(table(spark, d, "documents", "doc_id", "lang"), table(spark, d, "labels"), "doc_id", ["lang"], (F.col("quality") == 0) | (F.col("toxic") == 1))


@query("""WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, source) AS k FROM c)
 SELECT CASE WHEN k <= 6 THEN source ELSE 'OTHER' END AS source, sum(n)::BIGINT AS n FROM r GROUP BY 1""")
def topn_other(spark: SparkSession, d: str) -> DataFrame:
    return A.top_and_other(table(spark, d, "documents", "source"), "source", 6)


_TARGETS = [("en", 0.4), ("fr", 0.2), ("de", 0.2), ("es", 0.1), ("it", 0.1)]


@query(f"""WITH t AS (SELECT k.lang, k.target::DOUBLE AS target, count(doc_id) AS n FROM (VALUES {", ".join(f"('{a}', {b})" for a, b in _TARGETS)}) k(lang, target) LEFT JOIN documents d ON d.lang = k.lang GROUP BY 1, 2)
 SELECT lang, target, n, n::DOUBLE / sum(n) OVER () AS share, target - n::DOUBLE / sum(n) OVER () AS deficit FROM t""")
def deficit_by_level(spark: SparkSession, d: str) -> DataFrame:
    return A.deficits(table(spark, d, "documents", "lang"), spark.createDataFrame(_TARGETS, "lang string, target double"), "lang").select("lang", "target", "n", "share", "deficit")


@query("SELECT o_orderpriority, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM orders GROUP BY 1")
def percent_of_total(spark: SparkSession, d: str) -> DataFrame:
    return A.with_share(table(spark, d, "orders", "o_orderpriority").groupBy("o_orderpriority").agg(F.count("*").alias("n")))


@query("SELECT coalesce(lang, 'UNKNOWN') AS lang, coalesce(CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'poor' END, 'UNKNOWN') AS label, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2")
def label_by_level(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents", "doc_id", "lang").join(table(spark, d, "labels", "doc_id", "quality"), "doc_id", "left")
    label = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").otherwise("UNKNOWN")
    return rows.groupBy(F.coalesce("lang", F.lit("UNKNOWN")).alias("lang"), label.alias("label")).agg(F.count("*").alias("n"))


@query("SELECT lang, count(*) AS n, avg(n_chars - 1000.0) AS mean_change, avg((n_chars >= 1500)::INT) AS accepted_share FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def before_after_delta(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "labels", "doc_id").withColumn("score", F.lit(1000.0))
    new = table(spark, d, "documents", "doc_id", "lang", F.col("n_chars").cast("double").alias("score"))
    return A.before_after(old.join(new.select("doc_id", "lang"), "doc_id"), new, "doc_id", "score", ["lang"], accept=1500)


@query("SELECT key, n = (SELECT count(*) FROM documents) AS agrees FROM (SELECT 'lang' AS key, sum(c)::BIGINT AS n FROM (SELECT count(*) AS c FROM documents GROUP BY lang) UNION ALL SELECT 'source', sum(c)::BIGINT FROM (SELECT count(*) AS c FROM documents GROUP BY source))")
def totals_check(spark: SparkSession, d: str) -> DataFrame:
    return A.totals_agree(table(spark, d, "documents", "lang", "source"), ["lang", "source"])


@query("SELECT c_mktsegment, count(*) AS n, count(*) FILTER (c_acctbal >= 5000) AS accepted, (count(*) FILTER (c_acctbal >= 5000))::DOUBLE / count(*) AS rate FROM customer GROUP BY 1")
def acceptance_by_author(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "customer", "c_mktsegment", "c_acctbal").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") >= 5000).alias("accepted"))
    return counts.withColumn("rate", F.col("accepted") / F.col("n"))


@query("""SELECT o_orderkey, count(l_orderkey) AS done, floor(least(100.0, 100.0 * count(l_orderkey) / 7) + 0.5)::BIGINT AS percent, greatest(0, 7 - count(l_orderkey)) AS remaining
 FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def progress_pct(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders", "o_orderkey")
    items = table(spark, d, "lineitem", F.col("l_orderkey").alias("o_orderkey"))
    done = counted(orders, items, "o_orderkey", done=F.lit(True))
    return done.select("o_orderkey", "done", progress("done", F.lit(7)).alias("percent"), remaining(F.lit(7), "done").alias("remaining"))


@query("SELECT l_returnflag, l_linestatus, floor(avg(l_quantity) * 10 + 0.5) / 10 AS mean_quantity FROM lineitem GROUP BY 1, 2")
def rounded_means(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_quantity").alias("m")).select("l_returnflag", "l_linestatus", half_up("m", 1).alias("mean_quantity"))
