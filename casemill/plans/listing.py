"""Listing queries: filters, pages, orders, first rows, numbering and nesting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.functions.cases import csv_row
from casemill.operators import aggregates as A
from casemill.operators import filters as L
from casemill.operators import joins as J
from casemill.operators import windows as W
from casemill.plans.registry import query
from casemill.sources.readers import table


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice >= 6 AND o_totalprice <> 8 AND o_totalprice IS NOT NULL")
def filter_conjunction(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders", "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    kept = L.where_equal(rows, o_orderstatus="F", o_orderpriority=["1-URGENT", "2-HIGH"], o_totalprice="all")
    return L.accepted(kept, "o_totalprice", 6).where(F.col("o_totalprice") != 8).select("o_orderkey", "o_totalprice")


@query("SELECT doc_id, lang FROM documents LEFT JOIN labels USING (doc_id) WHERE (quality IS NULL OR text = '') AND NOT (lang = 'de' AND source IS NOT NULL)")
def null_or_empty(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents", "doc_id", "lang", "source", "text").join(table(spark, d, "labels", "doc_id", "quality"), "doc_id", "left")
    return rows.where((F.col("quality").isNull() | L.missing("text")) & ~((F.col("lang") == "de") & F.col("source").isNotNull())).select("doc_id", "lang")


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE 'Brand#1%' OR p_type IN ('ECONOMY', 'Brand#21') OR p_brand IN ('ECONOMY', 'Brand#21')")
def prefix_or_focus(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part", "p_partkey", "p_brand", "p_type")
    focus = F.col("p_type").isin("ECONOMY", "Brand#21") | F.col("p_brand").isin("ECONOMY", "Brand#21")
    return rows.where(F.col("p_brand").startswith("Brand#1") | focus).select("p_partkey", "p_brand")


@query("SELECT p_partkey, p_size FROM part WHERE list_contains([1, 5, 9], p_size)")
def dim_membership(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part", "p_partkey", "p_size").where(F.array_contains(F.array(F.lit(1), F.lit(5), F.lit(9)), F.col("p_size")))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def paged_sorted(spark: SparkSession, d: str) -> DataFrame:
    rows = L.where_equal(table(spark, d, "orders", "o_orderkey", "o_totalprice", "o_orderstatus"), o_orderstatus="F")
    return L.page(rows, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 50, 100).select("o_orderkey", "o_totalprice")


def _sorted(spark: SparkSession, d: str, order: str) -> DataFrame:
    rows = table(spark, d, "orders", "o_orderkey", F.col("o_orderdate").alias("createdAt"), F.col("o_orderstatus").alias("pearlLevel"), F.col("o_orderpriority").alias("domain"))
    return L.page(rows, [*L.SORTS[order](), F.col("o_orderkey")], 25).select("o_orderkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def sort_newest(spark: SparkSession, d: str) -> DataFrame:
    return _sorted(spark, d, "newest")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25")
def sort_oldest(spark: SparkSession, d: str) -> DataFrame:
    return _sorted(spark, d, "oldest")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderstatus, o_orderkey LIMIT 25")
def sort_level(spark: SparkSession, d: str) -> DataFrame:
    return _sorted(spark, d, "level")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderpriority, o_orderkey LIMIT 25")
def sort_domain(spark: SparkSession, d: str) -> DataFrame:
    return _sorted(spark, d, "domain")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return L.lookup(table(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", 7)


@query("SELECT event_id, event_type, ts FROM events ORDER BY ts DESC, event_id LIMIT 20")
def recent_k(spark: SparkSession, d: str) -> DataFrame:
    return W.most_recent(table(spark, d, "events", "event_id", "event_type", "ts"), [F.col("ts").desc(), F.col("event_id")])


@query("SELECT user_id, event_id, array_to_string(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ',') AS recent FROM events")
def recent_before(spark: SparkSession, d: str) -> DataFrame:
    rows = W.recent_before(table(spark, d, "events", "user_id", "event_id", "ts", "event_type"), ["user_id"], [F.col("ts"), F.col("event_id")], "event_type", 3)
    return rows.select("user_id", "event_id", F.when(F.size("recent") > 0, F.array_join("recent", ",")).alias("recent"))


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || '7'), doc_id LIMIT 40")
def hash_shuffle(spark: SparkSession, d: str) -> DataFrame:
    return L.shuffled(table(spark, d, "documents", "doc_id"), "doc_id", 40, 7)


@query("SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events) WHERE k <= 5")
def first_n_per_group(spark: SparkSession, d: str) -> DataFrame:
    return W.first_of_each(table(spark, d, "events", "event_id", "event_type", "ts"), ["event_type"], [F.col("ts"), F.col("event_id")], 5).select("event_id", "event_type")


@query("SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents", "doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    return rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where(F.col("n") > 1)


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def first_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders", "o_orderstatus", "o_orderpriority").distinct()


@query("(SELECT 'top' AS side, p_brand, count(*) AS n FROM part GROUP BY 2 ORDER BY n DESC, p_brand LIMIT 3) UNION ALL (SELECT 'bottom', p_brand, count(*) AS n FROM part GROUP BY 2 ORDER BY n, p_brand LIMIT 3)")
def top_bottom_k(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part", "p_brand")
    side = lambda name, up: A.most_common(part, "p_brand", 3, up).select(F.lit(name).alias("side"), "p_brand", "n")
    return side("top", False).union(side("bottom", True))


@query("SELECT row_number() OVER (ORDER BY o_orderstatus, o_orderdate, o_orderkey) AS number, o_orderkey, 'T3-BucketLarge-G-' || row_number() OVER (ORDER BY o_orderstatus, o_orderdate, o_orderkey) || '.1' AS case_id FROM orders")
def case_numbering(spark: SparkSession, d: str) -> DataFrame:
    rows = W.numbered(table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderdate"), [F.col("o_orderstatus"), F.col("o_orderdate"), F.col("o_orderkey")])
    return rows.select("number", "o_orderkey", F.concat(F.lit("T3-BucketLarge-G-"), F.col("number").cast("string"), F.lit(".1")).alias("case_id"))


@query("SELECT o_orderkey, count(l_orderkey)::INTEGER AS n_children, coalesce(min(l_linenumber), 0) AS first_line, coalesce(string_agg(l_linenumber || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag), '') AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def nested_children(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem", F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_returnflag")
    tree = J.nested(table(spark, d, "orders", "o_orderkey"), items, "o_orderkey", ["l_linenumber"])
    lines = F.array_join(F.transform("children", lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit(":"), x["l_returnflag"])), ",")
    return tree.select("o_orderkey", F.size("children").alias("n_children"), F.coalesce(F.get(F.col("children"), F.lit(0))["l_linenumber"], F.lit(0)).alias("first_line"), lines.alias("lines"))


@query("SELECT coalesce(o_orderkey::VARCHAR, '') || ',' || coalesce(o_orderstatus, '') || ',' || coalesce(replace(replace(o_orderpriority, ',', ';'), chr(10), ' '), '') AS line FROM orders")
def csv_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    return rows.select(csv_row("o_orderkey", "o_orderstatus", "o_orderpriority", cleaned=("o_orderpriority",)).alias("line"))


@query("SELECT event_type, event_id, ((row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) % 4)::INTEGER AS turn FROM events")
def round_robin(spark: SparkSession, d: str) -> DataFrame:
    return W.round_robin(table(spark, d, "events", "event_type", "event_id", "ts"), ["event_type"], [F.col("ts"), F.col("event_id")], 4).select("event_type", "event_id", "turn")
