"""Set operators, updates and row generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.functions import vocab
from casemill.operators import aggregates as A
from casemill.operators import generation as G
from casemill.operators import joins as J
from casemill.operators import mutations as M
from casemill.operators import sampling as S
from casemill.plans.registry import query
from casemill.sources.readers import table


@query("SELECT p_brand AS name FROM part UNION SELECT c_mktsegment FROM customer")
def union_all_distinct(spark: SparkSession, d: str) -> DataFrame:
    return G.distinct_of(table(spark, d, "part", F.col("p_brand").alias("name")), table(spark, d, "customer", F.col("c_mktsegment").alias("name")))


@query("SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_diff(spark: SparkSession, d: str) -> DataFrame:
    return G.without(table(spark, d, "customer", F.col("c_custkey").alias("key")), table(spark, d, "orders", F.col("o_custkey").alias("key")))


@query("""SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '1970-01-01' AND event_id % 2 = 1
 AND (user_id, substring(lower(event_type), 1, 50)) IN (SELECT (user_id, substring(lower(event_type), 1, 50)) FROM events WHERE event_id % 2 = 0)""")
def seen_before(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events", "event_id", "event_type", "user_id", F.lower(F.substring("event_type", 1, 50)).alias("key"))
    earlier = rows.where(F.col("event_id") % 2 == 0).select("user_id", "key").distinct()
    return rows.where(F.col("event_id") % 2 == 1).join(earlier, ["user_id", "key"], "left_semi").select("event_id", "event_type")


@query("SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal, coalesce(n.c_mktsegment, o.c_mktsegment) AS c_mktsegment FROM (SELECT * FROM customer WHERE c_custkey % 3 <> 0) o FULL JOIN (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 END AS c_acctbal, 'NEW' AS c_mktsegment FROM customer WHERE c_custkey % 5 = 0) n ON n.c_custkey = o.c_custkey")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer", "c_custkey", "c_acctbal", "c_mktsegment")
    new = rows.where(F.col("c_custkey") % 5 == 0).select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit("NEW").alias("c_mktsegment"))
    return M.upserted(rows.where(F.col("c_custkey") % 3 != 0), new, "c_custkey")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_totalprice END AS o_totalprice FROM orders")
def bulk_update(spark: SparkSession, d: str) -> DataFrame:
    return M.update_where(table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_totalprice"), F.col("o_orderstatus") == "P", o_orderstatus=F.lit("F"), o_totalprice=F.lit(0.0))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    left = M.delete_where(table(spark, d, "orders", "o_orderkey", "o_orderstatus"), F.col("o_orderstatus") == "F")
    return M.cascaded(table(spark, d, "lineitem", "l_orderkey", "l_linenumber"), left, "l_orderkey", "o_orderkey")


@query("SELECT c_custkey, c_name FROM customer")
def insert_skip_dups(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer", "c_custkey", "c_name")
    return M.inserted(rows.where(F.col("c_custkey") % 4 != 0), rows, "c_custkey")


@query("SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'PATCHED' ELSE p_brand END AS p_brand, p_size FROM part")
def patch_coalesce(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part", "p_partkey", "p_brand", "p_size")
    patch = rows.where(F.col("p_partkey") % 10 == 0).select("p_partkey", F.lit("PATCHED").alias("p_brand"), F.lit(-1).alias("p_size"))
    return M.patched(rows, patch, "p_partkey", ["p_brand"])


@query("SELECT p_type, sum(n)::BIGINT AS n, string_agg(p_brand, ',' ORDER BY p_brand) AS ids, array_to_string(list(p_brand ORDER BY p_brand)[1:5], ',') AS examples FROM (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY 1, 2) GROUP BY 1")
def merge_patterns(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part", "p_type", "p_brand").groupBy("p_type", "p_brand").agg(F.count("*").alias("n"))
    one = F.array("p_brand")
    merged = A.merged_patterns(rows.select("p_type", "n", F.col("p_brand").alias("at"), one.alias("ids"), one.alias("examples")), ["p_type"], "ids", "n", "examples", "at")
    return merged.select("p_type", "n", F.array_join("ids", ",").alias("ids"), F.array_join("examples", ",").alias("examples"))


@query("SELECT 'Brand#' || (max(try_cast(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER)) + 1) AS next_brand, max(try_cast(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT)) + 1 AS next FROM part")
def numeric_suffix_max(spark: SparkSession, d: str) -> DataFrame:
    return A.next_number(table(spark, d, "part", "p_brand"), "p_brand").select(F.concat(F.lit("Brand#"), F.col("next").cast("string")).alias("next_brand"), "next")


_QUOTAS = [("YES", 5), ("NO", 3), ("MAYBE", 0)]


@query("""WITH s AS (SELECT label, row_number() OVER (ORDER BY label, i) AS k FROM (VALUES ('YES', 5), ('NO', 3), ('MAYBE', 0)) q(label, n), range(1, 100) r(i) WHERE r.i <= q.n),
 c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS k FROM customer) SELECT c_custkey, label FROM c JOIN s USING (k)""")
def quota_assignment(spark: SparkSession, d: str) -> DataFrame:
    slots = G.expanded(spark.createDataFrame(_QUOTAS, "label string, n long"), "n").select("label", "copy")
    seeds = table(spark, d, "customer", "c_custkey")
    return G.assigned(seeds, [F.col("c_custkey")], slots, [F.col("label"), F.col("copy")]).select("c_custkey", "label")


@query("""WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer)
 SELECT c_custkey, CASE WHEN i < floor(25.0 * n / 100 + 0.5) THEN 'Easy' WHEN i < floor(25.0 * n / 100 + 0.5) + floor(50.0 * n / 100 + 0.5) THEN 'Medium' ELSE 'Hard' END AS class FROM r""")
def percent_mix(spark: SparkSession, d: str) -> DataFrame:
    """Customers dealt to three classes by percent, in the order of their balance."""
    rows = table(spark, d, "customer", "c_custkey", "c_acctbal")
    return G.dealt(rows, [F.col("c_acctbal"), F.col("c_custkey")], {"Easy": 25, "Medium": 50, "Hard": 25}).select("c_custkey", "class")


@query("SELECT o_orderkey, code, coalesce(k.name, 'OTHER') AS name FROM (SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS code FROM orders) o LEFT JOIN (VALUES ('1', 'top'), ('2', 'high'), ('3', 'middle')) k(c, name) ON k.c = o.code")
def code_dim_lookup(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([("1", "top"), ("2", "high"), ("3", "middle")], "code string, name string")
    rows = table(spark, d, "orders", "o_orderkey", F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).alias("code"))
    return J.looked_up(rows, names, ["code"], "name", F.lit("OTHER")).select("o_orderkey", "code", "name")


@query("SELECT DISTINCT split_part(o_orderpriority, '-', 1) AS code FROM orders WHERE split_part(o_orderpriority, '-', 1) NOT IN ('1', '2', '3')")
def unmapped_values(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([("1",), ("2",), ("3",)], "code string")
    return J.unmapped(table(spark, d, "orders", F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).alias("code")), names, "code")


_U = "(('0x' || substr(md5(draw || '|' || {}), 1, 12))::BIGINT / 281474976710656.0)"


def _drawn_sql(u: str, shares: list[tuple[str, float]]) -> str:
    total, at, tests = sum(s for _, s in shares), 0.0, ""
    for value, s in shares[:-1]:
        at += s
        tests += f" WHEN {u} < {at / total!r} THEN '{value}'"
    return f"CASE{tests} ELSE '{shares[-1][0]}' END" if tests else f"'{shares[-1][0]}'"


def _picked_sql(u: str, values: list[str]) -> str:
    return f"""[{", ".join(f"'{v}'" for v in values)}][(floor({u} * {len(values)}) + 1)::INT]"""


def _hierarchical_sql(seed: int) -> str:
    """Levels by what each lacks of three fifths of all orders, of which its status is the part that is there."""
    u = [_U.replace("draw", "o_orderkey").format(seed * 10 + i) for i in range(5)]
    answers = " ".join(f"WHEN '{k}' THEN {_drawn_sql(u[1], v)}" for k, v in S.ANSWER_SHARES.items())
    wolves, sheep = ([c for c in vocab.L1_TRAPS if c[0] == x] for x in "WS")
    kinds = [("L1", "NO", wolves), ("L1", "YES", sheep), ("L2", "NO", list(vocab.L2_TRAPS)), *(("L3", a, [f for f, own in vocab.L3_ANSWERS.items() if a in own]) for a in vocab.LABELS["L3"])]
    kind = " ".join(f"WHEN level = '{lv}' AND answer = '{an}' THEN {_picked_sql(u[3], own)}" for lv, an, own in kinds)
    lacks = ", ".join(f"greatest(0, count(*) * 3 // 5 - count(*) FILTER (o_orderstatus = '{status}'))::DOUBLE AS {lv}" for lv, status in _STATUS_OF.items())
    return f"""WITH s AS (SELECT {lacks} FROM orders),
 a AS (SELECT o_orderkey, CASE WHEN {u[0]} < L1 / (L1 + L2 + L3) THEN 'L1' WHEN {u[0]} < (L1 + L2) / (L1 + L2 + L3) THEN 'L2' ELSE 'L3' END AS level FROM orders, s),
 b AS (SELECT *, CASE level {answers} END AS answer, {_drawn_sql(u[2], S.DIFFICULTY_SHARES)} AS difficulty FROM a)
 SELECT *, CASE {kind} END AS type, CASE WHEN answer IN ('AMBIGUOUS', 'CONDITIONAL') THEN {_picked_sql(u[4], vocab.AMBIGUITIES)} END AS ambiguity FROM b"""


_STATUS_OF = {"L1": "F", "L2": "O", "L3": "P"}


@query(_hierarchical_sql(11))
def random_sample(spark: SparkSession, d: str) -> DataFrame:
    """A draw of level, answer, difficulty and type for every order; the levels' needs are counted from the orders."""
    rows = table(spark, d, "orders", "o_orderkey", "o_orderstatus")
    seen = rows.agg(F.count("*").alias("n"), *[F.count_if(F.col("o_orderstatus") == v).alias(k) for k, v in _STATUS_OF.items()]).first()
    needs = {k: (seen["n"] * 3 // 5, seen[k]) for k in _STATUS_OF}
    return S.drawn_for(rows.select("o_orderkey"), "o_orderkey", needs, seed=11)


@query(f"SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0 ORDER BY -ln(greatest({_U.replace('draw', 'c_custkey').format(3)}, 1e-12)) / c_acctbal, c_custkey LIMIT 50")
def weighted_pick(spark: SparkSession, d: str) -> DataFrame:
    """Customers drawn by balance without repeats; a sampling operator."""
    return S.weighted_sample(table(spark, d, "customer", "c_custkey", "c_acctbal"), "c_custkey", F.col("c_acctbal"), 50, 3)


@query(f"""WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), l AS (SELECT *, row_number() OVER (ORDER BY n, source) AS k FROM c)
 SELECT source, n FROM l WHERE k <= 3 ORDER BY -ln(greatest({_U.replace('draw', 'source').format(5)}, 1e-12)) / (4 - k), source LIMIT 1""")
def least_used_pick(spark: SparkSession, d: str) -> DataFrame:
    """One of the three rarest sources, likelier the rarer; a sampling operator."""
    docs = table(spark, d, "documents", "source")
    return S.least_used(docs, "source", docs.select("source").distinct(), seed=5)
