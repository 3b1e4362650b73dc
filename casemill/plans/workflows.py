"""Queries of whole workflows: imports, reports, samplers, backfills, scoring by responses, and the exports' lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.functions import cases as C
from casemill.functions import vocab
from casemill.operators import aggregates as A
from casemill.operators import external as E
from casemill.operators import filters as L
from casemill.operators import generation as G
from casemill.operators import joins as J
from casemill.operators import mutations as M
from casemill.operators import validation as V
from casemill.operators.windows import first_of_each, numbered
from casemill.plans.curation import questions
from casemill.plans.registry import query
from casemill.plans.scoring import _CASES_SQL, _FOUND_SQL, _cases
from casemill.sources import sinks
from casemill.sources.readers import ideas, parsed_responses, table

# ---- sorts, filters, joins


def _sorted(spark: SparkSession, d: str, order: str) -> DataFrame:
    rows = table(spark, d, "orders", "o_orderkey", F.col("o_orderdate").alias("createdAt"), F.col("o_orderstatus").alias("pearlLevel"), F.col("o_orderpriority").alias("groundTruth"))
    return L.sorted_page(rows, order, "o_orderkey", 25, seed=3).select("o_orderkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderstatus DESC, o_orderkey LIMIT 25")
def sort_level_desc(spark: SparkSession, d: str) -> DataFrame:
    return _sorted(spark, d, "level-desc")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderpriority, o_orderkey LIMIT 25")
def sort_ground_truth(spark: SparkSession, d: str) -> DataFrame:
    return _sorted(spark, d, "groundTruth")


@query("SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey::VARCHAR || '3'), o_orderkey LIMIT 25")
def sort_random(spark: SparkSession, d: str) -> DataFrame:
    return _sorted(spark, d, "random")


@query("SELECT 'low' AS band, count(*) AS n FROM customer WHERE c_acctbal / 1000 < 6 UNION ALL SELECT 'medium', count(*) FROM customer WHERE c_acctbal / 1000 >= 6 AND c_acctbal / 1000 < 8 UNION ALL SELECT 'high', count(*) FROM customer WHERE c_acctbal / 1000 >= 8 UNION ALL SELECT 'all', count(*) FROM customer")
def score_filters(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer", (F.col("c_acctbal") / 1000).alias("score"))
    return G.every(*[L.where_score(rows, band, "score").agg(F.lit(band).alias("band"), F.count("*").alias("n")) for band in ("low", "medium", "high", "all")])


@query("SELECT p_partkey FROM part WHERE p_type IN ('ECONOMY', 'Brand#21', 'red') OR p_brand IN ('ECONOMY', 'Brand#21', 'red') OR p_name IN ('ECONOMY', 'Brand#21', 'red')")
def focus_areas(spark: SparkSession, d: str) -> DataFrame:
    return L.where_any(table(spark, d, "part", "p_partkey", "p_type", "p_brand", "p_name"), ["ECONOMY", "Brand#21", "red"], "p_type", "p_brand", "p_name").select("p_partkey")


@query("""SELECT o_orderkey, coalesce(l_linenumber, 0) AS l_linenumber, p_brand, CASE WHEN l_orderkey IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY o_orderkey ORDER BY l_quantity NULLS LAST, l_partkey, l_linenumber) END::INTEGER AS place
 FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey""")
def children_by_priority(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem", F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.struct("l_quantity", "l_partkey", "l_linenumber").alias("priority"), F.col("l_partkey").alias("p_partkey"))
    rows = J.by_priority(table(spark, d, "orders", "o_orderkey"), items, "o_orderkey", table(spark, d, "part", "p_partkey", "p_brand"), "p_partkey", "priority")
    none = F.lit(0)
    return rows.select("o_orderkey", F.coalesce("l_linenumber", none).alias("l_linenumber"), "p_brand", F.coalesce("at", none).alias("place"))


_CATALOG = [("F", "1", "first"), ("O", "1", "second"), ("F", "2", "third")]


@query("""SELECT o_orderkey, coalesce(k.name, 'none') AS name FROM orders LEFT JOIN (VALUES ('F', '1', 'first'), ('O', '1', 'second'), ('F', '2', 'third')) k(s, c, name)
 ON k.s = o_orderstatus AND k.c = substr(o_orderpriority, 1, 1)""")
def catalog_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders", "o_orderkey", F.col("o_orderstatus").alias("level"), F.substring("o_orderpriority", 1, 1).alias("code"))
    return J.looked_up(rows, spark.createDataFrame(_CATALOG, "level string, code string, name string"), ["level", "code"], "name", F.lit("none")).select("o_orderkey", "name")


# ---- sets


@query("SELECT p_size AS size, count(*) AS n FROM (SELECT p_size FROM part UNION ALL SELECT p_size FROM part WHERE p_size > 25) GROUP BY 1")
def union_bag(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part", F.col("p_size").alias("size"))
    return G.every(part, part.where(F.col("size") > 25)).groupBy("size").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT event_id % 97 AS key FROM events EXCEPT SELECT c_custkey % 61 FROM customer")
def set_diff_keys(spark: SparkSession, d: str) -> DataFrame:
    return G.without(table(spark, d, "events", (F.col("event_id") % 97).alias("key")), table(spark, d, "customer", (F.col("c_custkey") % 61).alias("key")))


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey % 4 <> 0
 UNION ALL SELECT c_custkey * 3, min(c_name || '+') FROM customer WHERE c_custkey * 3 NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0) GROUP BY 1""")
def insert_new_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer", "c_custkey", "c_name")
    new = rows.select((F.col("c_custkey") * 3).alias("c_custkey"), F.concat("c_name", F.lit("+")).alias("c_name"))
    # Two rows of each new key; one of them goes in.
    return M.inserted(rows.where(F.col("c_custkey") % 4 != 0), G.every(new, new), "c_custkey")


@query("""SELECT doc_id, len(list_filter(regexp_split_to_array(lower(substr(text, 1, 120)), '\\s+'), lambda w: length(w) > 3 AND list_contains(regexp_split_to_array(lower(substr(text, 121, 120)), '\\s+'), w))) >= 2 AS overlap FROM documents""")
def overlapping_fields(spark: SparkSession, d: str) -> DataFrame:
    """Whether a document's opening and what follows it share words; both answers are common."""
    x, z = F.substring("text", 1, 120), F.substring("text", 121, 120)
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", V.overlapping(x, z).alias("overlap"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN string_split(text, ' ')[1] END AS first, CASE WHEN doc_id % 2 = 0 THEN string_split(text, ' ')[2] END AS second FROM documents")
def padded_answers(spark: SparkSession, d: str) -> DataFrame:
    pair = C.conditional_answers(F.to_json(F.split("text", " ")), F.col("doc_id") % 2 == 0)
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.get(pair, F.lit(0)).alias("first"), F.get(pair, F.lit(1)).alias("second"))


# ---- lists, stacks, deficits


@query("SELECT coalesce(nullif(k, ''), 'unknown') AS k, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE p_brand END AS k FROM part) GROUP BY 1")
def group_lists(spark: SparkSession, d: str) -> DataFrame:
    fifth = F.col("p_partkey") % 5
    rows = table(spark, d, "part", F.col("p_partkey").alias("id"), F.when(fifth == 1, "").when(fifth > 1, F.col("p_brand")).alias("k"))
    return A.grouped_lists(rows, "k", "id").select("k", "n", F.array_join(F.col("id").cast("array<string>"), ",").alias("ids"))


_TAGS_SQL = "SELECT 1 AS source, p_partkey AS k, generate_subscripts(string_split(p_type, ' '), 1) AS i, unnest(string_split(p_type, ' ')) AS item FROM part UNION ALL SELECT 2, c_custkey, 1, c_mktsegment FROM customer UNION ALL SELECT 2, p_partkey, 2, p_brand FROM part"


@query(f"SELECT item, row_number() OVER (ORDER BY spot)::BIGINT AS place FROM (SELECT item, min((source, k, i)) AS spot FROM ({_TAGS_SQL}) GROUP BY 1)")
def recommendation_union(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "part", F.lit(1).alias("source"), F.col("p_partkey").alias("k"), F.split("p_type", " ").alias("items"))
    two = table(spark, d, "customer", F.lit(2).alias("source"), F.col("c_custkey").alias("k"), F.array("c_mktsegment").alias("items"))
    more = table(spark, d, "part", F.lit(2).alias("source"), F.col("p_partkey").alias("k"), F.array(F.lit(None).cast("string"), F.col("p_brand")).alias("items"))
    found = A.union_in_order(G.every(one, two, more), "source", ["k"], "items")
    return numbered(found, [F.col("at")], "place").select("item", "place")


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2")
def author_by_level(spark: SparkSession, d: str) -> DataFrame:
    return A.stacked(table(spark, d, "documents", "source", "lang"), "source", "lang")


@query("SELECT source, coalesce(CASE quality WHEN 1 THEN 'YES' WHEN 0 THEN 'NO' END, 'UNKNOWN') AS label, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2")
def author_by_label(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents", "doc_id", "source").join(table(spark, d, "labels", "doc_id", "quality"), "doc_id", "left")
    label = F.when(F.col("quality") == 1, "YES").when(F.col("quality") == 0, "NO").otherwise("UNKNOWN")
    return A.stacked(rows.select("source", label.alias("label")), "source", "label")


@query("""WITH t AS (SELECT p_brand, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS k FROM part GROUP BY 1)
 SELECT p_type, CASE WHEN k <= 6 THEN p_brand ELSE 'OTHER' END AS p_brand, count(*) AS n FROM part JOIN t USING (p_brand) GROUP BY 1, 2""")
def author_by_trap(spark: SparkSession, d: str) -> DataFrame:
    return A.stacked(table(spark, d, "part", "p_type", "p_brand"), "p_type", "p_brand", 6)


@query("""WITH t AS (SELECT k.lang, k.target::DOUBLE AS target, count(doc_id) AS n FROM (VALUES ('en', 0.2), ('fr', 0.5), ('de', 0.2), ('it', 0.1)) k(lang, target) LEFT JOIN documents d ON d.lang = k.lang GROUP BY 1, 2)
 SELECT lang, target, n FROM (SELECT *, target - n::DOUBLE / sum(n) OVER () AS deficit FROM t) ORDER BY deficit DESC, lang LIMIT 1""")
def greatest_deficit(spark: SparkSession, d: str) -> DataFrame:
    targets = spark.createDataFrame([("en", 0.2), ("fr", 0.5), ("de", 0.2), ("it", 0.1)], "lang string, target double")
    return A.greatest_deficit(A.deficits(table(spark, d, "documents", "lang"), targets, "lang"), "lang").select("lang", "target", "n")


@query("SELECT lang, floor(share * 500 + 0.5)::BIGINT AS quota FROM (SELECT lang, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM documents GROUP BY 1)")
def level_quotas(spark: SparkSession, d: str) -> DataFrame:
    return G.quotas(A.with_share(table(spark, d, "documents", "lang").groupBy("lang").agg(F.count("*").alias("n"))), 500).select("lang", "quota")


# ---- texts and prompts

_SCENARIO = "o_orderpriority || CASE o_orderkey % 3 WHEN 0 THEN chr(10) || 'Claim: it causes ' || o_orderstatus WHEN 1 THEN ' \"Rain causes ' || o_orderstatus || '\" they say' ELSE '' END"


def _scenario() -> Column:
    third = F.col("o_orderkey") % 3
    more = F.when(third == 0, F.concat(F.lit("\nClaim: it causes "), "o_orderstatus")).when(third == 1, F.concat(F.lit(' "Rain causes '), "o_orderstatus", F.lit('" they say'))).otherwise("")
    return F.concat("o_orderpriority", more)


@query(f"""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'it causes ' || o_orderstatus WHEN 1 THEN 'Rain causes ' || o_orderstatus ELSE 'Causal claim extracted from scenario' END AS claim,
 CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority || chr(10) ELSE {_SCENARIO} END AS cleaned,
 CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority || chr(10) || chr(10) || 'Claim: ' || o_orderstatus ELSE o_orderpriority END AS joined FROM orders""")
def claim_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus").withColumn("scenario", _scenario())
    claim = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise("")
    # The cut leaves a line feed, and trim() takes blanks only.
    return rows.select("o_orderkey", C.claim("scenario").alias("claim"), C.without_claim("scenario").alias("cleaned"), C.with_claim("o_orderpriority", claim).alias("joined"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'UNKNOWN' ELSE upper(p_brand[1]) || lower(substr(p_brand, 2, 4)) || '#' || split_part(p_brand, '#', 2) || '-' || upper(p_type[1]) || lower(substr(p_type, 2)) END AS subdomain
 FROM (SELECT p_partkey, p_brand, split_part(p_type, ' ', 1) AS p_type FROM part)""")
def subdomain_names(spark: SparkSession, d: str) -> DataFrame:
    kind = F.split_part("p_type", F.lit(" "), F.lit(1))
    raw = F.when(F.col("p_partkey") % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), F.upper("p_brand"), F.lit("-"), F.lower(kind)))
    return table(spark, d, "part", "p_partkey", "p_brand", "p_type").select("p_partkey", C.subdomain(raw).alias("subdomain"))


@query("SELECT o_orderkey, 'Case ' || o_orderkey || ' (' || o_orderstatus || '): ' || o_orderpriority || '. Level ' || o_orderstatus AS prompt FROM orders")
def prompt_texts(spark: SparkSession, d: str) -> DataFrame:
    text = C.rendered("Case {key} ({level}): {scenario}. Level {level}", key="o_orderkey", level="o_orderstatus", scenario="o_orderpriority")
    return table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority").select("o_orderkey", text.alias("prompt"))


@query("""SELECT event_id, CASE WHEN year(t) BETWEEN 0 AND 9999 THEN lpad(year(t)::VARCHAR, 4, '0') ELSE CASE WHEN year(t) < 0 THEN '-' ELSE '+' END || lpad(abs(year(t))::VARCHAR, 6, '0') END || strftime(t, '-%m-%dT%H:%M:%S.%gZ') AS shown
 FROM (SELECT event_id, make_timestamp(event_id * 86400123000) AS t FROM events)""")
def iso_times(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "event_id").select("event_id", C.iso_time(F.col("event_id") * 86400123).alias("shown"))


# ---- imports and updates

_TRAPS = ["CONFOUNDING", "collider", "Conf-Med", "none", "T7", "odd one", "MORAL"]


@query("""WITH r AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'L1' WHEN 1 THEN 'L2' ELSE 'L3' END AS level, ['CONFOUNDING', 'collider', 'Conf-Med', 'none', 'T7', 'odd one', 'MORAL'][(o_orderkey % 7 + 1)::INT] AS trap,
  CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'O' THEN 'No' ELSE 'ambiguous' END AS truth, o_orderpriority AS text FROM orders),
 k AS (SELECT *, upper(regexp_replace(trap, '[^A-Za-z0-9_]', '_', 'g')) AS key FROM r)
 SELECT o_orderkey::VARCHAR AS source_case, text || chr(10) AS scenario, 'a causes b' AS claim, level,
  CASE WHEN level = 'L2' THEN CASE key WHEN 'COLLIDER' THEN 'T3' WHEN 'CONF_MED' THEN 'T9' WHEN 'NONE' THEN 'S1' ELSE 'T7' END
   ELSE CASE key WHEN 'CONFOUNDING' THEN 'W7' WHEN 'COLLIDER' THEN 'W7' WHEN 'NONE' THEN 'S1' ELSE key END END || ':' || trap AS trap,
  CASE WHEN level = 'L3' THEN CASE upper(truth) WHEN 'YES' THEN 'VALID' WHEN 'NO' THEN 'INVALID' ELSE 'CONDITIONAL' END ELSE upper(truth) END AS truth,
  'Markets' AS domain, CASE WHEN o_orderkey % 2 = 0 THEN '{"X":{"name":"' || text || '","role":"exposure"},"Y":{"name":"Y","role":"outcome"},"Z":["z"]}' ELSE '{"X":{"name":"' || text || '","role":"exposure"},"Y":{"name":"Y","role":"outcome"},"Z":[]}' END AS variables,
  CASE WHEN o_orderkey % 2 = 0 THEN '["p","q"]' ELSE '[null,null]' END AS answers FROM k""")
def imported_cases(spark: SparkSession, d: str) -> DataFrame:
    key, text = F.col("o_orderkey"), F.col("o_orderpriority")
    pick = lambda xs, n: F.element_at(F.array(*[F.lit(x) for x in xs]), (n + 1).cast("int"))
    none = F.lit(None).cast("string")
    truth = F.when(F.col("o_orderstatus") == "F", "yes").when(F.col("o_orderstatus") == "O", "No").otherwise("ambiguous")
    notes = {"caseId": key.cast("string"), "pearlLevel": F.when(key % 3 != 0, pick(["L1", "L2", "L3"], key % 3)), "domain": F.lit(""), "subdomain": none, "trapType": pick(_TRAPS, key % 7), "trapSubtype": none, "difficulty": none, "causalStructure": none, "keyInsight": none, "author": none}
    raw = table(spark, d, "orders").select(
        F.concat(text, F.lit("\n\nClaim: 'a causes b'\n")).alias("scenario"),
        F.struct(text.alias("X"), none.alias("Y"), F.when(key % 2 == 0, "z").alias("Z")).alias("variables"),
        F.struct(*[v.alias(k) for k, v in notes.items()]).alias("annotations"),
        truth.alias("groundTruth"), F.lit("N/A").alias("hiddenTimestamp"), F.when(key % 2 == 0, '{"ifScenarioA":"p","answer_if_condition_2":"q"}').otherwise("N/A").alias("conditionalAnswers"),
        none.alias("wiseRefusal"), none.alias("explanation"),
    )
    q = sinks.imported(raw)
    return q.select(F.col("sourceCase").alias("source_case"), "scenario", "claim", F.col("pearlLevel").alias("level"), F.col("trapType").alias("trap"), F.col("groundTruth").alias("truth"), "domain", "variables", F.col("conditionalAnswers").alias("answers"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0 THEN 'LLM' WHEN o_orderkey % 5 = 0 THEN 'me' END AS author,
 CASE WHEN o_orderkey % 3 = 0 THEN 'when?' WHEN o_orderstatus = 'P' THEN 'TBD' ELSE 'N/A' END AS hidden, CASE WHEN o_orderkey % 7 = 0 THEN '[]' WHEN o_orderstatus = 'P' THEN 'TBD' ELSE 'N/A' END AS answers,
 CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS structure FROM orders""")
def backfilled_fields(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    q = table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "P", "AMBIGUOUS").otherwise("YES").alias("groundTruth"), (key % 2 == 0).alias("isLLMGenerated"), F.when(key % 5 == 0, "me").alias("author"),
        F.when(key % 3 == 0, "when?").otherwise("").alias("hiddenTimestamp"), F.when(key % 7 == 0, "[]").alias("conditionalAnswers"), F.col("o_orderpriority").alias("causalStructure"),
    )
    done = M.backfilled_ambiguity(q)
    return done.select("o_orderkey", "author", F.col("hiddenTimestamp").alias("hidden"), F.col("conditionalAnswers").alias("answers"), F.col("causalStructure").alias("structure"))


_PART = "least({}::DOUBLE, greatest(0::DOUBLE, coalesce({}, 0)))"
#: Parts for ambiguous cases, full for others; added in the rubric's order, as a sum of doubles hangs on it.
_FULL = "CASE WHEN o_orderstatus = 'P' THEN 0::DOUBLE ELSE {}::DOUBLE END"


@query(f"""WITH r AS (SELECT o_orderkey AS k, max(l_quantity) / 40 AS a, sum(l_discount::DECIMAL(18, 6))::DOUBLE * 4 AS b, count(*) / 2.0 AS c FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 3 <> 0 GROUP BY 1)
 SELECT o_orderkey, CASE WHEN k IS NULL OR o_orderkey % 11 = 0 THEN NULL ELSE floor(({_PART.format('1.0', 'a')} + {_FULL.format(1.0)} + {_FULL.format(1.5)} + {_FULL.format(1.5)} + {_PART.format('2.0', 'b')} + {_PART.format('1.0', 'c')}) * 10 + 0.5) / 10 END AS score,
 CASE WHEN k IS NULL OR o_orderkey % 11 = 0 THEN 'pending' ELSE 'scored' END AS status FROM orders LEFT JOIN r ON k = o_orderkey""")
def scored_by_responses(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem", "l_orderkey", "l_quantity", "l_discount").where(F.col("l_orderkey") % 3 != 0)
    # Added as decimals: a sum of doubles hangs on the order of the rows, and may fall on either side of a rounding.
    discounts = F.sum(F.col("l_discount").cast("decimal(18,6)"))
    made = items.groupBy("l_orderkey").agg((F.max("l_quantity") / 40).alias("scenarioClarityScore"), (discounts.cast("double") * 4).alias("wiseRefusalScore"), (F.count("*") / 2.0).alias("difficultyCalibrationScore"))
    none = F.lit(None).cast("double")
    others = [none.alias(name) for name, _, _ in vocab.RUBRIC if name not in made.columns]
    responses = made.select(F.col("l_orderkey").alias("custom_id"), (F.col("l_orderkey") % 11 == 0).alias("failed"), *[c for c in made.columns if c != "l_orderkey"], *others, F.lit(None).cast("string").alias("notes"))
    q = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "AMBIGUOUS").otherwise("NO").alias("groundTruth"), none.alias("finalScore"), F.lit("pending").alias("validationStatus"))
    return M.scored_by_responses(q, responses).select(F.col("id").alias("o_orderkey"), F.col("finalScore").alias("score"), F.col("validationStatus").alias("status"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice < 50000 GROUP BY 1")
def deletion_counts(spark: SparkSession, d: str) -> DataFrame:
    return M.deleted_counts(table(spark, d, "orders", "o_orderstatus", "o_totalprice"), F.col("o_totalprice") < 50000, "o_orderstatus")


# ---- outside scorers, with functions that stand in for them


@query("SELECT p_partkey, least(1.0, p_size / 50.0)::DOUBLE AS clarity, (CASE WHEN p_size % 10 = 0 THEN 1.0 ELSE p_size / 25.0 END)::DOUBLE AS refusal FROM (SELECT p_partkey, p_size FROM part)")
def stub_rubric(spark: SparkSession, d: str) -> DataFrame:
    def scorer(row: dict) -> dict:
        if row["p_size"] % 10 == 0:
            return {"scenarioClarityScore": min(1.0, row["p_size"] / 50.0)}  # the rest falls back
        return {"scenarioClarityScore": min(1.0, row["p_size"] / 50.0), "wiseRefusalScore": row["p_size"] / 25.0}

    rows = E.score_rubric(table(spark, d, "part", "p_partkey", "p_size"), scorer)
    return rows.select("p_partkey", F.col("scenarioClarityScore").alias("clarity"), F.col("wiseRefusalScore").alias("refusal"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'NEEDS_REVIEW' WHEN p_size > 25 THEN 'APPROVED' ELSE 'REJECTED' END AS verdict, CASE WHEN p_size % 4 = 0 THEN 2 ELSE 1 END::INTEGER AS priority FROM part")
def stub_structure(spark: SparkSession, d: str) -> DataFrame:
    def evaluator(row: dict) -> dict:
        if row["p_size"] % 4 == 0:
            raise RuntimeError("the service is down")
        return {"overallVerdict": "APPROVED" if row["p_size"] > 25 else "REJECTED", "priorityLevel": 1}

    rows = E.evaluated(table(spark, d, "part", "p_partkey", "p_size"), evaluator)
    return rows.select("p_partkey", F.col("overallVerdict").alias("verdict"), F.col("priorityLevel").alias("priority"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus WHEN o_orderkey % 9 = 0 THEN '' ELSE lower(o_orderpriority) END AS insight, CASE WHEN o_orderkey % 9 = 0 THEN o_orderpriority ELSE upper(o_orderpriority) END AS rewritten FROM orders")
def stub_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders", "o_orderkey", F.col("o_orderpriority").alias("rewritten"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise("").alias("insight"))

    def writer(row: dict) -> str:
        if row["o_orderkey"] % 9 == 0:
            raise RuntimeError("the service is down")
        return row["rewritten"].lower()

    def rewriter(row: dict) -> dict:
        if row["o_orderkey"] % 9 == 0:
            raise RuntimeError("the service is down")
        return {"_new": row["rewritten"].upper()}

    filled = E.backfilled(rows, "insight", writer)
    new = E.scored(filled, rewriter, {"_new": "string"}, {"_new": None})
    return new.select("o_orderkey", "insight", F.coalesce("_new", "rewritten").alias("rewritten"))


@query("SELECT doc_id, coalesce(quality = 1 AND n_chars / 3000.0 >= 0.85, false) AS verified, regexp_matches(lower(text), 'correlation|caus|the ') AS says FROM documents LEFT JOIN labels USING (doc_id)")
def auto_verified(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents", "doc_id", "text", "n_chars").join(table(spark, d, "labels", "doc_id", "quality"), "doc_id", "left")
    decision = F.when(F.col("quality") == 1, "APPROVE").when(F.col("quality") == 0, "REJECT")
    return rows.select("doc_id", E.auto_verified(decision, F.col("n_chars") / 3000.0).alias("verified"), E.says_any(F.col("text"), ["Correlation", "caus", "The "]).alias("says"))


# ---- validation of a whole

@query(f"""WITH {_CASES_SQL}, f AS ({_FOUND_SQL} UNION ALL SELECT id, 'duplicate_id', 'id', 'error' FROM (SELECT 'T3-' || (k % 5000) AS id FROM c) GROUP BY 1 HAVING count(*) > 1
 UNION ALL SELECT NULL, 'few_cases', 'dataset', 'error' FROM c HAVING count(*) < 1000000000) SELECT id, rule, field, severity FROM f WHERE rule IN ('duplicate_id', 'few_cases')""")
def dataset_findings(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "orders", F.concat(F.lit("T3-"), F.col("o_orderkey") % 5000).alias("id"))
    return V.dataset_rules(cases, "id", least=1_000_000_000)


@query(f"WITH {_CASES_SQL}, f AS ({_FOUND_SQL}) SELECT * FROM f WHERE severity = 'warning' ORDER BY id, rule, field LIMIT 20")
def first_warnings(spark: SparkSession, d: str) -> DataFrame:
    cases = _cases(spark, d)
    return V.first_findings(V.broken_rules(cases, V.case_rules(cases.columns), "id"))


# ---- exports


@query("""SELECT coalesce(nullif(c, ''), o_orderkey::VARCHAR) || ',' || o_orderstatus || ',' || o_orderpriority || ',,me,scored,' || score || ',,,,' || score || ',,' || score || ',' || replace(replace(o_orderpriority || ', ok' || chr(10) || 'end', ',', ';'), chr(10), ' ') AS value
 FROM (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN o_orderkey || '.1' END AS c, CASE WHEN o_orderkey % 2 = 0 THEN '1.5' ELSE '' END AS score FROM orders)""")
def score_export(spark: SparkSession, d: str) -> DataFrame:
    key, none = F.col("o_orderkey"), F.lit(None).cast("double")
    score = F.when(key % 2 == 0, 1.5)
    q = table(spark, d, "orders").select(
        key.cast("string").alias("id"), F.when(key % 3 == 0, "").when(key % 3 == 1, F.concat(key.cast("string"), F.lit(".1"))).alias("sourceCase"), F.col("o_orderstatus").alias("pearlLevel"), F.col("o_orderpriority").alias("groundTruth"),
        F.lit(None).cast("string").alias("initialAuthor"), F.lit("me").alias("validator"), F.lit("scored").alias("validationStatus"), score.alias("scenarioClarityScore"), none.alias("hiddenQuestionScore"),
        none.alias("conditionalAnswerAScore"), none.alias("conditionalAnswerBScore"), score.alias("wiseRefusalScore"), none.alias("difficultyCalibrationScore"), score.alias("finalScore"), F.concat("o_orderpriority", F.lit(", ok\nend")).alias("validatorNotes"),
    )
    return sinks.score_lines(q)


@query("""WITH r AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS number, '{"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '"}' AS row FROM orders)
 SELECT number, (CASE WHEN number = 1 THEN '[' ELSE ',' END) || row AS value FROM r UNION ALL SELECT count(*) + 1, ']' FROM r""")
def json_array(spark: SparkSession, d: str) -> DataFrame:
    return sinks.array_lines(table(spark, d, "orders", "o_orderkey", "o_orderpriority"), [F.col("o_orderkey")])


@query("""SELECT '{"custom_id":"' || o_orderkey || '","method":"POST","body":{"model":"m","messages":[{"role":"user","content":"Judge ' || o_orderpriority || '"}],"temperature":0.1}}' AS value FROM orders""")
def request_texts(spark: SparkSession, d: str) -> DataFrame:
    return sinks.request_lines(table(spark, d, "orders", "o_orderkey", "o_orderpriority"), "o_orderkey", F.concat(F.lit("Judge "), "o_orderpriority"), "m", temperature=0.1)


@query("""SELECT o_orderkey::VARCHAR AS id, CASE o_orderkey % 3 WHEN 0 THEN 'L1' WHEN 1 THEN 'L2' ELSE 'L3' END AS level, o_orderpriority || chr(10) || chr(10) || 'Claim: ' || o_orderpriority AS scenario, o_orderpriority AS x, 'q' AS answer FROM orders""")
def annotated_export(spark: SparkSession, d: str) -> DataFrame:
    rows = sinks.export_annotated(questions(spark, d), for_eval=True)
    return rows.select(F.col("annotations.caseId").alias("id"), F.col("annotations.pearlLevel").alias("level"), "scenario", F.col("variables.X.name").alias("x"), F.get("conditionalAnswers", F.lit(1)).alias("answer"))


# ---- report

_EVALUATED = "SELECT doc_id, lang AS level, source AS trap, CASE WHEN quality = 1 THEN 'APPROVED' WHEN toxic = 1 THEN 'REJECTED' ELSE 'NEEDS_REVIEW' END AS verdict, lang = 'de' AS mismatch, toxic = 1 AS ambiguous FROM labels JOIN documents USING (doc_id)"


def _evaluations(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents", "doc_id", "lang", "source"), "doc_id")
    verdict = F.when(F.col("quality") == 1, "APPROVED").when(F.col("toxic") == 1, "REJECTED").otherwise("NEEDS_REVIEW")
    return rows.select("doc_id", F.col("lang").alias("level"), F.col("source").alias("trap"), verdict.alias("verdict"), (F.col("lang") == "de").alias("mismatch"), (F.col("toxic") == 1).alias("ambiguous"))


@query(f"""WITH e AS ({_EVALUATED}), s AS (SELECT 'verdict' AS section, verdict AS name, count(*) AS n FROM e GROUP BY 2 UNION ALL SELECT 'level', level, count(*) FROM e GROUP BY 2
 UNION ALL SELECT 'trap', trap, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'issue', 'mismatch', count(*) FILTER (mismatch) FROM e UNION ALL SELECT 'issue', 'ambiguous', count(*) FILTER (ambiguous) FROM e)
 SELECT section, name, n, floor(n * 1000.0 / (SELECT count(*) FROM e) + 0.5) / 10 AS percent FROM s""")
def report_sections(spark: SparkSession, d: str) -> DataFrame:
    return A.report_sections(_evaluations(spark, d), ["verdict", "level", "trap"], ["mismatch", "ambiguous"])


@query(f"""WITH e AS ({_EVALUATED}), s AS (SELECT 'mismatch' AS name, avg(mismatch::INT) AS rate, 0.1 AS bound FROM e UNION ALL SELECT 'ambiguous', avg(ambiguous::INT), 0.2 FROM e) SELECT name, rate, rate > bound AS flagged FROM s""")
def report_flags(spark: SparkSession, d: str) -> DataFrame:
    return A.issue_flags(_evaluations(spark, d), {"mismatch": 0.1, "ambiguous": 0.2})


@query(f"WITH e AS ({_EVALUATED}) SELECT level || '-' || verdict AS cell, count(*) AS n FROM e GROUP BY 1")
def report_cells(spark: SparkSession, d: str) -> DataFrame:
    return A.cell_sizes(_evaluations(spark, d), ["level", "verdict"])


# ---- answers of outside services, in text


@query("""SELECT o_orderkey::VARCHAR AS custom_id, o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 AS failed, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 THEN o_orderkey / 2.0 END AS clarity,
 CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 THEN o_orderpriority END AS notes FROM orders""")
def batch_answers(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    said = F.concat(F.lit("Here you are: "), F.to_json(F.struct((key / 2).alias("scenarioClarityScore"), F.col("o_orderpriority").alias("notes"))), F.lit(" as asked"))
    choices = F.when(key % 7 != 0, F.array(F.struct(F.struct(said.alias("content")).alias("message"))))
    raw = table(spark, d, "orders", "o_orderkey", "o_orderpriority").select(
        key.cast("string").alias("custom_id"), F.when(key % 5 == 0, F.struct(F.lit("down").alias("message"))).alias("error"), F.struct(F.struct(F.when(key % 5 != 0, choices).alias("choices")).alias("body")).alias("response")
    )
    return parsed_responses(raw).select("custom_id", "failed", F.col("scenarioClarityScore").alias("clarity"), "notes")


@query("""SELECT o_orderkey || '-' || i AS id, o_orderpriority AS topic, 'medium' AS difficulty, CASE WHEN i = 1 THEN 2 ELSE 0 END::INTEGER AS n_entities FROM orders, range(1, 3) r(i) WHERE o_orderkey % 4 <> 0""")
def seed_ideas(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    first = F.concat(F.lit('{"id":"'), key, F.lit('-1","topic":"'), "o_orderpriority", F.lit('","entities":["a","b"]}'))
    second = F.concat(F.lit('{"id":"'), key, F.lit('-2","topic":"'), "o_orderpriority", F.lit('"}'))
    answer = F.when(F.col("o_orderkey") % 4 == 0, "I can't").otherwise(F.concat(F.lit("Sure:\n["), first, F.lit(","), second, F.lit("]\nDone")))
    rows = ideas(table(spark, d, "orders", "o_orderkey", "o_orderpriority").select(answer.alias("answer")))
    return rows.select("id", "topic", "difficulty", F.size("entities").alias("n_entities"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def first_rows(spark: SparkSession, d: str) -> DataFrame:
    return first_of_each(table(spark, d, "events", "user_id", "event_id", "event_type", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")
