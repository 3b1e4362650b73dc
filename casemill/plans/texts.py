"""Text and field queries: parsing, normalising, tags, rules over words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.functions import cases as C
from casemill.functions import vocab
from casemill.operators import aggregates as A
from casemill.operators import validation as V
from casemill.plans.registry import query
from casemill.sources.readers import table


@query("SELECT o_orderkey, trim(split_part(replace(o_orderpriority, '-', ':'), ':', 1)) AS code, trim(substr(replace(o_orderpriority, '-', ':'), instr(replace(o_orderpriority, '-', ':'), ':') + 1)) AS name, 'P' || substr(o_orderpriority, 1, 1) AS prefix FROM orders")
def code_name_parse(spark: SparkSession, d: str) -> DataFrame:
    text = F.replace(F.col("o_orderpriority"), F.lit("-"), F.lit(":"))
    return table(spark, d, "orders").select("o_orderkey", C.trap_code(text).alias("code"), C.trap_rest(text).alias("name"), C.trap_prefix(F.concat(F.lit("P"), text)).alias("prefix"))


_LEVEL_SQL = "CASE o_orderkey % 3 WHEN 0 THEN 'L1' WHEN 1 THEN 'L2' ELSE 'L3' END"
_LABEL_SQL = "CASE o_orderstatus WHEN 'F' THEN 'YES' WHEN 'O' THEN 'NO' ELSE 'AMBIGUOUS' END"
_REMAP_SQL = "CASE WHEN level = 'L2' THEN 'NO' WHEN level = 'L3' THEN CASE raw WHEN 'YES' THEN 'VALID' WHEN 'NO' THEN 'INVALID' ELSE 'CONDITIONAL' END ELSE raw END"


@query(f"SELECT o_orderkey, {_REMAP_SQL} AS label, ({_REMAP_SQL}) IN ('AMBIGUOUS', 'CONDITIONAL') AS is_ambiguous FROM (SELECT o_orderkey, {_LEVEL_SQL} AS level, {_LABEL_SQL} AS raw FROM orders)")
def label_remap(spark: SparkSession, d: str) -> DataFrame:
    third = F.col("o_orderkey") % 3
    level = F.when(third == 0, "L1").when(third == 1, "L2").otherwise("L3")
    raw = F.when(F.col("o_orderstatus") == "F", "YES").when(F.col("o_orderstatus") == "O", "NO").otherwise("AMBIGUOUS")
    label = C.export_label(level, raw)
    return table(spark, d, "orders").select("o_orderkey", label.alias("label"), C.is_ambiguous(label).alias("is_ambiguous"))


@query("SELECT o_orderkey, CASE lower(split_part(o_orderpriority, '-', 2)) WHEN 'easy' THEN 'Easy' WHEN 'hard' THEN 'Hard' ELSE 'Medium' END AS difficulty, upper(substr(split_part(o_orderpriority, '-', 2), 1, 1)) || lower(substr(split_part(o_orderpriority, '-', 2), 2)) AS shown FROM orders")
def difficulty_norm(spark: SparkSession, d: str) -> DataFrame:
    word = F.split_part("o_orderpriority", F.lit("-"), F.lit(2))
    return table(spark, d, "orders").select("o_orderkey", C.difficulty(word).alias("difficulty"), C.capitalised(word).alias("shown"))


@query("SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(o_orderpriority, '-')) AS tag FROM orders) GROUP BY 1")
def tag_counts(spark: SparkSession, d: str) -> DataFrame:
    tags = F.to_json(F.split("o_orderpriority", "-"))
    return A.tag_counts(table(spark, d, "orders").select(tags.alias("tags")), "tags")


@query("SELECT (props::JSON->>'k')::BIGINT AS k, count(*) AS n, avg(value) AS mean FROM events GROUP BY 1")
def json_field_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events", "props", "value").select(F.from_json("props", "struct<k:bigint>")["k"].alias("k"), "value")
    return rows.groupBy("k").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


_PHRASES = ["the ", "der ", "experiment", "license"]


@query("SELECT doc_id, lang FROM documents WHERE regexp_matches(lower(text), 'the |der |experiment|license')")
def keyword_any(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "lang", "text").where(C.mentions_any("text", _PHRASES)).select("doc_id", "lang")


_WORDS = "list_filter(regexp_split_to_array(lower({}), '\\W+'), lambda w: w <> '')"


@query(f"""SELECT item_id, doc_id, n FROM (SELECT item_id, doc_id, len(list_filter({_WORDS.format('b.text')}, lambda w: length(w) > 3 AND NOT list_contains({_WORDS.format('d.text')}, w)))::INTEGER AS n
 FROM benchmark b JOIN documents d ON d.doc_id = b.item_id * 5) WHERE n > 2""")
def mismatch_terms(spark: SparkSession, d: str) -> DataFrame:
    claims = table(spark, d, "benchmark", (F.col("item_id") * 5).alias("doc_id"), "item_id", F.col("text").alias("claim"))
    rows = claims.join(table(spark, d, "documents", "doc_id", "text"), "doc_id")
    return rows.select("item_id", "doc_id", V.unmatched_terms(F.col("claim"), F.col("text")).alias("n")).where(F.col("n") > 2)


@query("SELECT doc_id, (quality = 1 AND contains(lower(text), 'cannot')) OR (quality = 0 AND contains(lower(text), ' the ')) AS contradicts FROM documents JOIN labels USING (doc_id)")
def contradiction_rule(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents", "doc_id", "text").join(table(spark, d, "labels", "doc_id", "quality"), "doc_id")
    said = F.when(F.col("quality") == 1, "yes").when(F.col("quality") == 0, "no")
    text = F.replace(F.lower("text"), F.lit(" the "), F.lit(" does cause "))
    return rows.select("doc_id", V.contradicts(text, said).alias("contradicts"))


@query("SELECT p_partkey, len(x) > len(list_distinct(x)) AS repeated FROM (SELECT p_partkey, list_filter(list_transform(string_split(p_name || ' ' || p_type, ' '), lambda w: regexp_replace(lower(w), '[^a-z]', '', 'g')), lambda w: w <> '') AS x FROM part)")
def dup_array_values(spark: SparkSession, d: str) -> DataFrame:
    values = F.split(F.concat_ws(" ", "p_name", "p_type"), " ")
    return table(spark, d, "part", "p_partkey", "p_name", "p_type").select("p_partkey", V.repeated_values(values).alias("repeated"))


@query("SELECT doc_id, coalesce(nullif(trim(regexp_extract(text, '(?i)under the ([a-z ]+) license', 1)), ''), 'none') AS license, substr(text, 1, 30) || '...' AS head, string_split(text, chr(10))[-1] AS last_line FROM documents")
def text_fallbacks(spark: SparkSession, d: str) -> DataFrame:
    licence = F.coalesce(C.present(F.trim(F.regexp_extract("text", "(?i)under the ([a-z ]+) license", 1))), F.lit("none"))
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", licence.alias("license"), C.shortened("text", 30).alias("head"), C.last_line("text").alias("last_line"))


@query("SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '(?i)\\n*Licensed[^\\n]+\\n*', chr(10), 'g'), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))) AS digest FROM documents")
def text_clean(spark: SparkSession, d: str) -> DataFrame:
    cleaned = F.trim(F.regexp_replace(F.regexp_replace("text", "(?i)\\n*Licensed[^\\n]+\\n*", "\n"), "[ \\t\\n\\r\\f\\x0B]+", " "))
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.md5(cleaned.cast("binary")).alias("digest"))


@query("SELECT coalesce(nullif(lang, ''), 'OTHER') || ' - ' || coalesce(CASE quality WHEN 1 THEN 'YES' WHEN 0 THEN 'NO' END, 'OTHER') AS combo, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def combo_key(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents", "doc_id", "lang").join(table(spark, d, "labels", "doc_id", "quality"), "doc_id", "left")
    return rows.groupBy(C.combined("lang", F.when(F.col("quality") == 1, "YES").when(F.col("quality") == 0, "NO")).alias("combo")).agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (regexp_matches(lower(text), '" + "|".join(vocab.STRUCTURAL_PHRASES) + "')) AS structural, count(*) FILTER (NOT regexp_matches(lower(text), '" + "|".join(vocab.STRUCTURAL_PHRASES) + "')) AS others FROM documents")
def structural_audit(spark: SparkSession, d: str) -> DataFrame:
    found = C.mentions_any("text", vocab.STRUCTURAL_PHRASES)
    return table(spark, d, "documents", "text").agg(F.count_if(found).alias("structural"), F.count_if(~found).alias("others"))


@query("SELECT event_id, floor(value * 1000 / 60000)::BIGINT || ':' || lpad((floor(value)::BIGINT % 60)::VARCHAR, 2, '0') AS shown FROM events")
def minutes_shown(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "event_id", "value").select("event_id", C.minutes_seconds(F.floor(F.col("value")) * 1000).alias("shown"))
