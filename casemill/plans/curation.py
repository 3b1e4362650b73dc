"""Exported cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.functions import vocab
from casemill.plans.registry import query
from casemill.sources import sinks
from casemill.sources.readers import table


def questions(spark: SparkSession, d: str) -> DataFrame:
    """Orders as stored questions: JSON fields in text, older trap names among codes."""
    key, text = F.col("o_orderkey"), F.col("o_orderpriority")
    third = key % 3
    level = F.when(third == 0, "L1").when(third == 1, "L2").otherwise("L3")
    trap = F.when(third == 0, F.concat(F.lit("W"), (key % 10 + 1).cast("string"), F.lit(":raw"))).when(third == 1, F.when(key % 2 == 0, "CONF-MED").otherwise("T8:SIMPSON'S")).otherwise("moral legal")
    none = F.lit(None).cast("string")
    return table(spark, d, "orders").select(
        key.cast("string").alias("id"), level.alias("pearlLevel"), F.col("o_orderdate").alias("createdAt"), F.lit("approved").alias("validationStatus"), none.alias("sourceCase"),
        F.lit("Markets").alias("domain"), F.lit("").alias("subdomain"), text.alias("scenario"), text.alias("claim"),
        F.when(F.col("o_orderstatus") == "F", "YES").when(F.col("o_orderstatus") == "O", "NO").otherwise("AMBIGUOUS").alias("groundTruth"),
        F.to_json(F.struct(text.alias("X"), text.alias("Y"), F.lit("z").alias("Z"))).alias("variables"), trap.alias("trapType"), F.lit("a b").alias("trapSubtype"),
        F.lit("HARD").alias("difficulty"), none.alias("causalStructure"), none.alias("keyInsight"), none.alias("hiddenTimestamp"), F.lit('["p","q"]').alias("conditionalAnswers"),
        F.lit("w").alias("wiseRefusal"), none.alias("explanation"), none.alias("initialAuthor"), F.lit("me").alias("author"), none.alias("validator"), F.col("o_totalprice").alias("finalScore"),
    )


_NAMES_SQL = ", ".join(f"""('{lv}', '{c}', '{n.replace("'", "''")}')""" for lv, own in (("L1", vocab.L1_TRAPS), ("L2", vocab.L2_TRAPS), ("L3", vocab.L3_TRAPS)) for c, n in own.items())


@query(f"""WITH q AS (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN 'L1' WHEN 1 THEN 'L2' ELSE 'L3' END AS level,
 CASE o_orderkey % 3 WHEN 0 THEN 'W' || (o_orderkey % 10 + 1) WHEN 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'T9' ELSE 'T8' END ELSE 'F8' END AS code FROM orders),
 n AS (SELECT *, row_number() OVER (ORDER BY level, o_orderdate, o_orderkey::VARCHAR) AS k FROM q),
 l AS (SELECT *, CASE WHEN level = 'L2' THEN 'NO' ELSE CASE o_orderstatus WHEN 'F' THEN CASE level WHEN 'L3' THEN 'VALID' ELSE 'YES' END WHEN 'O' THEN CASE level WHEN 'L3' THEN 'INVALID' ELSE 'NO' END ELSE CASE level WHEN 'L3' THEN 'CONDITIONAL' ELSE 'AMBIGUOUS' END END END AS label FROM n)
 SELECT 'T3-BucketLarge-G-' || k || '.1' AS id, k || '.1' AS case_id, l.level AS pearl_level, label, label IN ('AMBIGUOUS', 'CONDITIONAL') AS is_ambiguous,
 o_orderpriority AS x_name, 'exposure' AS x_role, 'z' AS z, l.code AS trap_type, t.name AS trap_name, 'a_b' AS subtype, 'Hard' AS difficulty, 'q' AS answer_2, 'w' AS gold_rationale, 'me' AS initial_author, o_totalprice AS final_score
 FROM l JOIN (VALUES {_NAMES_SQL}) t(level, code, name) ON t.level = l.level AND t.code = l.code""")
def case_export(spark: SparkSession, d: str) -> DataFrame:
    cases = sinks.export_cases(questions(spark, d), vocab.traps(spark), vocab.legacy_traps(spark))
    return cases.select(
        "id", "case_id", "pearl_level", "label", "is_ambiguous", F.col("variables.X.name").alias("x_name"), F.col("variables.X.role").alias("x_role"), F.array_join("variables.Z", ",").alias("z"),
        F.col("trap.type").alias("trap_type"), F.col("trap.type_name").alias("trap_name"), F.col("trap.subtype").alias("subtype"), "difficulty",
        F.col("conditional_answers.answer_if_condition_2").alias("answer_2"), "gold_rationale", "initial_author", "final_score",
    )
