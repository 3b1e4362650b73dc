"""Rules over exported cases, as one projection that names every broken rule of a row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.functions import vocab
from casemill.functions.cases import is_ambiguous, words


@dataclass(frozen=True)
class Rule:
    name: str
    field: str
    severity: str
    broken: Column


def case_rules(columns: list[str]) -> list[Rule]:
    """The rules for rows of vocab.CASE_SCHEMA; columns that a frame lacks count as missing."""
    c = lambda name: F.col(name) if name in columns else F.lit(None)
    filled = lambda x: x.isNotNull() & (x != "")
    rules = [Rule("required", f, "error", c(f).isNull()) for f in vocab.REQUIRED_FIELDS]
    level, label = c("pearl_level"), c("label")
    rules.append(Rule("level", "pearl_level", "error", filled(level) & ~level.isin(list(vocab.LEVELS))))
    for lv in ("L1", "L3"):
        rules.append(Rule(f"label_{lv}", "label", "error", (level == lv) & filled(label) & ~label.isin(vocab.LABELS[lv])))
    rules.append(Rule("label_L2", "label", "error", (level == "L2") & ~label.eqNullSafe("NO")))
    rules.append(Rule("difficulty", "difficulty", "warning", filled(c("difficulty")) & ~c("difficulty").isin(vocab.DIFFICULTIES)))
    ambiguous = F.coalesce(c("is_ambiguous"), F.lit(False))
    rules.append(Rule("ambiguous", "is_ambiguous", "error", ~c("is_ambiguous").eqNullSafe(is_ambiguous(label))))
    hidden = c("hidden_timestamp")
    rules.append(Rule("hidden_timestamp", "hidden_timestamp", "error", ambiguous & (~F.coalesce(filled(hidden), F.lit(False)) | (hidden == "N/A"))))
    rules.append(Rule("conditional_answers", "conditional_answers", "error", ambiguous & c("conditional_answers").isNull()))
    if "variables" in columns:
        v = F.col("variables")
        rules += [Rule(f"variable_{x}", f"variables.{x}", "error", v.isNotNull() & v[x].isNull()) for x in "XYZ"]
    if "trap" in columns:
        kind = F.col("trap.type")
        for lv, own in (("L1", vocab.L1_TRAPS), ("L2", vocab.L2_TRAPS), ("L3", vocab.L3_TRAPS)):
            rules.append(Rule(f"trap_{lv}", "trap.type", "warning", (level == lv) & filled(kind) & ~kind.isin([*own, *vocab.UNLABELLED_TRAPS[lv]])))
    rules.append(Rule("scenario_length", "scenario", "warning", filled(c("scenario")) & (F.length(c("scenario")) < vocab.SCENARIO_CHARS)))
    score = c("final_score").cast("double")
    rules.append(Rule("score_range", "final_score", "error", ~score.between(0, 10)))
    rules.append(Rule("score_low", "final_score", "warning", score < vocab.REVISE_SCORE))
    rules.append(Rule("id_format", "id", "warning", filled(c("id")) & ~c("id").rlike("^T3-BucketLarge-[A-Z]-[0-9]+\\.[0-9]+$")))
    rules.append(Rule("wise_refusal", "wise_refusal", "warning", ~ambiguous & ~F.coalesce(filled(c("wise_refusal")), F.lit(False))))
    return rules


def broken_rules(df: DataFrame, rules: list[Rule], key: str) -> DataFrame:
    """key, rule, field, severity of every rule that a row breaks: one scan, no join; a test that is null holds."""
    marks = [F.when(F.coalesce(r.broken, F.lit(False)), F.struct(F.lit(r.name).alias("rule"), F.lit(r.field).alias("field"), F.lit(r.severity).alias("severity"))) for r in rules]
    found = df.select(F.col(key), F.explode(F.array_compact(F.array(*marks))).alias("m"))
    return found.select(key, "m.rule", "m.field", "m.severity")


def dataset_rules(df: DataFrame, key: str, least: int = vocab.LEAST_CASES) -> DataFrame:
    """Rules of the whole: too few rows, and keys that more than one row has."""
    few = df.agg(F.count("*").alias("n")).where(F.col("n") < least).select(F.lit(None).cast("string").alias(key), F.lit("few_cases").alias("rule"), F.lit("dataset").alias("field"), F.lit("error").alias("severity"))
    twice = df.groupBy(F.col(key).cast("string").alias(key)).agg(F.count("*").alias("n")).where((F.col("n") > 1) & F.col(key).isNotNull())
    return few.unionByName(twice.select(key, F.lit("duplicate_id").alias("rule"), F.lit(key).alias("field"), F.lit("error").alias("severity")))


def validate(cases: DataFrame) -> DataFrame:
    """All findings over a frame of cases."""
    return broken_rules(cases, case_rules(cases.columns), "id").unionByName(dataset_rules(cases, "id"))


def verdict(findings: DataFrame) -> DataFrame:
    """One row: errors, warnings, and FAIL if there is any error."""
    n = findings.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return n.withColumn("verdict", F.when(F.col("errors") > 0, "FAIL").otherwise("PASS"))


def first_findings(findings: DataFrame, severity: str = "warning", most: int = 20) -> DataFrame:
    """The first findings of a severity, by id, rule and field: what a report lists."""
    own = findings.where(F.col("severity") == severity)
    return own.orderBy("id", "rule", "field").limit(most)


def repeated_values(values: Column) -> Column:
    """Whether two values of an array are equal once all but letters is left out."""
    bare = F.array_remove(F.transform(values, lambda x: F.regexp_replace(F.lower(x), "[^a-z]", "")), "")
    return F.size(F.array_distinct(bare)) < F.size(bare)


def overlapping(x: Column, z: Column, least: int = 2, chars: int = 3) -> Column:
    """Whether at least so many longer words of x, repeats counted, stand in z."""
    own = F.filter(F.split(F.lower(x), "\\s+"), lambda w: (F.length(w) > chars) & F.array_contains(F.split(F.lower(z), "\\s+"), w))
    return F.size(own) >= least


def unmatched_terms(claim: Column, scenario: Column, chars: int = 3) -> Column:
    """How many longer words of the claim, repeats counted, the scenario lacks."""
    return F.size(F.filter(words(claim), lambda w: (F.length(w) > chars) & ~F.array_contains(words(scenario), w)))


def contradicts(explanation: Column, label: Column) -> Column:
    """An explanation that denies a yes or affirms a no."""
    text, said = F.lower(F.coalesce(explanation, F.lit(""))), F.lower(F.coalesce(label, F.lit("")))
    return ((said == "yes") & F.contains(text, F.lit("cannot"))) | ((said == "no") & F.contains(text, F.lit("does cause")))


def rubric_score(ambiguous: Column, parts: dict[str, Column]) -> Column:
    """Sum of the rubric's parts, each held between 0 and its greatest; parts for ambiguous cases are full for others; one decimal."""
    total = F.lit(0.0)
    for name, most, only_ambiguous in vocab.RUBRIC:
        own = F.least(F.lit(most), F.greatest(F.lit(0.0), F.coalesce(parts[name].cast("double"), F.lit(0.0))))
        total = total + (F.when(ambiguous, own).otherwise(F.lit(most)) if only_ambiguous else own)
    return F.floor(total * 10 + 0.5).cast("double") / F.lit(10.0)
