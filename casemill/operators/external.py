"""Calls of outside scorers and rewriters on rows, in Arrow batches, with fallbacks when a call fails."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.functions import vocab


def scored(df: DataFrame, scorer: Callable[[dict], dict], fields: dict[str, str], fallback: dict) -> DataFrame:
    """df with the fields that scorer returns for each row; fallback's values where it raises or leaves one out.

    fields: name and Spark type of each. scorer is called in the executors, once a row.
    """
    names = list(df.columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for row in pdf.to_dict("records"):
                try:
                    found.append({**fallback, **scorer(row)})
                except Exception:  # the outside service may fail in any way
                    found.append(dict(fallback))
            new = pd.DataFrame(found, columns=list(fields), index=pdf.index)
            yield pd.concat([pdf[names], new], axis=1)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *(f"`{k}` {v}" for k, v in fields.items())])
    return df.mapInPandas(run, schema)


#: What a case scores when the scorer fails: half of each part.
CAUTIOUS_SCORES = {name: most / 2 for name, most, _ in vocab.RUBRIC}


def score_rubric(df: DataFrame, scorer: Callable[[dict], dict]) -> DataFrame:
    return scored(df, scorer, {name: "double" for name, _, _ in vocab.RUBRIC}, CAUTIOUS_SCORES)


# What a structural evaluation says, and what it says when the evaluator fails.
STRUCTURE_FIELDS = {
    "pearlLevelAssessment": "string", "trapTypeAssessment": "string", "trapSubtypeAssessment": "string", "groundTruthAssessment": "string",
    "hasAmbiguity": "boolean", "hasLogicalIssues": "boolean", "hasDomainErrors": "boolean", "clarityScore": "int",
    "overallVerdict": "string", "priorityLevel": "int", "structuralNotes": "string", "suggestedCorrections": "string", "reportTags": "array<string>",
}
UNEVALUATED = dict.fromkeys(STRUCTURE_FIELDS) | {"overallVerdict": "NEEDS_REVIEW", "priorityLevel": 2, "hasAmbiguity": False, "hasLogicalIssues": False, "hasDomainErrors": False}


def evaluated(df: DataFrame, evaluator: Callable[[dict], dict]) -> DataFrame:
    """df with a structural evaluation of each row; a row that the evaluator fails on needs review."""
    return scored(df, evaluator, STRUCTURE_FIELDS, UNEVALUATED)


def backfilled(df: DataFrame, column: str, writer: Callable[[dict], str]) -> DataFrame:
    """df with a text column written where it is null or empty; what is there stays, and so does a row the writer fails on.

    The writer is called for the rows that lack the text only.
    """
    lacking = F.col(column).isNull() | (F.col(column) == "")
    written = scored(df.where(lacking), lambda row: {"_new": writer(row)}, {"_new": "string"}, {"_new": None})
    filled = written.withColumn(column, F.coalesce("_new", column)).select(df.columns)
    return df.where(~lacking).unionByName(filled)


def rewritten(df: DataFrame, column: str, rewriter: Callable[[str], str]) -> DataFrame:
    """df with a text column rewritten; the original where the rewriter fails."""
    out = scored(df, lambda row: {"_new": rewriter(row[column])}, {"_new": "string"}, {"_new": None})
    return out.withColumn(column, F.coalesce("_new", column)).drop("_new")


def auto_verified(decision: Column, confidence: Column, least: float = 0.85) -> Column:
    """Approved with enough confidence."""
    return F.coalesce((decision == "APPROVE") & (confidence >= least), F.lit(False))


def says_any(text: Column, phrases: list[str]) -> Column:
    """Whether an answer's text holds one of the phrases, in any case."""
    return F.coalesce(F.lower(text).rlike("|".join(f"\\Q{x.lower()}\\E" for x in phrases)), F.lit(False))
