"""Updates, deletions and upserts as new versions of a frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.functions import vocab


def update_where(df: DataFrame, test: Column, **new: Column) -> DataFrame:
    """Columns changed in the rows where the test holds; a null test changes nothing."""
    return df.withColumns({k: F.when(F.coalesce(test, F.lit(False)), v).otherwise(F.col(k)) for k, v in new.items()})


def delete_where(df: DataFrame, test: Column) -> DataFrame:
    """Rows left without those where the test holds; a null test deletes nothing."""
    return df.where(~F.coalesce(test, F.lit(False)))


def patched(df: DataFrame, patch: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """Rows with the patch's values of the allowed columns, where it has any; other columns of it are ignored."""
    own = [c for c in allowed if c in patch.columns and c in df.columns and c != key]
    renamed = patch.select(key, *[F.col(c).alias(f"_new_{c}") for c in own])
    joined = df.join(renamed, key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in own else F.col(c) for c in df.columns])


def backfilled_ambiguity(q: DataFrame) -> DataFrame:
    """q with its author, hidden question, conditional answers and causal structure completed where they are missing.

    Generated rows without an author get LLM; ambiguous rows await a hidden question and answers (TBD) and have no
    causal structure; for all others the two don't apply (N/A).
    """
    lacks = lambda c: F.col(c).isNull() | (F.col(c) == "")
    ambiguous = F.coalesce(F.col("groundTruth") == "AMBIGUOUS", F.lit(False))
    open_ = F.when(ambiguous, "TBD").otherwise("N/A")
    new = {c: F.when(lacks(c), open_).otherwise(F.col(c)) for c in ("hiddenTimestamp", "conditionalAnswers")}
    new["author"] = F.when(F.coalesce(F.col("isLLMGenerated"), F.lit(False)) & lacks("author"), "LLM").otherwise(F.col("author"))
    new["causalStructure"] = F.when(~(ambiguous & ~lacks("causalStructure")), F.col("causalStructure"))
    return q.withColumns(new)


def scored_by_responses(q: DataFrame, responses: DataFrame) -> DataFrame:
    """q with the rubric scores of batch responses (custom_id, failed, scores, notes), by id; other rows are as before.

    Scores are held to their bounds, and parts for ambiguous cases are full for others; a response that failed, or
    whose id q lacks, changes nothing.
    """
    parts = [name for name, _, _ in vocab.RUBRIC]
    good = responses.where(~F.col("failed")).select(F.col("custom_id").alias("_id"), *[F.col(p).alias(f"_{p}") for p in parts], F.col("notes").alias("_notes"))
    ambiguous = F.coalesce(F.col("groundTruth").isin(vocab.AMBIGUOUS_LABELS), F.lit(False))
    joined = q.join(good, F.col("id") == F.col("_id"), "left")
    answered = F.col("_id").isNotNull()
    new = {}
    for name, most, only_ambiguous in vocab.RUBRIC:
        own = F.least(F.lit(most), F.greatest(F.lit(0.0), F.coalesce(f"_{name}", F.lit(0.0))))
        new[name] = F.when(ambiguous, own).otherwise(F.lit(most)) if only_ambiguous else own
    total = sum(new.values(), F.lit(0.0))
    new |= {"finalScore": F.floor(total * 10 + 0.5).cast("double") / F.lit(10.0), "validator": F.lit("batch-validator"), "validationStatus": F.lit("scored"), "validatorNotes": F.concat(F.lit("[Batch-scored] "), F.coalesce("_notes", F.lit("")))}
    kept = [F.when(answered, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in q.columns]
    return joined.select(*kept)


def deleted_counts(df: DataFrame, test: Column, by: str | None = None) -> DataFrame:
    """How many rows a deletion would take, in all or by a column, before it is done."""
    return df.where(F.coalesce(test, F.lit(False))).groupBy(*([by] if by else [])).agg(F.count("*").alias("n"))


def upserted(df: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both sides; where both have a key, the new row's values that are not null."""
    old = df.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_old_{c}") for c in df.columns])
    fresh = new.select(*[F.col(c).alias(f"_new_{c}") for c in new.columns])
    joined = old.join(fresh, F.col("_key") == F.col(f"_new_{key}"), "full_outer")
    return joined.select(*[F.coalesce(f"_new_{c}", f"_old_{c}").alias(c) if c in new.columns else F.col(f"_old_{c}").alias(c) for c in df.columns])


def inserted(df: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """df and the rows of new whose key it lacks, one for each key."""
    fresh = new.dropDuplicates([key]).join(df.select(key), key, "left_anti")
    return df.unionByName(fresh.select(df.columns))


def cascaded(children: DataFrame, parents: DataFrame, foreign: str, key: str) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(F.col(key).alias(foreign)).distinct(), foreign, "left_semi")


def counted(parents: DataFrame, children: DataFrame, key: str, **tests: Column) -> DataFrame:
    """Parents with counters derived from their children instead of being kept by increments."""
    counts = children.groupBy(key).agg(*[F.count_if(t).alias(name) for name, t in tests.items()])
    return parents.join(counts, key, "left").fillna(0, list(tests))
