"""Texts from templates that are chosen row by row.

Templates are cut into segments once, literal texts and names of fields in turn, and kept as a table by the columns that
choose them. Rows are joined with the segments of theirs and put them together in order, in one expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A field's place in a template.
PLACE = r"\{([A-Za-z_][A-Za-z0-9_]*)\}"


def segments(templates: DataFrame, text: str = "template") -> DataFrame:
    """templates with their segments, an array of (literal, field): a literal, then the field that follows it, null at the end."""
    literals = F.split(text, PLACE, -1)
    fields = F.regexp_extract_all(text, F.lit(PLACE), 1)
    pairs = F.arrays_zip(literals.alias("literal"), F.concat(fields, F.array(F.lit(None).cast("string"))).alias("field"))
    return templates.withColumn("segments", F.when(F.col(text).isNotNull(), pairs)).drop(text)


def unknown_fields(templates: DataFrame, fields: list[str], text: str = "template") -> DataFrame:
    """The templates' columns and field: places that none of the fields fills."""
    found = templates.withColumn("field", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(PLACE), 1)))).drop(text)
    return found.where(~F.col("field").isin(fields))


def rendered(df: DataFrame, templates: DataFrame, by: list[str], fields: dict[str, Column], name: str = "prompt", text: str = "template") -> DataFrame:
    """df with the text that each row's template gives; null where no template is chosen.

    templates has the columns of by and a text, one row for each choice. A template whose last columns of by are null
    serves the rows for which there is none with values there: the longest match is taken. Fields are columns of df by
    name; a null field is an empty text, and a place without a field stays as it is.
    """
    cut = segments(templates.select(*by, text), text)
    known = F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), F.coalesce(v.cast("string"), F.lit("")))])
    out, choices = df.withColumn("_known", known), []
    for n in range(len(by), 0, -1):
        # Templates that give a value for the first n columns, and none for the others.
        fits = [F.col(c).isNotNull() if i < n else F.col(c).isNull() for i, c in enumerate(by)]
        own = cut.where(_all(fits)).select(*[F.col(c).alias(f"_t{i}") for i, c in enumerate(by[:n])], F.col("segments").alias(f"_s{n}"))
        on = _all([F.col(c) == F.col(f"_t{i}") for i, c in enumerate(by[:n])])
        out = out.join(own, on, "left").drop(*[f"_t{i}" for i in range(n)])
        choices.append(F.col(f"_s{n}"))
    # The one template that serves all others is a value, not a join.
    choices.append(cut.where(_all([F.col(c).isNull() for c in by])).agg(F.any_value("segments")).scalar())
    filled = lambda s: F.concat(s["literal"], F.when(s["field"].isNull(), "").otherwise(F.coalesce(F.col("_known")[s["field"]], F.concat(F.lit("{"), s["field"], F.lit("}")))))
    out = out.withColumn("_chosen", F.coalesce(*choices)).withColumn(name, F.when(F.col("_chosen").isNotNull(), F.array_join(F.transform("_chosen", filled), "")))
    return out.drop("_known", "_chosen", *[f"_s{n}" for n in range(1, len(by) + 1)])


def _all(tests: list[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out
