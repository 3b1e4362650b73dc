"""Counts, panels, cross-tabulations, roll-ups, bands and gaps.

Each is one pass with partial aggregation before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.operators.quantiles import quantiles
from casemill.operators.tables import settled

#: Groups of a table of one row each that may be broadcast.
SMALL_GROUPS = 50_000


def panel(df: DataFrame, by: list[str] | None = None, **tests: Column) -> DataFrame:
    """total and one conditional count for each test, of all rows or by group."""
    counts = [F.count_if(t).alias(name) for name, t in tests.items()]
    return df.groupBy(*(by or [])).agg(F.count("*").alias("total"), *counts)


def crosstab(df: DataFrame, rows: list[str], column: str, values: dict[str, object]) -> DataFrame:
    """Counts of each value of a column by row keys, and the total; values name the result's columns."""
    return panel(df, rows, **{name: F.col(column) == F.lit(v) for name, v in values.items()})


def rolled_up(df: DataFrame, *keys: str) -> DataFrame:
    """Counts by the keys, by each shorter prefix of them, and in all; depth is the number of keys that hold."""
    depth = F.lit(len(keys)) - F.bit_count(F.grouping_id())
    return df.rollup(*keys).agg(F.count("*").alias("n"), depth.cast("int").alias("depth"))


def with_share(df: DataFrame, n: str = "n", by: list[str] | None = None, name: str = "share") -> DataFrame:
    """df with each count's part of the whole, or of its group's whole."""
    whole = F.sum(n).over(Window.partitionBy(*(by or [F.lit(1)])))
    return df.withColumn(name, F.try_divide(F.col(n).cast("double"), whole.cast("double")))


def top_and_other(df: DataFrame, column: str, k: int, other: str = "OTHER") -> DataFrame:
    """Counts of the k most frequent values, ties by name, and of all others together."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    # The k first are found without sorting all values in one task.
    top = counts.orderBy(F.col("n").desc(), F.col(column)).limit(k).select(F.col(column).alias("_top"))
    marked = counts.join(top, F.col(column).eqNullSafe(F.col("_top")), "left")
    named = F.when(F.col("_top").isNull() & F.col(column).isNotNull(), F.lit(other)).otherwise(F.col(column))
    return marked.groupBy(named.alias(column)).agg(F.sum("n").alias("n"))


def most_common(df: DataFrame, column: str, k: int, ascending: bool = False) -> DataFrame:
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").asc() if ascending else F.col("n").desc(), column).limit(k)


def score_band(c: Column) -> Column:
    """10, 9-10, 8-9, 6-8, below 6; null stays null."""
    return F.when(c == 10, "10").when((c >= 9) & (c < 10), "9-10").when((c >= 8) & (c < 9), "8-9").when((c >= 6) & (c < 8), "6-8").when(c < 6, "<6")


def acceptance_band(c: Column) -> Column:
    return F.when(c >= 8, "accept").when(c >= 6, "revise").when(c < 6, "reject").otherwise("unscored")


def distinct_present(c: str) -> Column:
    """Distinct values that are neither null nor empty."""
    return F.countDistinct(F.nullif(F.col(c), F.lit("")))


def coverage(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """covered and total of a dimension's values, and their ratio; values outside the dimension don't count."""
    seen = df.select(key).distinct().withColumn("_seen", F.lit(1))
    joined = dimension.select(key).distinct().join(seen, key, "left")
    return joined.agg(F.count("_seen").alias("covered"), F.count("*").alias("total")).withColumn("ratio", F.try_divide(F.col("covered").cast("double"), F.col("total").cast("double")))


def sparse_cells(df: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """Cells with fewer rows than asked: severity HIGH with one row, else MEDIUM, and how many are needed."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") < least)
    return n.select(*keys, "n", F.when(F.col("n") == 1, "HIGH").otherwise("MEDIUM").alias("severity"), (F.lit(least) - F.col("n")).alias("needed"))


def deficits(df: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """share, target and their difference of each value of targets (key, target)."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    joined = targets.join(counts, key, "left").fillna(0, ["n"])
    whole = with_share(joined, name="share")
    return whole.withColumn("deficit", F.col("target") - F.coalesce("share", F.lit(0.0)))


def tag_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows by each tag of a JSON array in text; what can't be read has no tags."""
    return df.select(F.explode(F.from_json(column, "array<string>")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def instability(df: DataFrame, evaluations: DataFrame, key: str, by: list[str], bad: Column) -> DataFrame:
    """Share of a group's rows of which any evaluation is bad; rows without evaluations are stable."""
    per_row = evaluations.groupBy(key).agg(F.bool_or(bad).alias("_bad"))
    joined = df.join(per_row, key, "left")
    return joined.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.coalesce(F.col("_bad"), F.lit(False)).cast("double")).alias("rate"))


def gap_flags(df: DataFrame, by: str, domain: str, text: str, least_domains: int = 3, long_chars: int = 200, long_share: float = 0.3) -> DataFrame:
    """Groups with few domains, or few long texts, as flags in an array."""
    long = F.avg((F.length(text) > long_chars).cast("double"))
    flags = F.array_compact(F.array(F.when(F.col("n_domains") < least_domains, "limited domain diversity"), F.when(F.col("long_share") < long_share, "few complex scenarios")))
    return df.groupBy(by).agg(F.countDistinct(domain).alias("n_domains"), long.alias("long_share")).withColumn("gaps", flags)


def five_numbers(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Quartiles, and the least and greatest value within one and a half quartile ranges of them; groups with a null key are left out."""
    df = settled(df.select(*by, value), "numbers")  # every pass reads it: what it takes to work a value out is done once
    q = quantiles(df, by, value, [0.25, 0.5, 0.75])
    q = q.select(*by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    q = settled(q, "quartiles")
    # A large group would go to one task of a shuffled join.
    near = df.join(F.broadcast(q) if q.count() <= SMALL_GROUPS else q, by).where(F.col(value).between(F.col("q1") - reach, F.col("q3") + reach))
    return near.groupBy(*by, "q1", "median", "q3").agg(F.min(value).cast("double").alias("low"), F.max(value).cast("double").alias("high"))


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Rows by equal bins between the least and greatest value; the greatest belongs to the last bin."""
    df = settled(df.select(value), "histogram")  # its bounds and its bins both read it
    low, high = df.agg(F.min(value)).scalar(), df.agg(F.max(value)).scalar()
    at = F.least(F.lit(bins - 1).cast("bigint"), F.coalesce(F.floor(F.try_divide((F.col(value) - low) * bins, high - low)), F.lit(0).cast("bigint")))
    return df.where(F.col(value).isNotNull()).select(at.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def merged_patterns(df: DataFrame, keys: list[str], ids: str, n: str, examples: str, order: str, most_examples: int = 5) -> DataFrame:
    """Patterns of equal keys as one: ids in order, counts summed, the first examples in order."""
    listed = F.sort_array(F.collect_list(F.struct(order, ids, examples)))
    found = df.groupBy(*keys).agg(F.sum(n).alias(n), listed.alias("_all"))
    return found.select(*keys, n, F.flatten(F.col(f"_all.{ids}")).alias(ids), F.slice(F.flatten(F.col(f"_all.{examples}")), 1, most_examples).alias(examples))


def grouped_lists(df: DataFrame, key: str, ids: str, unknown: str = "unknown") -> DataFrame:
    """The ids of each key in order, and how many; rows whose key is null or empty are those of unknown."""
    named = df.select(F.coalesce(F.nullif(F.col(key), F.lit("")), F.lit(unknown)).alias(key), ids)
    return named.groupBy(key).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(ids)).alias(ids))


def union_in_order(df: DataFrame, source: str, order: list[str], items: str) -> DataFrame:
    """The different items of all rows' arrays as rows (at, item), in the order of their first place; sources come in order of their number."""
    placed = df.select(source, *order, F.posexplode(items).alias("_i", "item")).where(F.col("item").isNotNull())
    first = placed.groupBy("item").agg(F.min(F.struct(source, *order, "_i")).alias("at"))
    return first.select("at", "item")


def greatest_deficit(deficits: DataFrame, key: str) -> DataFrame:
    """The row furthest below its target; of equal ones the first by key."""
    return deficits.orderBy(F.col("deficit").desc(), F.col(key)).limit(1)


def stacked(df: DataFrame, by: str, column: str, k: int | None = None, other: str = "OTHER") -> DataFrame:
    """Counts by two columns for stacked bars; with k only the k most frequent values of the second by name, others together."""
    if k is None:
        return df.groupBy(by, column).agg(F.count("*").alias("n"))
    counts = df.groupBy(by, column).agg(F.count("*").alias("n"))
    top = counts.groupBy(column).agg(F.sum("n").alias("_all")).orderBy(F.col("_all").desc(), F.col(column)).limit(k).select(F.col(column).alias("_top"))
    named = F.when(F.col("_top").isNull(), F.lit(other)).otherwise(F.col(column))
    return counts.join(top, F.col(column).eqNullSafe(F.col("_top")), "left").groupBy(by, named.alias(column)).agg(F.sum("n").alias("n"))


def report_sections(df: DataFrame, columns: list[str], issues: list[str]) -> DataFrame:
    """section, name, n, percent of all rows: a report's tables, the values of each column and the rows with each issue; one pass over the rows."""
    marks = [F.struct(F.lit(c).alias("section"), F.col(c).cast("string").alias("name"), F.lit(1).alias("one")) for c in columns]
    marks += [F.struct(F.lit("issue").alias("section"), F.lit(c).alias("name"), F.coalesce(F.col(c), F.lit(False)).cast("int").alias("one")) for c in issues]
    counts = df.select(F.explode(F.array(*marks)).alias("m")).groupBy("m.section", "m.name").agg(F.sum("m.one").alias("n"), F.count("*").alias("rows"))
    # Every row has a mark for each issue, and one for each column: a section's marks are all rows.
    whole = F.sum("rows").over(Window.partitionBy("section"))
    per = F.when(F.col("section") == "issue", F.lit(max(1, len(issues)))).otherwise(1)
    return counts.select("section", "name", "n", (F.floor(F.col("n") * 1000.0 / (whole / per) + 0.5) / 10.0).alias("percent"))


def cell_sizes(df: DataFrame, columns: list[str]) -> DataFrame:
    """cell, n: rows by the columns' values, joined by hyphens; nulls are UNKNOWN."""
    cell = F.concat_ws("-", *[F.coalesce(F.col(c).cast("string"), F.lit("UNKNOWN")) for c in columns])
    return df.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))


def issue_flags(df: DataFrame, bounds: dict[str, float]) -> DataFrame:
    """name, rate, flagged: of each issue the share of rows that have it, and whether that is over its bound."""
    rates = df.agg(*[F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double")).alias(c) for c in bounds])
    rows = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("rate"), (F.col(c) > b).alias("flagged")) for c, b in bounds.items()])
    return rates.select(F.explode(rows).alias("r")).select("r.*")


def before_after(old: DataFrame, new: DataFrame, key: str, score: str, by: list[str], accept: float = 8) -> DataFrame:
    """Revised rows by group: how many, mean change, and the share accepted now."""
    joined = old.join(new.select(key, F.col(score).alias("_new")), key)
    return joined.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col("_new") - F.col(score)).alias("mean_change"), F.avg((F.col("_new") >= accept).cast("double")).alias("accepted_share"))


def next_number(df: DataFrame, column: str) -> DataFrame:
    """One more than the greatest number after the last dot, compared as numbers."""
    number = F.try_to_number(F.regexp_extract(column, "([0-9]+)$", 1), F.lit("9999999999")).cast("bigint")
    return df.agg((F.coalesce(F.max(number), F.lit(0).cast("bigint")) + 1).alias("next"))


def totals_agree(df: DataFrame, keys: list[str]) -> DataFrame:
    """For each key, whether its counts add up to all rows."""
    total = df.agg(F.count("*")).scalar()
    parts = None
    for k in keys:
        part = df.groupBy(k).agg(F.count("*").alias("n")).agg(F.lit(k).alias("key"), F.sum("n").alias("n"))
        parts = part if parts is None else parts.union(part)
    return parts.select("key", F.coalesce("n", F.lit(0)).eqNullSafe(total).alias("agrees"))
