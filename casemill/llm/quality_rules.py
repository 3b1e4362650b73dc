"""Quality rules: a table of thresholds compiled into one projection over a text's words and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import computed

#: Rules a kept text meets: metric, least value, greatest value (None: no bound).
RULES: list[tuple[str, float | None, float | None]] = [
    ("mean_word_length", 2.5, 12.0),
    ("symbol_ratio", None, 0.2),
    ("stop_word_ratio", 0.03, None),
    ("dup_line_ratio", None, 0.5),
    ("bullet_line_ratio", None, 0.9),
    ("ellipsis_line_ratio", None, 0.3),
]

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that for it on with as are was be by this at from or an a not have has but they which we you i he she "
    "le la les de des du et un une en que qui est dans pour pas sur avec au aux par ce il elle ne se "
    "der die das und den von zu mit ist ein eine nicht im dem auf sich des für als auch "
    "el los las y del por con no una su para es al lo como más o pero"
).split()
STOP_WORDS = list(dict.fromkeys(STOP_WORDS))

#: Base limits that come before the table: fewest words, greatest share of repeated words in percent.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

SPACE = "[\\x20\\x09-\\x0D]"


def metrics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts behind the rules, each row by itself: no shuffle, no user function.

    Nulls count as empty texts. Columns of docs other than doc_id and text are dropped, so that clashing names do
    no harm. Equal 3-word windows are found by 64-bit hashes of their words, sorted with their places.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bare = F.regexp_replace(text, SPACE, "")
    words = F.array_remove(F.split(text, f"{SPACE}+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    parts = F.struct(words.alias("words"), lines.alias("lines"))
    found = docs.select("doc_id", "text", computed(parts).alias("parts")).select("doc_id", F.col("parts.words").alias("words"), F.col("parts.lines").alias("lines"), F.length(bare).cast("long").alias("word_chars"), (F.length(bare) - F.length(F.regexp_replace(bare, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"))
    w = F.col("words")
    windows = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")))
    stops = F.filter(w, lambda x: x.isin(STOP_WORDS))
    sizes = found.select(
        "doc_id",
        "word_chars",
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(stops).cast("long").alias("n_stop_words"),
        F.size(F.filter("lines", lambda x: x.rlike("^\\s*[-*•]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("lines", lambda x: x.rlike("(\\.\\.\\.|…)\\s*$"))).cast("long").alias("n_ellipsis_lines"),
        computed(F.sort_array(windows)).alias("windows"),
    )
    s = F.col("windows")
    again = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
    starts = F.sort_array(F.transform(again, lambda x: x["p"]))
    begin = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate(starts, begin, lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    return sizes.select(*[c for c in sizes.columns if c != "windows"], covered.cast("long").alias("n_repeat_words"))


def compiled(rules: list[tuple[str, float | None, float | None]]) -> Column:
    """The conjunction of a threshold table over columns named as its metrics."""
    verdict = F.lit(True)
    for name, low, high in rules:
        if low is not None:
            verdict &= F.col(name) >= F.lit(float(low))
        if high is not None:
            verdict &= F.col(name) <= F.lit(float(high))
    return verdict


def judge(docs: DataFrame, rules: list[tuple[str, float | None, float | None]] | None = None) -> DataFrame:
    """One row per row of docs: counts, ratios, base_failed and kept.

    A text of fewer than 50 words (empty and null ones too) or with over half its words in repeated 3-word
    windows fails the base; others are kept if every rule of the table holds. Repeated rows are judged each.
    """
    of = lambda n, d: F.coalesce(F.try_divide(F.col(n).cast("double"), F.col(d).cast("double")), F.lit(0.0))
    ratios = metrics(docs).select(
        "*",
        of("word_chars", "n_words").alias("mean_word_length"),
        of("n_symbols", "n_words").alias("symbol_ratio"),
        of("n_stop_words", "n_words").alias("stop_word_ratio"),
        of("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        of("n_bullet_lines", "n_lines").alias("bullet_line_ratio"),
        of("n_ellipsis_lines", "n_lines").alias("ellipsis_line_ratio"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return ratios.select("*", failed.alias("base_failed"), (~failed & compiled(RULES if rules is None else rules)).alias("kept"))


def _sql() -> str:
    stops = ", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))
    tests = [f"{n} >= {low}::DOUBLE" for n, low, _ in RULES if low is not None] + [f"{n} <= {high}::DOUBLE" for n, _, high in RULES if high is not None]
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
tok AS (SELECT doc_id, unnest(ws) AS a, generate_subscripts(ws, 1) AS p FROM w),
tri AS (SELECT doc_id, p, a, lead(a, 1) OVER q AS b, lead(a, 2) OVER q AS c FROM tok WINDOW q AS (PARTITION BY doc_id ORDER BY p)),
rep AS (SELECT doc_id, p FROM tri WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
cov AS (SELECT doc_id, count(DISTINCT p + o.i) AS n FROM rep, (VALUES (0), (1), (2)) o(i) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines,
        coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(ws, lambda x: x IN ({stops})))::BIGINT AS n_stop_words,
        len(list_filter(ls, lambda x: regexp_matches(x, '^\s*[-*•]')))::BIGINT AS n_bullet_lines,
        len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$')))::BIGINT AS n_ellipsis_lines
      FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id),
r AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0 END AS mean_word_length,
        CASE WHEN n_words > 0 THEN n_symbols::DOUBLE / n_words ELSE 0 END AS symbol_ratio,
        CASE WHEN n_words > 0 THEN n_stop_words::DOUBLE / n_words ELSE 0 END AS stop_word_ratio,
        CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END AS dup_line_ratio,
        CASE WHEN n_lines > 0 THEN n_bullet_lines::DOUBLE / n_lines ELSE 0 END AS bullet_line_ratio,
        CASE WHEN n_lines > 0 THEN n_ellipsis_lines::DOUBLE / n_lines ELSE 0 END AS ellipsis_line_ratio,
        n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(tests)} AS kept
FROM r"""


SQL = _sql()
