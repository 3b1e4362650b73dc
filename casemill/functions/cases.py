"""Column functions that normalise the fields of cases; all are built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from casemill.functions import vocab


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is worked out once a row, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def present(c: Column | str) -> Column:
    """The text, or null if it is empty."""
    return F.nullif(col(c), F.lit(""))


def first_present(*cs: Column | str) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[present(c) for c in cs])


def half_up(c: Column | str, digits: int = 0) -> Column:
    """Rounding with halves towards positive infinity, as a double."""
    scale = 10.0**digits
    return F.floor(col(c) * scale + 0.5).cast("double") / F.lit(scale)


def export_label(level: Column | str, label: Column | str) -> Column:
    """NO for the second level; the third level's own words; else the label."""
    mapped = col(label)
    for old, new in vocab.L3_LABEL.items():
        mapped = F.when(col(label) == old, new).otherwise(mapped)
    return F.when(col(level) == "L2", "NO").when(col(level) == "L3", mapped).otherwise(col(label))


def imported_label(level: Column | str, label: Column | str) -> Column:
    """Upper case, and the third level's own words."""
    upper = F.upper(col(label))
    return F.when(col(level) == "L3", export_label(level, upper)).otherwise(upper)


def is_ambiguous(label: Column | str) -> Column:
    return F.coalesce(col(label).isin(vocab.AMBIGUOUS_LABELS), F.lit(False))


def trap_code(trap: Column | str) -> Column:
    """What stands before the first colon, trimmed; the whole without one; null if empty."""
    c = col(trap)
    return F.when(F.instr(c, ":") > 0, F.trim(F.substring_index(c, ":", 1))).otherwise(present(c))


def trap_rest(trap: Column | str) -> Column:
    """What stands after the first colon, trimmed; null without one."""
    c = col(trap)
    return F.when(F.instr(c, ":") > 0, F.trim(F.substring(c, F.instr(c, ":") + 1, F.length(c))))


def trap_prefix(trap: Column | str) -> Column:
    """The code by its shape, letters then digits: W10 stays W10."""
    return present(F.regexp_extract(col(trap), "^([A-Z][0-9]*)", 1))


def trap_key(trap: Column | str) -> Column:
    """Upper case, blanks, hyphens and other marks as underscores: the key of the table of older names."""
    return F.regexp_replace(F.upper(col(trap)), "[^A-Z0-9_]", "_")


def subtype_code(c: Column | str) -> Column:
    return F.replace(present(c), F.lit(" "), F.lit("_"))


def subtype_name(c: Column | str) -> Column:
    return F.replace(present(c), F.lit("_"), F.lit(" "))


def capitalised(c: Column | str, default: str = "Medium") -> Column:
    """First character upper, others lower; the default if null or empty."""
    p = present(c)
    return F.coalesce(F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1_000_000))), F.lit(default))


def difficulty(c: Column | str) -> Column:
    """Easy and Hard in any case; all else is Medium."""
    lower = F.lower(col(c))
    return F.when(lower == "easy", "Easy").when(lower == "hard", "Hard").otherwise("Medium")


def analysed_difficulty(c: Column | str) -> Column:
    """Easy, Medium and Hard by their first letters; UNKNOWN for all else."""
    lower = F.lower(F.trim(col(c)))
    return F.when(lower.isin("easy", "e"), "Easy").when(lower.isin("medium", "med", "m"), "Medium").when(lower.isin("hard", "h"), "Hard").otherwise("UNKNOWN")


def subdomain(c: Column | str) -> Column:
    """Blanks collapsed, runs of letters capitalised, also after hyphens and other marks; UNKNOWN if null or empty."""
    parts = F.regexp_extract_all(F.trim(F.regexp_replace(col(c), "\\s+", " ")), F.lit("\\p{L}+|\\P{L}+"), F.lit(0))
    return F.coalesce(present(F.array_join(F.transform(parts, F.initcap), "")), F.lit("UNKNOWN"))


# Patterns of a marked claim, of a quoted one, and of the clause that is cut from a scenario.
MARKED_CLAIM = "(?i)Claim:\\s*[\"']?([^\"'\\n]+)[\"']?"
QUOTED_CLAIM = '(?i)"([^"]+causes?[^"]+)"'
CLAIM_CLAUSE = "(?i)\\n*Claim:\\s*[\"']?[^\"'\\n]+[\"']?\\n*"


def claim(scenario: Column | str, default: str = "Causal claim extracted from scenario") -> Column:
    """A marked claim, else a quoted sentence that says what causes, else the default."""
    c = col(scenario)
    marked = F.trim(F.regexp_extract(c, MARKED_CLAIM, 1))
    quoted = F.trim(F.regexp_extract(c, QUOTED_CLAIM, 1))
    return F.coalesce(present(marked), present(quoted), F.lit(default))


def last_line(c: Column | str) -> Column:
    return F.element_at(F.split(col(c), "\n"), -1)


def without_claim(scenario: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(scenario), CLAIM_CLAUSE, "\n"))


def with_claim(scenario: Column | str, text: Column | str) -> Column:
    return F.when(present(text).isNotNull(), F.concat(col(scenario), F.lit("\n\nClaim: "), col(text))).otherwise(col(scenario))


def variables(raw: Column | str, level: Column | str) -> Column:
    """X and Y as named structs with roles, Z as an array; X' for the third level only; null if unreadable.

    Each of X and Y may be text or a struct, Z text or an array.
    """
    c, kinds = col(raw), "struct<name:string,role:string>"

    def named(text: Column, role: str) -> Column:
        made = F.struct(text.alias("name"), F.lit(role).alias("role"))
        held = lambda own: F.when(own["name"].isNotNull(), own).otherwise(made)
        return F.when(text.startswith("{"), _once(F.from_json(text, kinds), held)).when(present(text).isNotNull(), made)

    def shaped(parsed: Column) -> Column:
        z = parsed["Z"]
        several = F.when(z.startswith("["), F.from_json(z, "array<string>")).when(present(z).isNotNull(), F.array(z)).otherwise(F.array().cast("array<string>"))
        counter = F.when(col(level) == "L3", present(parsed["X'"]))
        return F.when(parsed.isNotNull(), F.struct(named(parsed["X"], "exposure").alias("X"), named(parsed["Y"], "outcome").alias("Y"), several.alias("Z"), counter.alias("X'")))

    return F.when(c.startswith("{"), _once(F.from_json(c, "struct<X:string,Y:string,Z:string,`X'`:string>"), shaped))


def conditional_answers(raw: Column | str, ambiguous: Column | None = None) -> Column:
    """Two answers from an array or a struct of either spelling, padded with null; both null if not ambiguous or unreadable."""
    c = col(raw)
    listed = F.from_json(c, "array<string>")
    s = F.from_json(c, "struct<ifScenarioA:string,ifScenarioB:string,answer_if_condition_1:string,answer_if_condition_2:string>")
    pair = F.when(c.startswith("["), F.array(F.get(listed, F.lit(0)), F.get(listed, F.lit(1)))).when(c.startswith("{"), F.array(first_present(s["ifScenarioA"], s["answer_if_condition_1"]), first_present(s["ifScenarioB"], s["answer_if_condition_2"])))
    none = F.array(F.lit(None).cast("string"), F.lit(None).cast("string"))
    kept = F.coalesce(pair, none)
    return kept if ambiguous is None else F.when(ambiguous, kept).otherwise(none)


def shortened(c: Column | str, n: int) -> Column:
    """The first n characters and three dots."""
    return F.concat(F.substring(col(c), 1, n), F.lit("..."))


def progress(done: Column | str, asked: Column | str) -> Column:
    """Percent done, rounded, at most 100; 0 if nothing was asked for."""
    return F.least(F.lit(100).cast("bigint"), F.coalesce(F.floor(F.try_divide(col(done) * 100.0, col(asked)) + 0.5), F.lit(0).cast("bigint")))


def remaining(target: Column | str, current: Column | str) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), (col(target) - col(current)).cast("bigint"))


def accuracy(correct: Column | str, n: Column | str) -> Column:
    """Rounded percentage; 0 of none."""
    return F.coalesce(F.floor(F.try_divide(col(correct) * 100.0, col(n)) + 0.5), F.lit(0).cast("bigint"))


def minutes_seconds(ms: Column | str) -> Column:
    s = F.floor(col(ms) / 1000)
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def iso_time(ms: Column | str) -> Column:
    """Milliseconds since 1970 as an ISO 8601 text in UTC; years outside 0 to 9999 have a sign and six digits, as toISOString writes them."""
    at = F.to_utc_timestamp(F.timestamp_millis(col(ms).cast("bigint")), F.current_timezone())
    year = F.year(at)
    signed = F.concat(F.when(year < 0, "-").otherwise("+"), F.lpad(F.abs(year).cast("string"), 6, "0"))
    return F.concat(F.when(year.between(0, 9999), F.lpad(year.cast("string"), 4, "0")).otherwise(signed), F.date_format(at, "-MM-dd'T'HH:mm:ss.SSS'Z'"))


def imported_trap(trap: Column | str, level: Column | str) -> Column:
    """The code of an older trap name, by level: names that are not known are themselves, or the default at the second level."""
    key = trap_key(F.coalesce(present(trap), F.lit("NONE")))
    known = lambda table: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    codes = {c: c for c in [*vocab.L2_TRAPS, *vocab.L3_TRAPS]}
    every = known(vocab.IMPORTED_TRAPS | codes)
    return F.when(col(level) == "L2", F.coalesce(known(vocab.IMPORTED_L2_TRAPS), every, F.lit(vocab.L2_DEFAULT_TRAP))).otherwise(F.coalesce(every, key))


def combined(a: Column | str, b: Column | str) -> Column:
    return F.concat_ws(" - ", F.coalesce(present(a), F.lit("OTHER")), F.coalesce(present(b), F.lit("OTHER")))


def words(c: Column | str) -> Column:
    """Lower-case words between other marks, empty ones left out."""
    return F.array_remove(F.split(F.lower(col(c)), "\\W+"), "")


def n_words(c: Column | str) -> Column:
    return F.size(F.array_remove(F.split(col(c), "\\s+"), ""))


def mentions_any(c: Column | str, phrases: list[str]) -> Column:
    """Whether the lower-cased text holds one of the phrases."""
    found = F.lit(False)
    for x in phrases:
        found = found | F.contains(F.lower(col(c)), F.lit(x))
    return F.coalesce(found, F.lit(False))


def json_in_text(c: Column | str, schema: str) -> Column:
    """The JSON array that a text holds anywhere, as an array of structs; empty if there is none to read."""
    return F.coalesce(F.from_json(present(F.regexp_extract(col(c), "(?s)\\[.*\\]", 0)), f"array<{schema}>"), F.array().cast(f"array<{schema}>"))


def csv_row(*columns: Column | str, cleaned: tuple[str, ...] = ()) -> Column:
    """Values joined by commas, nulls empty; in cleaned columns commas become semicolons and line feeds blanks."""
    out = []
    for c in columns:
        value = col(c).cast("string")
        if isinstance(c, str) and c in cleaned:
            value = F.replace(F.replace(value, F.lit(","), F.lit(";")), F.lit("\n"), F.lit(" "))
        out.append(F.coalesce(value, F.lit("")))
    return F.concat_ws(",", *out)


def uniform(key: Column | str, seed: int) -> Column:
    """A number in [0, 1) drawn from a key and a seed: the same in every run, engine and partitioning."""
    digest = F.substring(F.md5(F.concat(col(key).cast("string"), F.lit(f"|{seed}")).cast("binary")), 1, 12)
    return F.conv(digest, 16, 10).cast("bigint") / F.lit(float(1 << 48))


def rendered(template: str, **fields: Column | str) -> Column:
    """A prompt with each {name} replaced by a column (null: empty)."""
    out = F.lit(template)
    for name, c in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(col(c).cast("string"), F.lit("")))
    return out
