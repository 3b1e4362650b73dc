"""Exports: nested cases, flat scores, request lines, schema and report texts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegralType, NumericType, StructType

from casemill.functions import cases, vocab
from casemill.operators import aggregates
from casemill.operators.windows import numbered


def export_cases(q: DataFrame, traps: DataFrame, legacy: DataFrame, bucket: str = "BucketLarge-G", only_approved: bool = True) -> DataFrame:
    """Questions in the shape of vocab.CASE_SCHEMA, numbered in the order of level, creation and id."""
    rows = q.where(F.col("validationStatus") == "approved") if only_approved else q
    rows = numbered(rows, [F.col("pearlLevel").asc(), F.col("createdAt").asc(), F.col("id").asc()], "_n")
    named = with_trap(rows, traps, legacy)
    label = cases.export_label("pearlLevel", "groundTruth")
    case_id = F.coalesce(cases.present("sourceCase"), F.concat(F.col("_n").cast("string"), F.lit(".1")))
    answers = cases.conditional_answers("conditionalAnswers")
    return named.select(
        F.concat(F.lit(f"T3-{bucket}-"), case_id).alias("id"),
        case_id.alias("case_id"),
        F.lit(bucket).alias("bucket"),
        F.col("pearlLevel").alias("pearl_level"),
        "domain",
        cases.present("subdomain").alias("subdomain"),
        "scenario",
        "claim",
        label.alias("label"),
        cases.is_ambiguous(label).alias("is_ambiguous"),
        cases.variables("variables", "pearlLevel").alias("variables"),
        F.struct(F.col("trap_code").alias("type"), F.col("trap_name").alias("type_name"), cases.subtype_code("trapSubtype").alias("subtype"), cases.subtype_name("trapSubtype").alias("subtype_name")).alias("trap"),
        cases.capitalised("difficulty").alias("difficulty"),
        cases.present("causalStructure").alias("causal_structure"),
        cases.present("keyInsight").alias("key_insight"),
        cases.present("hiddenTimestamp").alias("hidden_timestamp"),
        F.when(F.col("conditionalAnswers").isNotNull(), F.struct(F.get(answers, F.lit(0)).alias("answer_if_condition_1"), F.get(answers, F.lit(1)).alias("answer_if_condition_2"))).alias("conditional_answers"),
        cases.present("wiseRefusal").alias("wise_refusal"),
        cases.first_present("explanation", "wiseRefusal").alias("gold_rationale"),
        F.coalesce(cases.first_present("initialAuthor", "author"), F.lit("Unknown")).alias("initial_author"),
        cases.present("validator").alias("validator"),
        F.col("finalScore").cast("double").alias("final_score"),
    )


def with_trap(q: DataFrame, traps: DataFrame, legacy: DataFrame) -> DataFrame:
    """q with trap_code and trap_name.

    Before a colon stands the code, whose name is the taxonomy's at the row's level or else what follows the colon. A
    text without a colon is looked up among the level's codes and older names, or stands for both code and name.
    """
    code, rest = cases.trap_code("trapType"), cases.trap_rest("trapType")
    rows = q.withColumn("_code", code).withColumn("_key", F.when(rest.isNull(), cases.trap_key(code)).otherwise(code))
    named = legacy.join(traps.select("level", "code", "name"), ["level", "code"]).select(F.col("level").alias("pearlLevel"), F.col("key").alias("_key"), F.col("code").alias("_known"), F.col("name").alias("_name"))
    found = rows.join(named, ["pearlLevel", "_key"], "left")
    own = F.when(rest.isNull(), F.coalesce("_known", "_code")).otherwise(F.col("_code"))
    return found.withColumn("trap_code", own).withColumn("trap_name", F.coalesce("_name", rest, "_code")).drop("_key", "_code", "_known", "_name")


SCORE_COLUMNS = ["pearlLevel", "groundTruth", "initialAuthor", "validator", "validationStatus", "scenarioClarityScore", "hiddenQuestionScore", "conditionalAnswerAScore", "conditionalAnswerBScore", "wiseRefusalScore", "difficultyCalibrationScore", "finalScore", "validatorNotes"]


def score_lines(q: DataFrame) -> DataFrame:
    """One line of 14 values a question: its case or id, then SCORE_COLUMNS; nulls are empty, and notes hold no commas or line feeds."""
    rows = q.withColumn("caseId", cases.first_present("sourceCase", "id"))
    return rows.select(cases.csv_row("caseId", *SCORE_COLUMNS, cleaned=("validatorNotes",)).alias("value"))


def score_header() -> str:
    return ",".join(["caseId", *SCORE_COLUMNS])


def imported(raw: DataFrame) -> DataFrame:
    """Cases of the older shape (scenario with its claim, variables, annotations) as questions to be stored."""
    note = lambda c: F.col(f"annotations.{c}")
    level = F.coalesce(cases.present(note("pearlLevel")), F.lit("L1"))
    trap = F.concat(cases.imported_trap(note("trapType"), level), F.lit(":"), F.coalesce(cases.first_present(note("trapSubtype"), note("trapType")), F.lit("Unknown")))
    variable = lambda x, role: F.struct(F.coalesce(cases.present(f"variables.{x}"), F.lit(x)).alias("name"), F.lit(role).alias("role")).alias(x)
    z = F.when(cases.present("variables.Z").isNotNull(), F.array("variables.Z")).otherwise(F.array().cast("array<string>"))
    return raw.select(
        cases.without_claim("scenario").alias("scenario"),
        cases.claim("scenario").alias("claim"),
        level.alias("pearlLevel"),
        F.coalesce(cases.present(note("domain")), F.lit("Markets")).alias("domain"),
        cases.present(note("subdomain")).alias("subdomain"),
        trap.alias("trapType"),
        F.coalesce(note("trapSubtype"), F.lit("")).alias("trapSubtype"),
        cases.imported_label(level, "groundTruth").alias("groundTruth"),
        cases.difficulty(note("difficulty")).alias("difficulty"),
        F.to_json(F.struct(variable("X", "exposure"), variable("Y", "outcome"), z.alias("Z"))).alias("variables"),
        F.nullif("hiddenTimestamp", F.lit("N/A")).alias("hiddenTimestamp"),
        F.to_json(cases.conditional_answers("conditionalAnswers"), {"ignoreNullFields": "false"}).alias("conditionalAnswers"),
        "wiseRefusal",
        "explanation",
        F.col("explanation").alias("goldRationale"),
        note("author").alias("author"),
        note("caseId").alias("sourceCase"),
    )


def export_annotated(q: DataFrame, for_eval: bool = False) -> DataFrame:
    """The older shape: scenario with its claim, variables, and annotations; for_eval leaves out what gives the answer away."""
    kept = [F.col("id").alias("caseId"), F.col("pearlLevel"), F.col("domain"), F.col("subdomain"), F.col("difficulty")]
    own = [F.col("trapType"), F.col("trapSubtype"), F.col("causalStructure"), F.col("keyInsight"), F.col("author")]
    text = cases.with_claim("scenario", "claim").alias("scenario")
    shape = [text, cases.variables("variables", "pearlLevel").alias("variables"), F.struct(*kept, *([] if for_eval else own)).alias("annotations")]
    answers = [F.col("hiddenTimestamp"), cases.conditional_answers("conditionalAnswers").alias("conditionalAnswers")]
    return q.select(*shape, *answers) if for_eval else q.select(*shape, F.col("groundTruth"), *answers, F.col("wiseRefusal"), F.col("explanation"))


def request_lines(df: DataFrame, key: str, prompt: Column, model: str, **options: object) -> DataFrame:
    """One JSON request a row, keyed by custom_id."""
    message = F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")))
    body = F.struct(F.lit(model).alias("model"), message.alias("messages"), *[F.lit(v).alias(k) for k, v in options.items()])
    return df.select(F.to_json(F.struct(F.col(key).cast("string").alias("custom_id"), F.lit("POST").alias("method"), body.alias("body"))).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    """One object a line, in as many files as there are partitions."""
    df.write.mode("overwrite").json(path)


def array_lines(df: DataFrame, order: list[Column]) -> DataFrame:
    """number, value: lines that make one JSON array of the rows, in an order, when they are put together by number."""
    rows = numbered(df.select("*", F.to_json(F.struct(*df.columns)).alias("_row")), order, "_number").select(F.col("_number").alias("number"), "_row")
    lines = rows.select("number", F.concat(F.when(F.col("number") == 1, "[").otherwise(","), F.col("_row")).alias("value"))
    end = rows.agg((F.count("*") + 1).alias("number")).select("number", F.when(F.col("number") == 1, "[]").otherwise("]").alias("value"))
    return lines.unionByName(end)


def write_json_array(df: DataFrame, path: str, order: list[Column]) -> None:
    """Text files that are one JSON array when they are put together in the order of their names."""
    lines = array_lines(df, order)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines.repartitionByRange(parts, "number").sortWithinPartitions("number").select("value").write.mode("overwrite").text(path)


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


# The exported case's fields that hold one of a few values, and the range of its score.
ENUMS = {"pearl_level": list(vocab.LEVELS), "label": ["YES", "NO", "AMBIGUOUS", "VALID", "INVALID", "CONDITIONAL"], "difficulty": vocab.DIFFICULTIES}
SCORE_RANGE = {"minimum": 0, "maximum": 10}


def json_schema(kind: DataType, nullable: bool = False) -> dict:
    """A Spark type as JSON Schema."""
    if isinstance(kind, StructType):
        out: dict = {"type": "object", "properties": {f.name: json_schema(f.dataType) for f in kind.fields}}
    elif isinstance(kind, ArrayType):
        out = {"type": "array", "items": json_schema(kind.elementType)}
    else:
        out = {"type": "boolean" if isinstance(kind, BooleanType) else "integer" if isinstance(kind, IntegralType) else "number" if isinstance(kind, NumericType) else "string"}
    return out | {"type": [out["type"], "null"]} if nullable else out


def case_schema_document() -> str:
    """JSON Schema (draft 07) of an exported case: types, the values that fields may have, and the fields that must be there."""
    kind = StructType.fromDDL(vocab.CASE_SCHEMA)
    filled = {*vocab.REQUIRED_FIELDS} - {"validator", "final_score"}
    properties = {f.name: json_schema(f.dataType, f.name not in filled) for f in kind.fields}
    for name, values in ENUMS.items():
        properties[name]["enum"] = values
    properties["final_score"] |= SCORE_RANGE
    # Variables may be plain texts too.
    for x in "XY":
        properties["variables"]["properties"][x] = {"oneOf": [{"type": "string"}, properties["variables"]["properties"][x]]}
    head = {"$schema": "http://json-schema.org/draft-07/schema#", "title": "Exported case", "type": "object", "minItems": vocab.LEAST_CASES}
    return json.dumps(head | {"properties": properties, "required": vocab.REQUIRED_FIELDS}, indent=2)


def markdown_table(df: DataFrame, most: int = 200) -> str:
    """A small result as a Markdown table; a result of more than most rows is refused, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report table holds {most} rows at most")
    line = lambda xs: "| " + " | ".join("" if x is None else str(x) for x in xs) + " |"
    return "\n".join([line(df.columns), line("---" for _ in df.columns), *(line(r) for r in rows)])


def latex_table(df: DataFrame, most: int = 200) -> str:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report table holds {most} rows at most")
    line = lambda xs: " & ".join("" if x is None else str(x).replace("_", "\\_").replace("%", "\\%") for x in xs) + " \\\\"
    return "\n".join([f"\\begin{{tabular}}{{{'l' * len(df.columns)}}}", line(df.columns), "\\hline", *(line(r) for r in rows), "\\end{tabular}"])


# The issues that a report counts, and the share of cases above which one asks for action.
REPORT_ISSUES = {"pearlLevelMismatch": 0.1, "trapTypeMismatch": 0.1, "groundTruthMismatch": 0.1, "hasAmbiguity": 0.2, "hasLogicalIssues": None, "hasDomainErrors": None}


def text_table(df: DataFrame, most: int = 200) -> str:
    """A small result as columns of text, each as wide as its longest value."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report table holds {most} rows at most")
    shown = [list(df.columns), *(["" if x is None else str(x) for x in r] for r in rows)]
    wide = [max(len(r[i]) for r in shown) for i in range(len(df.columns))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(r, wide, strict=True)).rstrip() for r in shown)


def report(title: str, sections: dict[str, DataFrame]) -> str:
    """Markdown of small result tables under headings."""
    return "\n\n".join([f"# {title}", *(f"## {name}\n\n{markdown_table(df)}" for name, df in sections.items())])


def evaluation_report(e: DataFrame, title: str = "Evaluation report", most: int = 50) -> str:
    """Markdown report of evaluated cases, in sections A to E.

    e: overallVerdict, pearlLevel, groundTruth, trapType, the mismatch and issue flags of REPORT_ISSUES, clarityScore,
    reportTags (a JSON array in text), priorityLevel, sourceCase, scenario, suggestedCorrections. Tables are worked out
    by Spark; of urgent cases the first most by name are listed, and how many there are is said.
    """
    total = e.count()
    if not total:
        return f"# {title}\n\nNo cases were evaluated.\n"
    share = lambda n: f"{n} ({n * 100 / total:.1f} %)"
    found = aggregates.report_sections(e, ["overallVerdict", "pearlLevel", "groundTruth", "trapType"], list(REPORT_ISSUES)).collect()
    table = lambda section: [f"| {x['name']} | {share(x['n'])} |" for x in sorted((x for x in found if x["section"] == section), key=lambda x: (-x["n"], x["name"] or ""))]
    n = {(x["section"], x["name"]): x["n"] for x in found}
    out = [f"# {title}", f"{total} cases evaluated.", "## (A) Structural check"]
    for section, name in (("overallVerdict", "Verdict"), ("pearlLevel", "Level"), ("groundTruth", "Label"), ("trapType", "Trap type"), ("issue", "Issue")):
        out.append("\n".join([f"| {name} | Cases |", "|---|---|", *table(section)]))
    clarity = e.agg(F.avg("clarityScore")).first()[0]
    out += [f"Mean clarity: {'-' if clarity is None else f'{clarity:.2f}'} of 5.", "## (B) Tags"]
    tags = aggregates.tag_counts(e, "reportTags").orderBy(F.col("n").desc(), "tag").limit(most).collect()
    out += ["\n".join(f"- {x['tag']}: {x['n']}" for x in tags) or "None.", "## (C) Cases to look at"]
    urgent = e.where(F.col("priorityLevel") == 1)
    rows = urgent.select("sourceCase", cases.shortened("scenario", 100).alias("scenario"), F.coalesce("suggestedCorrections", F.lit("")).alias("what")).orderBy("sourceCase").limit(most).collect()
    normal = e.where((F.col("priorityLevel") == 2) & ~F.col("overallVerdict").eqNullSafe("APPROVED")).count()
    out += [f"{urgent.count()} urgent.", "\n".join(f"- {x['sourceCase']}: {x['scenario']} {x['what']}".rstrip() for x in rows), f"{normal} for the usual review.", "## (D) Cell sizes"]
    cells = aggregates.cell_sizes(e, ["pearlLevel", "groundTruth"]).orderBy("cell").limit(most).collect()
    bad = sum(n.get(("overallVerdict", v), 0) for v in ("NEEDS_REVIEW", "REJECTED"))
    out += ["\n".join(f"- {x['cell']}: {x['n']}" + (" (under 30)" if x["n"] < 30 else "") for x in cells), f"With issues: {share(bad)}.", "## (E) Recommendations"]
    flags = {x["name"]: x["flagged"] for x in aggregates.issue_flags(e, {k: v for k, v in REPORT_ISSUES.items() if v}).collect()}
    out.append("\n".join(f"- {name}: {'above' if flagged else 'within'} its bound of {REPORT_ISSUES[name]:.0%}" for name, flagged in flags.items()))
    return "\n\n".join(x for x in out if x) + "\n"


def write_results(results: DataFrame, state: dict, path: str) -> None:
    """A scoring run's results, one object a line, and beside them its state as one JSON object."""
    write_json(results, f"{path}/results")
    write_state(results.sparkSession, state, f"{path}/state")


def write_state(spark: SparkSession, state: dict, path: str) -> None:
    """A job's state as one JSON object."""
    spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(path)
