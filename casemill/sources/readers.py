"""Readers of case files: tables, JSON arrays, folders, batch responses and seeds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from casemill.functions.cases import json_in_text
from casemill.operators.mutations import upserted
from casemill.operators.tables import settled

SEED_SCHEMA = (
    "sourceCase string, scenario string, claim string, pearlLevel string, domain string, subdomain string, trapType string, trapSubtype string, "
    "difficulty string, groundTruth string, variables struct<X:string,Y:string,Z:array<string>>, causalStructure string, keyInsight string, "
    "explanation string, wiseRefusal string"
)
SCORES_SCHEMA = "scenarioClarityScore double, wiseRefusalScore double, difficultyCalibrationScore double, finalLabelScore double, trapTypeScore double, hiddenQuestionScore double, conditionalAnswerAScore double, conditionalAnswerBScore double, notes string"
RESPONSE_SCHEMA = "custom_id string, error struct<message:string>, response struct<body:struct<choices:array<struct<message:struct<content:string>>>>>"
IDEA_SCHEMA = "id string, topic string, subdomain string, entities array<string>, timeframe string, event string, context string, difficulty string"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A Parquet table of a folder, or some of its columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def jdbc_table(spark: SparkSession, url: str, name: str, key: str | None = None, rows_per_read: int = 1_000_000, **options: str) -> DataFrame:
    """A table of a relational store whose driver is on the class path.

    With a whole-number key the table is read in ranges of it, about so many rows each, side by side: the store is
    asked for the key's bounds first. Without one, or of an empty table, it is one read.
    """
    read = lambda **more: spark.read.format("jdbc").options(url=url, **options, **more).load()
    if key is None:
        return read(dbtable=name)
    low, high, n = read(query=f"SELECT MIN({key}) AS LOW, MAX({key}) AS HIGH, COUNT(*) AS N FROM {name}").first()
    if not n or low is None:
        return read(dbtable=name)
    parts = max(1, -(-int(n) // rows_per_read))
    return read(dbtable=name, partitionColumn=key, lowerBound=str(int(low)), upperBound=str(int(high) + 1), numPartitions=str(parts))


def json_cases(spark: SparkSession, path: str | list[str], schema: str, wrapper: str = "questions", source_file: bool = False) -> DataFrame:
    """Rows of JSON files that hold an array of rows, or an object with the array under wrapper; with source_file, tagged with the file's name."""
    read = spark.read.option("multiLine", True).schema(f"{wrapper} array<struct<{_struct(schema)}>>, {schema}").json(path)
    tag = [F.col("_metadata.file_name").alias("source_file")] if source_file else []
    names = [f.name for f in StructType.fromDDL(schema).fields]
    own = F.array(F.struct(*[F.col(f"`{x}`") for x in names]))
    rows = read.select(F.explode(F.coalesce(F.col(wrapper), own)).alias("row"), *tag)
    return rows.select("row.*", *(["source_file"] if source_file else []))


def _struct(schema: str) -> str:
    """A column list as fields of a struct: the blank after each name at the top becomes a colon."""
    return ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in StructType.fromDDL(schema).fields)


def json_folder(spark: SparkSession, folder: str, schema: str, skip: str = "combined") -> DataFrame:
    """Rows of a folder's JSON files whose names lack skip, tagged with source_file; of the skipped ones if the others have no rows.

    Files hold arrays, or objects with the array under questions. Which files count is decided when the rows are read.
    """
    rows = json_cases(spark, f"{folder}/*.json", schema, source_file=True)
    combined = F.contains(F.lower(F.col("source_file")), F.lit(skip))
    others = rows.where(~combined).limit(1).agg(F.count("*")).scalar()
    return rows.where(~combined | (others == 0))


def author_of(source_file: Column, authors: dict[str, str], default: str = "Unknown") -> Column:
    """The author whose key the file's name holds."""
    out = F.lit(default)
    for key, name in reversed(list(authors.items())):
        out = F.when(F.contains(F.lower(source_file), F.lit(key.lower())), name).otherwise(out)
    return out


def named_author(email: Column, names: dict[str, str], default: str = "Unknown") -> Column:
    """The name that belongs to an e-mail address, or the address itself; the default without one."""
    out = F.coalesce(F.nullif(email, F.lit("")), F.lit(default))
    for key, name in names.items():
        out = F.when(email == key, name).otherwise(out)
    return out


def parsed_responses(raw: DataFrame, schema: str = SCORES_SCHEMA) -> DataFrame:
    """custom_id, failed, and the fields of the JSON in each batch response's content; nulls where there is none."""
    content = F.get(F.col("response.body.choices"), F.lit(0))["message"]["content"]
    body = F.from_json(F.regexp_extract(content, "(?s)\\{.*\\}", 0), schema)
    return raw.select("custom_id", (F.col("error").isNotNull() | content.isNull()).alias("failed"), body.alias("_body")).select("custom_id", "failed", "_body.*")


def batch_responses(spark: SparkSession, path: str) -> DataFrame:
    """Scores of batch response files, one JSON object a line; lines that can't be read are left out."""
    return parsed_responses(spark.read.schema(RESPONSE_SCHEMA).option("mode", "DROPMALFORMED").json(path))


def seed_cases(spark: SparkSession, path: str) -> DataFrame:
    return json_cases(spark, path, SEED_SCHEMA)


def with_seeds(questions: DataFrame, seeds: DataFrame, key: str = "sourceCase") -> DataFrame:
    """questions with seed cases put in, or over the row of the same key; nested fields are held as JSON texts, and columns that questions lacks are left out."""
    flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, StructType) else F.col(f.name) for f in seeds.schema.fields if f.name in questions.columns]
    return upserted(questions, seeds.dropDuplicates([key]).select(*flat), key)


def ideas(answers: DataFrame, column: str = "answer") -> DataFrame:
    """Seeds in the JSON array that a free answer holds, with defaults for what they lack; an unreadable answer gives none."""
    found = answers.select(F.explode(json_in_text(column, f"struct<{_struct(IDEA_SCHEMA)}>")).alias("s")).select("s.*")
    return found.fillna({"topic": "", "subdomain": "", "timeframe": "", "event": "", "context": "", "difficulty": "medium"}).withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))


class Snapshot:
    """Rows that are loaded once and read as a view until they are refreshed: seeds that many requests share.

    A snapshot is a table in the shared folder, so that no memory holds it; queries at work go on reading the one they
    began with when a new one takes its place.
    """

    def __init__(self, spark: SparkSession, name: str, load: Callable[[], DataFrame]) -> None:
        self.spark, self.name, self.load, self.n = spark, name, load, None

    def rows(self) -> DataFrame:
        """The rows as they were last loaded."""
        if self.n is None:
            self.refresh()
        return self.spark.table(self.name)

    def refresh(self) -> int:
        """Load anew and put the view over what was loaded; how many rows there are. If loading fails, the old rows stay."""
        new = settled(self.load(), f"snapshot-{self.name}")
        n = new.count()
        new.createOrReplaceTempView(self.name)
        self.n = n
        return n

    def clear(self) -> None:
        """Forget the rows; the next reader loads them."""
        self.spark.catalog.dropTempView(self.name)
        self.n = None
