"""Documents with every awkward case, and small tables for the training-data operators."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that operators use inside, as further columns of the input.
CLASHING = "key h fp line lines raw words id node row label size bucket shard slot w n a b u v root first component_id piece start length score kept copy of bad_id text_crc32".split()


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    made = ["".join(draw.choice("bcdfglmnprst") + draw.choice("aeiou") for _ in range(draw.randint(1, 4))) for _ in range(400)]
    return " ".join(draw.choice(made) for _ in range(n))


def awkward(spark: SparkSession) -> DataFrame:
    """Null, empty, blank, wordless, repeated, very long and odd texts; null and repeated ids; clashing columns."""
    base, long = prose(1, 120), prose(2, 60_000)
    texts = [
        None, "", " \n\t ", "...", base, base, base + " extra", base.replace(" ", "  ", 3), long, long + " end", "one", "two words", "a\n" * 400,
        "naïve café ÜBER straße 中文 текст \U0001f600 " * 12, "x" * 50_000, "the of and " * 30, "\n".join(prose(3, 20) for _ in range(3)),
    ]
    rows = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)]
    rows += [(4, base, "en", "src", len(base)), (None, base, None, None, None), (None, None, None, None, None), (100, prose(9, 80), None, "src", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(c) for c in CLASHING})


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def documents(spark: SparkSession, texts: list) -> DataFrame:
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
