"""Toxicity: a linear classifier of character n-grams, inside words, scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import map_batches
from casemill.llm.fitting import ROWS_PER_LABEL, Design, adam, labelled_sample, row_score, sigmoid
from casemill.llm.ngrams import WORD_BITS, word_grams

#: One row in FOLDS is held out of training.
FOLDS = 5
STEPS, RATE, RIDGE = 100, 0.05, 1e-4


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        return float(sigmoid(np.float64(row_score(word_grams(text), self.weights) + self.bias)))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, bits: int = WORD_BITS) -> np.ndarray:
    """Per bucket, the log ratio of its smoothed share of toxic rows to that of others."""
    both = []
    for label in (1, 0):
        own = [x for x, v in zip(rows, y, strict=True) if v == label]
        counts = np.zeros(1 << bits)
        for x in own:  # a row's buckets are distinct
            counts[x] += 1
        both.append((counts + 1.0) / (len(own) + 2.0))
    return np.log(both[0] / both[1])


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS_PER_LABEL) -> Model:
    """Fit on at most rows labelled documents of each class outside the held-out fold; a label above 0 is toxic.

    With no labelled rows, or of one class only, the model is constant: 0.5 is never reached without toxic rows
    and always with nothing else.
    """
    marked = labels.select("doc_id", (F.col("toxic").cast("double") > 0).cast("int").alias("toxic"))
    x, y = labelled_sample(docs, marked.where(~held_out(F.col("doc_id"))), "toxic", word_grams, rows)
    y = y.astype(np.int64)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(1 << WORD_BITS, np.float32), 5.0 if len(y) and y[0] else -5.0)
    ratio = log_count_ratios(x, y)
    design, weight = Design(x, ratio), np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)

    def gradient(p: np.ndarray) -> np.ndarray:
        e = (sigmoid(design.dot(p[:-1]) + p[-1]) - y) * weight
        return np.append(design.back(e) + RIDGE * p[:-1], e.sum())

    p = adam(gradient, np.zeros(len(ratio) + 1), STEPS, RATE)
    return Model((p[:-1] * ratio).astype(np.float32), float(p[-1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs, whole texts.

    Null texts score as empty ones; both get the model's bias. Repeated rows are scored each; a null doc_id
    counts as the empty text in the fold's checksum. Other columns are dropped.
    """

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([model.score(x) for x in batch.column(1).to_pylist()], float)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = map_batches(docs.select("doc_id", F.col("text").cast("string").alias("text")), each, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, rows: int = ROWS_PER_LABEL) -> DataFrame:
    """The rows of docs that a model trained on labels doesn't predict toxic, columns unchanged."""
    model = train(docs, labels, rows)
    names = docs.columns

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = [model.score(x) < 0.5 for x in batch.column(names.index("text")).to_pylist()]
        return batch.filter(pa.array(keep, pa.bool_()))

    return map_batches(docs, each, docs.schema)
