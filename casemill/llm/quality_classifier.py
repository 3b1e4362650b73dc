"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import map_batches
from casemill.llm.fitting import ROWS_PER_LABEL, Design, adam, graded, labelled_sample, row_score, sigmoid
from casemill.llm.ngrams import BITS, buckets
from casemill.llm.toxicity import held_out

STEPS, RATE, RIDGE = 50, 0.05, 1e-4
#: Parts of a shape ratio; each part is a bucket of its own after the n-grams.
PARTS = 16


def shape(text: str, n_buckets: int) -> list[int]:
    """Buckets for shares that lie between 0 and 1: distinct n-grams, words, lines; capitals and other marks."""
    words, lines = text.split(), text.split("\n")
    letters = sum(map(str.isalpha, text)) or 1
    shares = [
        n_buckets / (3 * len(text.encode("utf-8", "surrogatepass")) or 1),
        len(set(words)) / (len(words) or 1),
        len(set(lines)) / len(lines),
        sum(map(str.isupper, text)) / letters,
        1 - letters / (len(text) - text.count(" ") or 1),
    ]
    return [i * PARTS + min(PARTS - 1, max(0, int(x * PARTS))) for i, x in enumerate(shares)]


WIDTH = (1 << BITS) + 5 * PARTS


def features(text: str | None) -> np.ndarray:
    """Distinct buckets of a whole text: byte n-grams of 3 and 5, then the shape's."""
    found = buckets(text, (3, 5))
    return np.append(found, np.array(shape(text or "", len(found)), np.int32) + (1 << BITS)).astype(np.int32)


@dataclass
class Model:
    """Weights shared by all grades and ordered thresholds: P(grade > k) = sigmoid(score - threshold k)."""

    weights: np.ndarray
    thresholds: np.ndarray
    grades: np.ndarray

    def tails(self, text: str | None) -> np.ndarray:
        return sigmoid(row_score(features(text), self.weights) - self.thresholds)


def ordered(free: np.ndarray) -> np.ndarray:
    """Increasing thresholds from a first value and the logarithms of the steps."""
    return free[0] + np.append(0.0, np.cumsum(np.exp(free[1:])))


def fit(x: list[np.ndarray], y: np.ndarray, width: int = WIDTH) -> Model:
    """The model of rows of buckets with integer grades; of fewer than two grades, one with no threshold."""
    grades = np.unique(y)
    if len(grades) < 2:
        return Model(np.zeros(width, np.float32), np.empty(0), grades)
    rank, k = np.searchsorted(grades, y), len(grades) - 1
    # Common buckets say little: scale by the root of their inverse share of rows.
    seen = np.ones(width)
    for row in x:
        seen[row] += 1
    scale = np.sqrt(np.log1p(len(x) / seen))
    design, weight = Design(x, scale), 1.0 / (len(grades) * np.bincount(rank)[rank])
    above = (rank[:, None] > np.arange(k)).astype(float)

    def gradient(p: np.ndarray) -> np.ndarray:
        cuts = ordered(p[width:])
        z = design.dot(p[:width])[:, None] - cuts
        # A grade's likelihood is the difference of neighbouring tails; ends are 1 and 0.
        tail = np.concatenate([np.ones((len(y), 1)), sigmoid(z), np.zeros((len(y), 1))], axis=1)
        own = np.maximum(tail[np.arange(len(y)), rank] - tail[np.arange(len(y)), rank + 1], 1e-9)
        slope = tail * (1 - tail)
        low, high = slope[np.arange(len(y)), rank] / own * weight, slope[np.arange(len(y)), rank + 1] / own * weight
        by_cut = np.zeros((len(y), k))
        some = rank > 0
        by_cut[np.flatnonzero(some), rank[some] - 1] = low[some]
        some = rank < k
        by_cut[np.flatnonzero(some), rank[some]] -= high[some]
        to_cut = by_cut.sum(0)
        steps = np.array([to_cut[i:].sum() for i in range(1, k)]) * np.exp(p[width + 1 :])
        return np.concatenate([RIDGE * p[:width] - design.back(by_cut.sum(1)), [to_cut.sum()], steps])

    share = np.clip(above.mean(0), 0.02, 0.98)
    cuts = np.maximum.accumulate(np.log((1 - share) / share)) + 0.05 * np.arange(k)
    start = np.concatenate([np.zeros(width), cuts[:1], np.log(np.maximum(np.diff(cuts), 0.05))])
    p = adam(gradient, start, STEPS, RATE)
    return Model((p[:width] * scale).astype(np.float32), ordered(p[width:]), grades)


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", rows: int = ROWS_PER_LABEL, any_scale: bool = False) -> Model:
    """Fit on at most rows rated documents of each grade outside the held-out fold.

    Ratings of more than MOST_GRADES different values are refused; with any_scale they are cut at quantiles.
    """
    rated = labels.where(~held_out(F.col("doc_id")))
    return fit(*labelled_sample(docs, graded(rated, column) if any_scale else rated, column, features, rows))


def grade(docs: DataFrame, model: Model, tail: float = 0.5) -> DataFrame:
    """doc_id, held_out, expected_grade, tail_probability (of more than the lowest grade), predicted, selected.

    expected_grade sums grades by their probability; predicted is the grade with most probability (the lowest of
    ties); selected holds if the tail probability reaches tail. Null texts are graded as empty ones; with one
    grade every row gets it, and with none the grades are null and every row is selected. Other columns are dropped.
    """

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = model
        rows = []
        for text in batch.column(1).to_pylist():
            if not len(m.grades):
                rows.append((None, 1.0, None))
                continue
            tails = m.tails(text) if len(m.thresholds) else np.empty(0)
            p = -np.diff(np.concatenate([[1.0], tails, [0.0]]))
            rows.append((float(p @ m.grades), float(tails[0]) if len(tails) else 1.0, float(m.grades[int(p.argmax())])))
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.float64()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.float64())], names=["doc_id", "e", "t", "p"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = map_batches(docs.select("doc_id", F.col("text").cast("string").alias("text")), each, f"doc_id {kind}, e double, t double, p double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("e").alias("expected_grade"), F.col("t").alias("tail_probability"), F.col("p").alias("predicted"), (F.col("t") >= tail).alias("selected"))
