"""Bounded labelled samples and sparse linear algebra for the classifiers trained here."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casemill.llm.common import map_batches

#: Most labelled rows of each class or grade that a fit uses: a fixed bound, taken in the order of a hash of doc_id.
ROWS_PER_LABEL = 1000

#: Most bytes of these rows' texts for each class or grade: rows past it, in the same order, are left out of the fit.
BYTES_PER_LABEL = 32_000_000
#: Longest rating scale; graded() brings ratings of more different values to it.
MOST_GRADES = 100


def graded(labels: DataFrame, column: str) -> DataFrame:
    """Labels (doc_id, and the column, the greatest of each doc_id, nulls dropped) on a scale of at most MOST_GRADES values.

    A scale of more is cut at quantiles of the labels, and a grade is the mean of the labels between two cuts.
    """
    clean = labels.select("doc_id", F.col(column).cast("double").alias("y")).dropna().groupBy("doc_id").agg(F.max("y").alias("y"))
    if clean.select("y").distinct().limit(MOST_GRADES + 1).count() <= MOST_GRADES:
        return clean.withColumnRenamed("y", column)
    shares = F.array(*[F.lit(i / MOST_GRADES) for i in range(MOST_GRADES)])
    cuts = sorted(set(clean.agg(F.percentile_approx("y", shares, 10_000)).first()[0]))
    binned = clean.withColumn("bin", F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("y"))))
    means = binned.groupBy("bin").agg(F.avg("y").alias("grade"))
    return binned.join(F.broadcast(means), "bin").select("doc_id", F.col("grade").alias(column))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, features: Callable[[str | None], np.ndarray], rows: int = ROWS_PER_LABEL) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature buckets and labels of a bounded sample of labelled documents.

    The labels (one value per doc_id: the greatest; nulls dropped; numbers of any kind) are cut to rows per value
    first, so the join with docs broadcasts a table of a fixed size and no text is shuffled; of those rows a value's
    texts are taken up to BYTES_PER_LABEL, the first always. Of repeated documents each row counts.
    """
    clean = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("double").alias("y")).dropna().groupBy("doc_id").agg(F.max("y").alias("y"))
    values = sorted(x["y"] for x in clean.select("y").distinct().limit(MOST_GRADES + 1).collect())
    if len(values) > MOST_GRADES:
        raise ValueError(f"labels have more than {MOST_GRADES} different values")
    parts = [clean.where(F.col("y") == F.lit(v)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for v in values]
    if not parts:
        return [], np.empty(0)
    chosen = parts[0]
    for part in parts[1:]:
        chosen = chosen.union(part)
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    sizes = held.select("doc_id", "y", size.alias("size")).groupBy("doc_id", "y").agg(F.sum("size").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = sizes.withColumn("before", before).where((F.col("before") == 0) | (F.col("before") + F.col("size") <= BYTES_PER_LABEL)).select("doc_id")
    held = held.join(F.broadcast(within), "doc_id", "left_semi").select("doc_id", "y", "text")

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [features(x) for x in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "y", "x"])

    table = map_batches(held, each, "doc_id long, y double, x array<int>").toArrow()
    order = np.lexsort((table["y"].to_numpy(), table["doc_id"].to_numpy()))
    x = table["x"].combine_chunks()
    flat, offsets = (x.values.to_numpy(), x.offsets.to_numpy()) if len(x) else (np.empty(0, np.int32), np.zeros(1, np.int32))
    return [flat[offsets[i] : offsets[i + 1]] for i in order], table["y"].to_numpy()[order]


class Design:
    """Rows of distinct buckets, each row scaled to length one after weighting by a value per bucket.

    Products go over a block of entries at a time, so that they need little memory beside the entries.
    """

    BLOCK = 1 << 19

    def __init__(self, rows: list[np.ndarray], scale: np.ndarray) -> None:
        sizes = np.array([len(x) for x in rows], np.int32)
        self.n, self.width = len(rows), len(scale)
        self.at = np.concatenate(rows) if len(rows) else np.empty(0, np.int32)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        self.value = scale.astype(np.float32)[self.at]
        self.value /= np.sqrt(np.maximum(sizes, 1)).astype(np.float32)[self.row]

    def _blocks(self) -> list[slice]:
        return [slice(i, i + self.BLOCK) for i in range(0, len(self.at), self.BLOCK)]

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        for s in self._blocks():
            out += np.bincount(self.row[s], self.value[s] * w[self.at[s]], self.n)
        return out

    def back(self, e: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width)
        for s in self._blocks():
            out += np.bincount(self.at[s], self.value[s] * e[self.row[s]], self.width)
        return out


def adam(gradient: Callable[[np.ndarray], np.ndarray], start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Parameters after some steps of Adam with full gradients."""
    p, m, v = start.astype(float), np.zeros(len(start)), np.zeros(len(start))
    for t in range(1, steps + 1):
        g = gradient(p)
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return p


def row_score(buckets: np.ndarray, weights: np.ndarray) -> float:
    """The score of one row for weights that hold each bucket's scale already."""
    return float(weights[buckets].sum() / np.sqrt(max(len(buckets), 1)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
