"""Vectors of texts: hashed TF-IDF, and its leading directions by a randomised decomposition.

Rows stay sparse and where they are. A pass gives each task's part of a thin matrix, as many rows as there are hashed
places and a few columns; these parts are added up by Spark, a bounded number at a time, and only their sum, of a fixed
size, reaches the driver, where it is made orthonormal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.functions.cases import words
from casemill.operators.tables import settled

#: Hashed places of words, leading directions, further columns that make them sure, and rounds of sharpening.
PLACES, DIRECTIONS, EXTRA, ROUNDS = 4096, 32, 8, 3
#: Parts that one task adds up.
FAN = 32


def tfidf(df: DataFrame, key: str, text: str, places: int = PLACES) -> DataFrame:
    """key, at (places, in order), w (weights, of length one together) of each row; texts without words have none.

    A weight is 1 + log(count) times log((1 + n) / (1 + rows with it)) + 1, the words that share a place taken as one.
    A row is counted and weighed where it is: only how many rows have each place is added up. Rows with a null key are
    left out.
    """
    rows = df.where(F.col(key).isNotNull())
    placed = rows.select(F.col(key).alias("k"), F.transform(words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(places)).cast("int")).alias("u"))
    kind = rows.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                u = part.column(1)
                # Null texts have no places; a list's places are told from the next list's by its row.
                sizes = np.diff(u.offsets.to_numpy()) if u.null_count == 0 else np.array([len(x) if x is not None else 0 for x in u.to_pylist()])
                cells, tf = np.unique(np.repeat(np.arange(part.num_rows, dtype=np.int64), sizes) * places + u.flatten().to_numpy(), return_counts=True)
                offsets = pa.array(np.searchsorted(cells, np.arange(part.num_rows + 1, dtype=np.int64) * places), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(cells % places, pa.int32()), pa.array(tf, pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], names=["k", "at", "tf"])

    counts = settled(placed.mapInArrow(count, f"k {kind}, at array<int>, tf array<int>"), "tfidf")
    # As many rows as there are places at most.
    seen = np.zeros(places)
    for x in counts.select(F.explode("at").alias("at")).groupBy("at").agg(F.count("*").alias("n")).collect():
        seen[x["at"]] = x["n"]
    share = np.log((1 + counts.count()) / (1 + seen)) + 1

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, tf = _flat(batch, "tf")
            w = (1 + np.log(tf)) * share[at]
            norm = np.sqrt(np.bincount(row, w * w, batch.num_rows))
            offsets = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(at, pa.int32()), pa.array(w / norm[row], pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["k", "at", "w"])

    return counts.mapInArrow(weigh, f"k {kind}, at array<int>, w array<double>").withColumnRenamed("k", key)


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def _flat(batch: pa.RecordBatch, weight: str = "w") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and weight of every entry of a batch (at, w)."""
    at, w = (batch.column(batch.schema.get_field_index(c)) for c in ("at", weight))
    sizes = np.diff(at.offsets.to_numpy())
    return np.repeat(np.arange(batch.num_rows), sizes), at.flatten().to_numpy(), w.flatten().to_numpy()


def _dense(batch: pa.RecordBatch, places: int) -> np.ndarray:
    """The batch's rows as a matrix: products of dense blocks are far faster than additions entry by entry."""
    row, at, w = _flat(batch)
    out = np.zeros((batch.num_rows, places))
    out[row, at] = w
    return out


def _added(rows: DataFrame, each: Callable[[np.ndarray], np.ndarray], places: int, shape: tuple[int, int]) -> np.ndarray:
    """The sum of a matrix of each block of rows, given as a dense matrix, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for part in _slices(batch, 1024):
                total += each(_dense(part, places))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["task", "m"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x) for x in pdf["m"])
        return pd.DataFrame({"task": [int(pdf["task"].iloc[0]) // FAN], "m": [total.tobytes()]})

    parts = settled(rows.mapInArrow(run, "task long, m binary"), "embedding-parts")
    while parts.count() > FAN:
        parts = settled(parts.groupBy(F.expr(f"task div {FAN}").alias("g")).applyInPandas(add, "task long, m binary"), "embedding-parts")
    held = [np.frombuffer(bytes(x["m"])) for x in parts.orderBy("task").collect()]
    return np.sum(held, axis=0).reshape(shape) if held else np.zeros(shape)


def directions(rows: DataFrame, places: int = PLACES, k: int = DIRECTIONS, rounds: int = ROUNDS, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The k leading right singular vectors (places by k, orthonormal) and singular values of rows (at, w).

    Random columns are multiplied by the rows' products and made orthonormal, a few times; what is left is the
    decomposition of a matrix of k + EXTRA columns. Signs are such that a vector's largest entry is positive.
    """
    wide = min(places, k + EXTRA)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(places, wide)))[0]

    for _ in range(rounds):
        basis = np.linalg.qr(_added(rows, lambda x, b=basis: x.T @ (x @ b), places, (places, wide)))[0]
    inner = _added(rows, lambda x, b=basis: (y := x @ b).T @ y, places, (wide, wide))
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    order = np.argsort(-values)[:k]
    found = basis @ vectors[:, order]
    signs = np.sign(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])])
    return found * np.where(signs == 0, 1, signs), np.sqrt(np.maximum(values[order], 0))


def projected(rows: DataFrame, key: str, basis: np.ndarray, unit: bool = True) -> DataFrame:
    """key and the vector of each of rows (at, w) in the basis, of length one if unit and not zero."""
    kind = rows.schema[key].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(basis)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 1024):
                y = _dense(part, len(shared.value)) @ shared.value
                if unit:
                    norms = np.linalg.norm(y, axis=1, keepdims=True)
                    y = y / np.where(norms > 0, norms, 1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(key)), lists], names=["k", "v"])

    return rows.mapInArrow(run, f"k {kind}, v array<double>").select(F.col("k").alias(key), F.col("v").alias("embedding"))


def embedded(df: DataFrame, key: str, text: str, places: int = PLACES, k: int = DIRECTIONS) -> DataFrame:
    """key and embedding (k numbers, length one; zeros for a text without words) of each row of df with a key."""
    rows = settled(tfidf(df, key, text, places), "tfidf-rows")
    return projected(rows, key, directions(rows, places, k)[0])
