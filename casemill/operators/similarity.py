"""All pairs of vectors, block by block: matrix products of pairs of blocks.

Rows are dealt by a hash of their key into blocks of a bounded size, as many as the table needs; every pair of blocks is
a group of its own, so the quadratic work that a whole matrix asks for is spread evenly and no task holds more than two
blocks. A task multiplies strip by strip, so products stay in the processor's cache, and summaries leave a tile as a few
numbers, never as pairs. A row is sent to as many tiles as there are blocks: up to SPREAD * MOST_ROWS rows that is SPREAD
times, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a block at least, about, and at most; blocks that keep a small table's tasks busy; vectors of a strip.
BLOCK_ROWS, MOST_ROWS, SPREAD, STRIP = 1000, 16384, 16, 512


def blocks_of(n: int) -> int:
    """How many blocks n rows are dealt to; every row is sent as many times."""
    return max(1, min(SPREAD, ceil(n / BLOCK_ROWS)), ceil(n / MOST_ROWS))


def vectors(batches: list[pa.RecordBatch], column: str) -> np.ndarray:
    """The lists of a column as the rows of a matrix; null numbers are nan."""
    n = sum(b.num_rows for b in batches)
    flat = [b.column(b.schema.get_field_index(column)).flatten().to_numpy(zero_copy_only=False) for b in batches]
    return np.concatenate(flat).astype(float).reshape(n, -1) if n and sum(map(len, flat)) else np.empty((n, 0))


def values(batches: list[pa.RecordBatch], column: str) -> np.ndarray:
    return np.concatenate([b.column(b.schema.get_field_index(column)).to_numpy(zero_copy_only=False) for b in batches])


def strips(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Rows of x, rows of y and their products, strip by strip."""
    for i in range(0, len(x), STRIP):
        for j in range(0, len(y), STRIP):
            a, b = slice(i, i + STRIP), slice(j, j + STRIP)
            yield a, b, x[a] @ y[b].T


def _tiles(df: DataFrame, key: str, vector: str, each: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None], list], schema: str) -> DataFrame:
    """each(keys of rows, keys of columns, products, which count) of all pairs of each tile, as columns of the result.

    Of two blocks all products count (None), as equal keys are in one block; inside a block those whose row's key is the
    smaller. Rows with a null key or vector have no pairs.
    """
    rows = df.select(F.col(key).alias("k"), F.col(vector).alias("v")).where(F.col("k").isNotNull() & F.col("v").isNotNull())
    blocks = blocks_of(rows.count())
    own = F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    names = [x.split()[0] for x in schema.split(", ")]

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        k, v, at = values(held, "k"), vectors(held, "v"), values(held, "own")
        one = held[0].column(held[0].schema.get_field_index("low"))[0].as_py()
        single = one == held[0].column(held[0].schema.get_field_index("high"))[0].as_py()
        first = at == one
        del held
        ka, kb = (k, k) if single else (k[first], k[~first])
        for a, b, s in strips(*((v, v) if single else (v[first], v[~first]))):
            found = each(ka[a], kb[b], s, ka[a][:, None] < kb[b][None, :] if single else None)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=names)

    return dealt.select("k", "v", "own", low.alias("low"), high.alias("high")).groupBy("low", "high").applyInArrow(tile, schema)


def summary(df: DataFrame, key: str, vector: str, near: float = 0.85) -> DataFrame:
    """One row: pairs, mean, deviation (of all pairs), near (pairs above a similarity), least and greatest."""

    def each(_a: np.ndarray, _b: np.ndarray, s: np.ndarray, counts: np.ndarray | None) -> list:
        s = s.ravel() if counts is None else s[counts]
        ends = ([float(s.min())], [float(s.max())]) if len(s) else (pa.nulls(1, pa.float64()), pa.nulls(1, pa.float64()))
        return [[len(s)], [float(s.sum())], [float(s @ s)], [int(np.count_nonzero(s > near))], *ends]

    parts = _tiles(df, key, vector, each, "n long, one double, two double, near long, low double, high double")
    n, one, two = F.sum("n"), F.sum("one"), F.sum("two")
    mean = F.try_divide(one, n)
    spread = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(two, n) - mean * mean))
    return parts.agg(F.coalesce(n, F.lit(0)).alias("pairs"), mean.alias("mean"), spread.alias("deviation"), F.coalesce(F.sum("near"), F.lit(0)).alias("near"), F.min("low").alias("least"), F.max("high").alias("greatest"))


def _edges(low: float, high: float, bins: int, digits: int) -> list[float]:
    """The least double of each bin but the first; bins rise with the similarity, so these say all.

    Found by halving: comparing products with them counts the same as rounding and binning each product.
    """
    if not high > low:
        # All products belong to one bin, the first.
        return [np.inf] * (bins - 1)
    bin_of = lambda x: min(bins - 1, np.floor((np.round(np.float64(x), digits) - low) * bins / (high - low)))
    found = []
    for k in range(1, bins):
        under, over = low - 1.0, high + 1.0
        while (middle := (under + over) / 2) not in (under, over):
            under, over = (under, middle) if bin_of(middle) >= k else (middle, over)
        found.append(float(over))
    return found


def histogram(df: DataFrame, key: str, vector: str, bins: int = 50, digits: int = 9) -> DataFrame:
    """Pairs by equal bins between the least and greatest similarity, rounded; the greatest belongs to the last bin."""
    ends = summary(df, key, vector).select("least", "greatest").first()
    if ends["least"] is None:
        return df.sparkSession.createDataFrame([], "bin long, n long")
    low, high = round(ends["least"], digits), round(ends["greatest"], digits)

    edges = _edges(low, high, bins, digits)

    def each(_a: np.ndarray, _b: np.ndarray, s: np.ndarray, counts: np.ndarray | None) -> list:
        s = s.ravel() if counts is None else s[counts]
        above = np.array([len(s), *(np.count_nonzero(s >= x) for x in edges), 0])
        n = above[:-1] - above[1:]
        return [np.flatnonzero(n), n[n > 0]]

    return _tiles(df, key, vector, each, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))


def pairs_above(df: DataFrame, key: str, vector: str, least: float) -> DataFrame:
    """a, b, similarity of all pairs above a similarity, the smaller key as a; only these leave a tile."""

    def each(a: np.ndarray, b: np.ndarray, s: np.ndarray, counts: np.ndarray | None) -> list:
        at = np.flatnonzero(s > least if counts is None else (s > least) & counts)
        x, y = a[at // len(b)], b[at % len(b)]
        return [np.minimum(x, y), np.maximum(x, y), s.ravel()[at]]

    kind = df.schema[key].dataType.simpleString()
    return _tiles(df, key, vector, each, f"a {kind}, b {kind}, similarity double")
