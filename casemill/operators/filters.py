"""Row filters of the case store, built as predicates that reach the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where_equal(df: DataFrame, **wanted: object) -> DataFrame:
    """All given columns equal; None and 'all' ask nothing; a list asks for any of its values."""
    tests = [F.col(k).isin(list(v)) if isinstance(v, list | tuple | set) else F.col(k) == F.lit(v) for k, v in wanted.items() if v is not None and v != "all"]
    return df.where(reduce(Column.__and__, tests, F.lit(True)))


def where_any(df: DataFrame, values: list, *columns: str) -> DataFrame:
    """One of the columns holds one of the values."""
    return df.where(reduce(Column.__or__, [F.col(c).isin(values) for c in columns], F.lit(False)))


def where_score(df: DataFrame, band: str, column: str) -> DataFrame:
    """low: below 6; medium: 6 up to 8; high: 8 or more; all: every row."""
    c = F.col(column)
    return df.where({"low": c < 6, "medium": (c >= 6) & (c < 8), "high": c >= 8, "all": F.lit(True)}[band])


def missing(column: str) -> Column:
    """Null or empty."""
    return F.col(column).isNull() | (F.col(column) == "")


def accepted(df: DataFrame, column: str, least: float = 8) -> DataFrame:
    return df.where(F.col(column).isNotNull() & (F.col(column) >= least))


def lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row of a key, at most one."""
    return df.where(F.col(key) == F.lit(value)).limit(1)


#: Orders that a page can be asked for, by name.
SORTS = {
    "newest": lambda: [F.col("createdAt").desc()],
    "oldest": lambda: [F.col("createdAt").asc()],
    "level": lambda: [F.col("pearlLevel").asc()],
    "level-asc": lambda: [F.col("pearlLevel").asc()],
    "level-desc": lambda: [F.col("pearlLevel").desc()],
    "groundTruth": lambda: [F.col("groundTruth").asc()],
    "domain": lambda: [F.col("domain").asc()],
    "trap": lambda: [F.col("trapType").asc()],
    "difficulty": lambda: [F.col("difficulty").asc()],
}


def page(df: DataFrame, order: list[Column], limit: int = 500, offset: int = 0, most: int = 500) -> DataFrame:
    """Rows offset up to offset + limit in an order; order must end in a unique column, and a page holds at most most rows."""
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset are 0 or more")
    return df.orderBy(*order).offset(offset).limit(min(limit, most))


def drawn_order(key: str, seed: int) -> list[Column]:
    """An order drawn by a hash of key and seed, ties by key: the sort called random."""
    return [F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), F.col(key)]


def shuffled(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in an order drawn by a hash of key and seed."""
    return df.orderBy(*drawn_order(key, seed)).limit(n)


def sorted_page(df: DataFrame, sort: str, key: str, limit: int = 500, offset: int = 0, seed: int = 0) -> DataFrame:
    """A page in one of the named orders or, for random, in an order drawn by the seed; unknown names mean newest."""
    order = drawn_order(key, seed) if sort == "random" else [*SORTS.get(sort, SORTS["newest"])(), F.col(key)]
    return page(df, order, limit, offset)
