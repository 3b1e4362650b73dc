"""A table kept in buckets of its key, of which a change rewrites only those that it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.operators.mutations import upserted
from casemill.operators.tables import settled

BUCKET = "_bucket"


class BucketedTable:
    """A Parquet folder for each bucket; a row's bucket is a hash of its key, so that a key's row is always found in one."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64) -> None:
        if buckets < 1:
            raise ValueError("buckets is 1 or more")
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def create(self, df: DataFrame) -> None:
        """Write all of df; a key has one row."""
        df.withColumn(BUCKET, self._bucket()).repartition(self.buckets, BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(self.path)

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The table, or some of its buckets, whose folders alone are read."""
        rows = self.spark.read.parquet(self.path)
        return (rows if buckets is None else rows.where(F.col(BUCKET).isin(buckets))).drop(BUCKET)

    def touched(self, changes: DataFrame) -> list[int]:
        """The buckets of the changes' keys: at most as many as there are buckets."""
        return sorted(x["b"] for x in changes.select(self._bucket().alias("b")).distinct().collect())

    def upsert(self, changes: DataFrame) -> list[int]:
        """Put rows in, or their values that are not null over those of their key; the buckets that were rewritten.

        Only changes that change something count: a row that is there just so touches no bucket. changes has one row a key.
        """
        changes = settled(changes, "changes")
        old = self.read(self.touched(changes))
        same = [F.col(f"c.{c}").isNull() | F.col(f"c.{c}").eqNullSafe(F.col(f"o.{c}")) for c in changes.columns if c != self.key]
        joined = changes.alias("c").join(old.alias("o"), F.col(f"c.{self.key}") == F.col(f"o.{self.key}"), "left")
        alike = F.col(f"o.{self.key}").isNotNull()
        for x in same:
            alike = alike & x
        return self._rewritten(joined.where(~alike).select("c.*"), lambda rows, new: upserted(rows, new, self.key))

    def delete(self, keys: DataFrame) -> list[int]:
        """Take the keys' rows out; the buckets that were rewritten."""
        keys = keys.select(self.key).distinct()
        found = self.read(self.touched(keys)).select(self.key).join(keys, self.key, "left_semi")
        return self._rewritten(found, lambda rows, gone: rows.join(gone, self.key, "left_anti"))

    def _rewritten(self, changes: DataFrame, change) -> list[int]:
        changes = settled(changes, "changes")
        at = self.touched(changes)
        if not at:
            return at
        rows = self.read(at)
        # Written elsewhere first: what is read is about to be replaced.
        new = settled(change(rows, changes).select(rows.columns).withColumn(BUCKET, self._bucket()), "buckets")
        gone = sorted(set(at) - {x[BUCKET] for x in new.select(BUCKET).distinct().collect()})
        writer = new.repartition(len(at), BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(BUCKET).parquet(self.path)
        for b in gone:
            self._drop(b)
        return at

    def _drop(self, bucket: int) -> None:
        """A bucket without rows left: nothing is written over its folder, which goes."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{BUCKET}={bucket}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
