"""A memo kept between runs.

An expensive function of a text is computed once for each distinct text, ever:
results live in a table on the shared file system, keyed by a 256-bit hash of
the text and laid out in hash buckets. A run joins its distinct texts against
the committed table, computes the misses, and commits them as one new version.

A version is a Parquet folder that counts from the moment its name is in the
version list, an empty file created in one step. A run that dies before that
leaves a folder that nobody reads; runs at the same time add a version each.
Failures (NULL results) are remembered too.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import hot_cold_join, text_key

BUCKETS = 64
_SCHEMA = "key string, value {kind}, version string, bucket int"


class Memo:
    """Results of one function at ``root``; ``kind`` is their Spark type."""

    def __init__(self, spark: SparkSession, root: str, kind: str = "string", buckets: int = BUCKETS):
        self.spark, self.root, self.kind, self.buckets = spark, root.rstrip("/"), kind, buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[str]:
        """Folders of the committed versions."""
        log = self._path(f"{self.root}/_versions")
        if not self._fs.exists(log):
            return []
        return sorted(f"{self.root}/{f.getPath().getName()}" for f in self._fs.listStatus(log))

    def table(self) -> DataFrame:
        """(key, value, version, bucket) of all committed versions."""
        return self._read(self.versions())

    def _read(self, folders: list[str]) -> DataFrame:
        schema = _SCHEMA.format(kind=self.kind)
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.root).parquet(*folders)

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _commit(self, folder: str) -> None:
        self._fs.create(self._path(f"{self.root}/_versions/{folder.rsplit('/', 1)[1]}"), False).close()

    def extend(self, texts: DataFrame, column: str, fn: Callable[[Column], Column]) -> DataFrame:
        """Make sure that every text of ``column`` has a result: ``fn`` runs on
        the distinct texts that no committed version holds, and only there.
        Returns the new rows (empty if there were none)."""
        named = texts.groupBy(text_key(F.col(column)).alias("key")).agg(F.min(column).alias("_text"))
        named = named.withColumn("bucket", self.bucket(F.col("key")))
        # both sides carry the bucket, so a run with few texts reads few buckets
        misses = named.join(self.table().select("key", "bucket"), ["key", "bucket"], "left_anti")
        new = misses.select("key", fn(F.col("_text")).cast(self.kind).alias("value"), "bucket")
        folder = f"{self.root}/version={uuid.uuid4().hex}"
        new.repartition("bucket").write.partitionBy("bucket").parquet(folder)
        added = self._read([folder])
        if added.isEmpty():
            self._fs.delete(self._path(folder), True)
            return self._read([])
        self._commit(folder)
        return added

    def results(self, df: DataFrame, column: str, out: str) -> DataFrame:
        """``df`` with the remembered result of ``column`` (NULL if unknown or
        failed). Rows meet their result on the hash; hot texts are joined
        apart. Two runs that computed a text at the same time left equal rows."""
        keyed = df.withColumn("_k", text_key(F.col(column)))
        values = keyed.groupBy("_k").agg(F.count(F.lit(1)).alias("_n")).join(
            self.table().groupBy(F.col("key").alias("_k")).agg(F.min("value").alias(out)), "_k")
        return hot_cold_join(keyed, values, "_k", "_n").drop("_k")

    def apply(self, df: DataFrame, column: str, fn: Callable[[Column], Column], out: str) -> DataFrame:
        """J7 across runs: compute what is new, commit it, fan back."""
        self.extend(df.select(column), column, fn)
        return self.results(df, column, out)
