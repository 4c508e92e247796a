"""Helpers shared by the training-data operators.

Lineage is cut with Parquet tables written under ``spark.checkpoint.dir``,
the folder that driver and executors share, so a lost executor never loses
an intermediate result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import with_row_index
from ..session import scratch_folder

#: White space of the word rule (fixed value): space and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"
#: One word: a run without that white space (fixed value).
WORD = r"[^\x20\x09-\x0D]+"


class Scratch:
    """Intermediate tables of one operator call in the shared folder.

    ``save`` writes a table and returns it re-read. ``drop`` removes tables
    whose rows have been consumed by a later one.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = scratch_folder(spark, name)

    def save(self, df: DataFrame, tag: str) -> DataFrame:
        path = f"{self.root}/{tag}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tags: str) -> None:
        for tag in tags:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{tag}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def columns(df: DataFrame, **wanted: str | Column) -> DataFrame:
    """Only the named inputs, under internal names, so that extra columns of
    the input can never clash with an operator's own."""
    return df.select([(df[c] if isinstance(c, str) else c).alias(n) for n, c in wanted.items()])


def held_out(doc_id: str | Column) -> Column:
    """True for the rows no label may be learnt from: crc32 of the id as text
    leaves 1 when divided by 3. A null id is not held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % 3 == 1, F.lit(False))


def bounded_sample(ids: DataFrame, key: str, limit: int, seed: int = 0) -> DataFrame:
    """At most ``limit`` rows with the smallest seeded hash of ``key``: the
    documented bound of a classifier's training rows. A top-k, so no task
    holds more than ``limit`` rows, and small enough to broadcast."""
    return ids.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key)).limit(limit)


def ranked(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """0-based gapless rank inside ``group`` without collecting a group into
    one task: a global range-sorted index minus the group's first index.
    The table of first indexes has one row per group."""
    pos = with_row_index(df, [*group, *order], "_pos")
    first = (pos.groupBy(*group).agg(F.min("_pos").alias("_first"))
             .select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_first"))
    cond = F.lit(True)
    for i, g in enumerate(group):
        cond = cond & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return pos.join(first, cond).select(*df.columns, (F.col("_pos") - F.col("_first")).alias(name))


def words_size(text: str | Column) -> Column:
    """Number of words of a text; null counts as empty."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


Query = Callable[[SparkSession, str], DataFrame]
