"""Input order without a sort.

The place of a row in its input is (file, split start, place in the split).
Spark's file readers give the first two as metadata; inside a split rows keep
their order, so the third follows from the monotonic id. Rows are counted
once per split; a split's first position is the sum of the counts before it.
That table has one row for each split, which the driver plans anyway.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

_FILE, _START, _ID = "_file", "_start", "_id"


def tagged(df: DataFrame) -> DataFrame:
    """Rows straight from a file reader with their file, split and an id that
    rises inside the split."""
    return df.select("*", F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.file_block_start").alias(_START),
                     F.monotonically_increasing_id().alias(_ID))


def with_input_position(df: DataFrame, name: str = "position") -> DataFrame:
    """0-based position of every row in the input: files by path, rows of a
    file in its order. ``df`` comes straight from ``spark.read`` (text, JSON
    lines, CSV, Parquet); the texts themselves are not exchanged.

    The counts come from a scan of their own that reads no column it does not
    need; they are saved, so a rerun after a lost executor sees the same."""
    ensure_checkpoint_dir(df.sparkSession)
    rows = tagged(df)
    splits = (rows.groupBy(_FILE, _START).agg(F.count(F.lit(1)).alias("n"), F.min(_ID).alias("first"))
              .checkpoint(eager=True))
    before = Window.orderBy(_FILE, _START).rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(F.col(_FILE).alias("_f"), F.col(_START).alias("_s"),
                           (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("_shift"))
    here = (F.col(_FILE) == F.col("_f")) & (F.col(_START) == F.col("_s"))
    return (rows.join(F.broadcast(splits), here).withColumn(name, F.col(_ID) + F.col("_shift"))
            .drop(_FILE, _START, _ID, "_f", "_s", "_shift"))


def zip_inputs(left: DataFrame, right: DataFrame, right_columns: Sequence[str | Column],
               name: str = "position") -> DataFrame:
    """J3 at ingest: the i-th row of one input with the i-th row of another,
    neither of which has an id; the shorter side wins. ``right_columns`` are
    taken from the right input."""
    a = with_input_position(left, name)
    b = with_input_position(right, name).select(name, *right_columns)
    return a.join(b, name)
