"""Partition sizing for CPU-heavy row work.

A stage whose cost per row is quadratic in text length (edit distance) needs
even partitions more than few ones. ``dealt_by_cost`` gives every task the
same share of the cost, ``spread`` deals a small single-partition input over
the cores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def cpu_partitions(spark: SparkSession, per_core: int = 4) -> int:
    """max(spark.sql.shuffle.partitions, per_core x default parallelism)."""
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        cores = spark.sparkContext.defaultParallelism
    except Exception:  # sessions without a local SparkContext (Spark Connect)
        return shuffle
    return max(shuffle, per_core * cores)


def spread(df: DataFrame, key: str, per_core: int = 4) -> DataFrame:
    """Hash-partition ``df`` on ``key`` when it has fewer partitions than
    ``cpu_partitions`` - a small input (one Parquet row group is one scan
    partition) feeding CPU-heavy row work. A wide input is returned as is,
    so on a cluster scan this adds no shuffle."""
    n = cpu_partitions(df.sparkSession, per_core)
    try:
        current = df.rdd.getNumPartitions()
    except Exception:  # no RDD access (Spark Connect): leave partitioning to AQE
        return df
    if current >= n:
        return df
    return df.repartition(n, key)


def cost_shares(costs: DataFrame, key: str, tasks: int, cost: str = "cost", alike: Sequence[str] = ()) -> DataFrame:
    """(key, task): rows laid end to end by their cost, the whole cut into
    ``tasks`` equal shares. A row belongs to the share its middle lies in, so
    no task exceeds a share by more than one row. Rows are laid in the order of
    the columns ``alike``, if any: a task then gets rows that are alike in them.

    The prefix sums are those of the saved partitions (one total each, the
    only thing one task sees of the others) plus a running sum inside them."""
    ensure_checkpoint_dir(costs.sparkSession)
    rows = costs.select(key, *alike, F.col(cost).cast("double").alias("_c"))
    if alike:
        rows = rows.checkpoint().orderBy(*alike, key)  # the sort reads its rows twice
    rows = rows.withColumn("_pid", F.spark_partition_id()).checkpoint()
    parts = rows.groupBy("_pid").agg(F.sum("_c").alias("_sum"))
    whole = parts.agg(F.sum("_sum")).first()[0] or 1.0
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(F.col("_pid").alias("_p"), F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_off"))
    inside = Window.partitionBy("_pid").orderBy(*alike, key).rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("_off") + F.sum("_c").over(inside) - F.col("_c") / 2
    share = F.floor(middle * F.lit(tasks / whole)).cast("int")
    # one row per saved partition
    return (rows.join(F.broadcast(offsets), F.col("_pid") == F.col("_p"))
            .select(key, F.greatest(F.lit(0), F.least(F.lit(tasks - 1), share)).alias("_task")))


def dealt_by_cost(rows: DataFrame, costs: DataFrame, key: str, tasks: int | None = None,
                  alike: Sequence[str] = ()) -> DataFrame:
    """``rows`` in ``tasks`` partitions of equal total cost. ``costs`` has one
    row (key, cost, ``alike``) for each key of ``rows``; only those narrow rows
    are looked at to find the shares, then each row is sent once to its task."""
    n = tasks or cpu_partitions(rows.sparkSession)
    return rows.join(cost_shares(costs, key, n, alike=alike), key).repartitionById(n, F.col("_task")).drop("_task")
