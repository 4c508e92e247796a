"""Evaluation aggregations.

Every metric is a ``groupBy`` over keyed rows: Spark plans a partial
aggregate before the shuffle, so only one row per group and map task
crosses the network however skewed the groups are. Parameter tables (the
opt-level list) are ``spark.range`` projections joined to tiny aggregate
results. Windows without a partition key appear only over such tiny,
already aggregated frames (one row per repeat x level), never over data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPTS = ["O0", "O1", "O2", "O3"]


def opt_levels(spark: SparkSession, opts: Sequence[str] = OPTS) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(o) for o in opts])).alias("opt"))


def mean_edit_similarity(df: DataFrame, by: Sequence[str], es: str = "edit_sim") -> DataFrame:
    """A1: unweighted mean of per-sample edit similarity per group."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(es), 6).alias("mean_edit_sim"))


def execute_rate(df: DataFrame, by: Sequence[str] = ("opt",), flag: str = "flag_run") -> DataFrame:
    """A2: ``100 * sum(flag) / count`` per group (groups that exist)."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(flag).cast("long").alias("n_run"),
        F.round(F.sum(flag) * 100.0 / F.count(F.lit(1)), 6).alias("exe_rate"))


def repeat_rates(verdicts: DataFrame, opts: Sequence[str] = OPTS) -> DataFrame:
    """A3: compile and run rate per opt over repeats.

    Per (repeat, opt) counts; per opt the average over all repeats (a level
    missing in one repeat counts 0 there); rate = avg / avg total, 0 when the
    total is 0. Every level of ``opts`` is reported, 0 without a verdict.
    """
    per = verdicts.groupBy("repeat_no", "opt").agg(
        F.sum("flag_compile").alias("c"), F.sum("flag_run").alias("r"), F.count(F.lit(1)).alias("t"))
    n_rep = F.size(F.collect_set("repeat_no").over(Window.partitionBy()))
    per = per.withColumn("n_rep", n_rep)
    mean = lambda c: F.coalesce(F.sum(c) / F.first("n_rep"), F.lit(0.0))
    found = per.groupBy("opt").agg(mean("c").alias("avg_compile"), mean("r").alias("avg_run"),
                                   mean("t").alias("avg_total"))
    agg = opt_levels(verdicts.sparkSession, opts).join(found, "opt", "left").na.fill(
        0.0, ["avg_compile", "avg_run", "avg_total"])
    return agg.select(
        "opt",
        F.round("avg_compile", 6).alias("avg_compile"), F.round("avg_run", 6).alias("avg_run"),
        F.round("avg_total", 6).alias("avg_total"),
        F.round(F.when(F.col("avg_total") > 0, F.col("avg_compile") / F.col("avg_total")).otherwise(0.0), 6)
        .alias("compile_rate"),
        F.round(F.when(F.col("avg_total") > 0, F.col("avg_run") / F.col("avg_total")).otherwise(0.0), 6)
        .alias("run_rate"))


def fixed_denominator_rate(df: DataFrame, levels: int = 4) -> DataFrame:
    """A4: per opt ``100 * sum(flag) / floor(N / levels)`` for both flags,
    with N all samples, judged or not (an unjudged flag counts 0)."""
    per = df.groupBy("opt").agg(F.coalesce(F.sum("flag_compile"), F.lit(0)).alias("c"),
                                F.coalesce(F.sum("flag_run"), F.lit(0)).alias("r"), F.count(F.lit(1)).alias("n"))
    denom = F.floor(F.sum("n").over(Window.partitionBy()) / levels)
    return per.select("opt", F.col("c").cast("long").alias("n_compile"), F.col("r").cast("long").alias("n_run"),
                      F.round(F.col("c") * 100.0 / denom, 6).alias("fixed_compile_rate"),
                      F.round(F.col("r") * 100.0 / denom, 6).alias("fixed_run_rate"))


def totals_with_overall(df: DataFrame) -> DataFrame:
    """A5 (+A2): per-opt rows and one overall row (opt NULL) in one pass:
    ``GROUPING SETS ((opt), ())``."""
    return df.rollup("opt").agg(
        F.count(F.lit(1)).alias("total"),
        F.sum("flag_compile").cast("long").alias("n_compile"),
        F.sum("flag_run").cast("long").alias("n_run"),
        F.round(F.sum("flag_run") / F.count(F.lit(1)), 6).alias("run_ratio"))


def metric_table(long_metrics: DataFrame, metrics: Sequence[str],
                 by: Sequence[str] = ("language", "opt", "decompiler")) -> DataFrame:
    """Long (keys, metric, value) rows -> one row per decompiler and
    group, one column per metric (``pivot`` with the metric list given, so
    no extra job discovers the values)."""
    return long_metrics.groupBy(*by).pivot("metric", list(metrics)).agg(F.first("value"))


def mean_judge_score(df: DataFrame, by: Sequence[str] = ("decompiler", "opt", "criterion"),
                     score: str = "score") -> DataFrame:
    """Mean score per decompiler and criterion (plus how many rows fell
    back to the default score)."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(score), 6).alias("mean_score"),
        F.sum(F.col("defaulted").cast("int")).cast("long").alias("n_defaulted"))


def count_per_opt(spark: SparkSession, df: DataFrame, opts: Sequence[str] = OPTS) -> DataFrame:
    """Sample count per opt, zero for missing levels."""
    counts = df.groupBy("opt").agg(F.count(F.lit(1)).alias("n"))
    return (opt_levels(spark, opts).join(counts, "opt", "left")
            .select("opt", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def distinct_failures(values: DataFrame, value: str) -> DataFrame:
    """A9 + A10 from a per-distinct table (``joins.distinct_values``):
    failures counted once per distinct key against the row count, and rows
    with a non-empty value against rows without (counting from 0)."""
    rows = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("_n"))), F.lit(0))
    empty = F.col(value).isNull() | (F.col(value) == "")
    known = F.col("_k") != "null"
    return values.agg(
        rows(F.lit(True)).alias("n_rows"), F.count_if(known).alias("n_distinct"),
        F.count_if(known & F.col(value).isNull()).alias("n_failed_distinct"),
        rows(~empty).alias("good"), rows(empty).alias("bad"))


def accepted_rollup(df: DataFrame, status: str = "status") -> DataFrame:
    """Rows per status, all rows, and rows kept. The texts are counted
    once; the totals are sums over the few statuses."""
    per = df.groupBy(status).agg(F.count(F.lit(1)).alias("n"))
    whole = per.agg(F.collect_list(F.struct(F.col(status).alias("status"), "n")).alias("per"),
                    F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
                    F.coalesce(F.sum(F.when(F.col(status) == "accepted", F.col("n"))), F.lit(0)).alias("kept"))
    return whole.select(F.inline(F.concat("per", F.array(
        F.struct(F.lit("all rows").alias("status"), F.col("total").alias("n")),
        F.struct(F.lit("kept rows").alias("status"), F.col("kept").alias("n"))))))


def compression_rate(n_in: DataFrame, n_out: DataFrame, by: str) -> DataFrame:
    """Packed rows / input rows per bin, rounded to 6."""
    return (n_in.join(n_out, by, "left")
            .select(by, "n_in", F.coalesce("n_out", F.lit(0)).alias("n_out"),
                    F.round(F.coalesce("n_out", F.lit(0)) / F.col("n_in"), 6).alias("compression_rate")))
