"""Stand-ins: the reference's data roles derived from the driver's tables.

The test tables hold no C code, no model outputs and no verdicts, so each
role is an ordinary Spark projection of a given table (its twin SQL is in
``plans/sqlparts.py``). Whole tables, whole texts: nothing is sampled or cut.

role                      | source table    | key
--------------------------|-----------------|-----------------------------
samples (benchmark rows)  | documents       | sample_id = doc_id
predictions (model output)| documents       | text of doc_id + 4 (tail missing)
verdicts (compile/run)    | labels          | sample_id = doc_id
repeated verdicts         | lineitem        | sample_id = l_orderkey, repeat = l_linenumber
C-like functions          | part            | one function per part
listings (disassembly)    | lineitem        | one listing per order
judge answers             | events          | one answer per event
chat turns                | conversations   | as is
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_fold
from ..sources.tables import table

OPTS = ["O0", "O1", "O2", "O3"]


def opt_of(key) -> F.Column:
    """Optimisation level label derived from an integer key."""
    return F.concat(F.lit("O"), (F.col(key) % 4).cast("string"))


def samples(spark: SparkSession, d: str) -> DataFrame:
    """D3 benchmark samples: one per document, whole text."""
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("sample_id"),
        F.concat(F.lit("func"), F.col("doc_id").cast("string")).alias("func_name"),
        F.col("text").alias("func"),
        opt_of("doc_id").alias("opt"),
        F.col("lang").alias("language"),
        F.col("source").alias("dataset"))


def predictions(spark: SparkSession, d: str, decompiler: str = "next4") -> DataFrame:
    """D14 predictions of one model: sample i gets the text of document i+4,
    so the last four samples have none (exercises the missing-file rule)."""
    return table(spark, d, "documents").select(
        (F.col("doc_id") - 4).alias("sample_id"),
        F.lit(decompiler).alias("decompiler"),
        F.col("text").alias("prediction"))


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    """D8 verdicts from ``labels``: compiled = quality, ran = quality and not toxic."""
    return table(spark, d, "labels").select(
        F.col("doc_id").alias("sample_id"),
        F.lit(0).alias("repeat_no"),
        F.col("quality").alias("flag_compile"),
        (F.col("quality") * (1 - F.col("toxic"))).alias("flag_run"))


def repeat_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """D8 with repeats, at lineitem scale: one verdict per (order, line)."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("sample_id"),
        opt_of("l_orderkey").alias("opt"),
        F.col("l_linenumber").alias("repeat_no"),
        (F.col("l_returnflag") != "R").cast("int").alias("flag_compile"),
        (F.col("l_returnflag") == "A").cast("int").alias("flag_run"))


def native_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Samples with the two native decompilers' outputs as columns
    (``ida_pseudo``, ``ghidra_pseudo``), as in the v2 benchmark rows. Stand-in
    text: the sample's own text, ASCII-folded, upper- and lower-cased
    (engines differ in the case rules of other letters)."""
    return samples(spark, d).select(
        "sample_id", "func_name", "func", "opt", "language", "dataset",
        F.upper(ascii_fold("func")).alias("ida_pseudo"), F.lower(ascii_fold("func")).alias("ghidra_pseudo"))
