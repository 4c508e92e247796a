"""Writers (K1-K8).

All writers go through Spark's file committers, so concurrent tasks never
interleave records (the original appended JSON lines under a lock created
per call, which protected nothing) and a failed job leaves no partial
output behind.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.regex import let
from . import trees

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K1 (large form) / K2 (``mode='append'``): JSON lines, one part file
    per task."""
    df.write.mode(mode).json(path)


def _as_array(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines of one JSON array; one record is held back for its comma."""
    held = None
    for batch in batches:
        lines = []
        for record in batch["value"]:
            lines.append("[" if held is None else held + ",")
            held = record
        yield pd.DataFrame({"value": lines})
    if held is not None:
        yield pd.DataFrame({"value": [held, "]"]})


def write_json_array(df: DataFrame, path: str, order: Sequence[str] | None = None) -> None:
    """K1 (array form): part files that each hold one JSON array, which S1
    reads back. With ``order`` the rows are range-sorted first, so the parts
    follow one another. Rows stream through; none are gathered."""
    rows = df.orderBy(*order) if order else df
    rows.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInPandas(_as_array, "value string").write.mode(
        "overwrite").text(path)


def write_result_tree(df: DataFrame, path: str, by: Sequence[str] = ("opt", "language")) -> None:
    """K3 as records: results partitioned by opt and language (old tree
    replaced). ``write_result_files`` gives each sample a file."""
    df.write.mode("overwrite").partitionBy(*by).json(path)


def write_result_files(df: DataFrame, path: str, by: Sequence[str] = ("opt",), text: str = "prediction",
                       packed: bool = False) -> None:
    """K3: one file ``{by}/{index}_{opt}.{language}`` for each sample; the old
    tree goes once all files of the new one are written. Texts may come
    ``trees.packed``."""
    trees.write_tree(df, path, trees.result_file(by), text, meet="index", packed=packed)


def write_group_csv(df: DataFrame, path: str, by: Sequence[str] = ("language", "opt")) -> None:
    """K4: one CSV folder per group, header row, rows = decompilers."""
    df.write.mode("overwrite").partitionBy(*by).option("header", True).csv(path)


#: Below this size a double times 100 has a place for its fraction.
_TWO_DECIMAL_LIMIT = float(2 ** 45)


def two_decimals(x: F.Column) -> F.Column:
    """``%.2f`` of the double itself, half-even, as the C library rounds it:
    2.675 is a binary value below its decimal form, so it gives 2.67.

    The product with 100 is split into its rounded value and the exact rest
    (both factors cut into halves of 26 bits, whose products are exact). Only
    if the rounded product is a half does the rest decide."""
    def split(v: F.Column) -> F.Column:
        return let(v * F.lit(134217729.0), lambda c: c - (c - v))

    def digits(a: F.Column) -> F.Column:
        def rounded(p: F.Column) -> F.Column:
            # 100 has 7 bits: both products with the halves of a are exact
            rest = let(split(a), lambda hi: ((hi * 100.0 - p) + (a - hi) * 100.0))
            low = F.floor(p)
            half = (p - low) == 0.5
            up = F.when(half & (rest == 0.0), low % 2 == 1).when(half, rest > 0.0).otherwise(p - low > 0.5)
            return low + up.cast("long")
        whole = let(a * 100.0, rounded)
        return let(whole, lambda n: F.concat(F.call_function("div", n, F.lit(100)).cast("string"), F.lit("."),
                                             F.lpad((n % 100).cast("string"), 2, "0")))
    x = x.cast("double")
    return let(x, lambda v: F.when(F.isnan(v), F.lit("nan")).when(F.abs(v) < _TWO_DECIMAL_LIMIT, F.concat(
        F.when(v.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit("")), let(F.abs(v), digits))).otherwise(
        F.lower(F.regexp_replace(F.format_string("%.2f", v), "Infinity", "inf"))))


def result_lines(df: DataFrame, key: str = "opt", value: str = "exe_rate") -> DataFrame:
    """K5 text: ``O0: 12.34`` per row."""
    return df.select(F.concat(F.col(key), F.lit(": "), two_decimals(F.col(value))).alias("value"))


def append_result_lines(df: DataFrame, path: str, key: str = "opt", value: str = "exe_rate") -> None:
    """K5: appended result lines."""
    result_lines(df, key, value).write.mode("append").text(path)


def write_parts(df: DataFrame, path: str, mode: str = "overwrite", jsonl_path: str | None = None) -> None:
    """K6: indexed columnar parts (Spark's part-NNNNN naming) and, if asked
    for, the same rows as JSON lines."""
    df.write.mode(mode).parquet(path)
    if jsonl_path:
        df.sparkSession.read.parquet(path).write.mode(mode).json(jsonl_path)


def write_run_log(df: DataFrame, path: str, fields: Sequence[str], level: str | None = None,
                  levels: Sequence[str] = (), counts: Mapping[str, F.Column] | None = None) -> dict[str, int]:
    """K7: one JSON record per sample with the given fields (missing optional
    fields are omitted, as JSON nulls are by default), and what the run wrote:
    ``total``, every condition of ``counts``, and the rows of each level.

    The numbers are observed on the rows as they are written, by the one job
    that writes them: nothing is read or computed again. They are also
    appended to the log's folder as ``_stats``, one line each."""
    wanted = {"total": F.count(F.lit(1)), **{k: F.count_if(c) for k, c in (counts or {}).items()}}
    wanted |= {f"level {v}": F.count_if(F.col(level) == v) for v in levels if level}
    seen = Observation()
    told = df.observe(seen, *[c.cast("long").alias(k) for k, c in wanted.items()])
    told.select(*fields).write.mode("overwrite").json(path)
    stats = seen.get
    spark = df.sparkSession
    spark.createDataFrame([(f"{k}: {stats[k]}",) for k in wanted], "value string").coalesce(1).write.text(f"{path}/_stats")
    return {k: stats[k] for k in wanted}


def sibling_header(path: str) -> F.Column:
    """``x.h`` for ``x.c``."""
    return F.regexp_replace(F.col(path), r"\.c$", ".h")


def write_sibling_headers(files: DataFrame, headers: DataFrame, root: str, key: str = "path") -> None:
    """K8: beside every source file ``x.c`` of the tree (named by its place
    below ``root``) the file ``x.h``, empty when no header was produced. All
    other files stay; a second run replaces the headers."""
    out = files.select(key).join(headers.select(key, "header"), key, "left")
    trees.write_tree(out, root, sibling_header(key), "header", replace=False)
