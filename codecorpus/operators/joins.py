"""Joins and row-multiplying operators.

All joins are equi-joins left to Catalyst/AQE: a side is broadcast only when
its size is known to be below ``spark.sql.autoBroadcastJoinThreshold``
(statistics or AQE runtime sizes), otherwise it is a shuffled join on the
key. Parameter lists (decompilers, opt levels, repeats) become rows through
``explode`` of a literal array, never through a cross join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def strict_join(left: DataFrame, right: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """Join that fails when a left key has no right row.

    One plan and no job of its own: a left join whose unmatched rows raise an
    error naming the key when the result is computed.
    """
    on = [on] if isinstance(on, str) else list(on)
    j = left.join(right.withColumn("_found", F.lit(True)), on, "left")
    told = F.concat(F.lit(f"no match on {on} for "), F.concat_ws(", ", *[F.col(c).cast("string") for c in on]))
    first = on[0]
    kept = F.when(F.col("_found").isNull(), F.raise_error(told).cast(dict(j.dtypes)[first])).otherwise(F.col(first))
    return j.withColumn(first, kept).drop("_found")


def tolerant_join(left: DataFrame, right: DataFrame, on: Sequence[str] | str,
                  defaults: dict[str, object]) -> DataFrame:
    """Left join; missing right values take the given defaults.

    A flag ``_matched`` tells matched rows apart from defaulted ones.
    """
    on = [on] if isinstance(on, str) else list(on)
    r = right.withColumn("_matched", F.lit(True))
    out = left.join(r, on, "left")
    for name, value in defaults.items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return out.withColumn("_matched", F.coalesce(F.col("_matched"), F.lit(False)))


def zip_by_id(left: DataFrame, right: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """The i-th sample paired with the i-th result via an explicit id
    (Python ``zip`` truncates to the shorter side: an inner join)."""
    return left.join(right, id_col, "inner")


def expand_values(df: DataFrame, name: str, values: Sequence[str], least: int = 1) -> DataFrame:
    """Every row once per parameter value (decompilers, opt levels).

    ``explode`` of a literal array: a narrow, map-side operator. ``least``
    values are needed (a comparison of decompilers needs two).
    """
    if len(values) < least:
        raise ValueError(f"need at least {least} values")
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def with_fallback(df: DataFrame, cached: DataFrame, on: Sequence[str], value: str, compute: Column,
                  python: bool = False) -> DataFrame:
    """The cached value when present, else ``compute`` (a Column) of the
    row. One join; ``coalesce`` computes a built-in expression for misses only.

    A Python function would run on every row of such a plan. With ``python``
    the joined rows are saved, and the function sees the misses alone."""
    c = cached.select(*on, F.col(value).alias("_cached"))
    j = df.join(c, list(on), "left")
    if not python:
        return j.withColumn(value, F.coalesce("_cached", compute)).drop("_cached")
    ensure_checkpoint_dir(df.sparkSession)
    j = j.checkpoint()
    hits = j.where(F.col("_cached").isNotNull()).withColumnRenamed("_cached", value)
    misses = j.where(F.col("_cached").isNull()).drop("_cached").withColumn(value, compute)
    return hits.unionByName(misses)


#: A key counts as hot if it holds more than one in this many rows.
HOT_SHARE = 1000


def hot_cold_join(rows: DataFrame, values: DataFrame, key: str, count_col: str,
                  hot_share: int = HOT_SHARE, how: str = "left") -> DataFrame:
    """Join ``rows`` to ``values`` (one row per key, with the key's row count
    in ``count_col``) without letting a hot key skew a shuffle partition.

    Keys that hold more than one row in ``hot_share`` number fewer than
    ``hot_share`` whatever the size of the data, so they are broadcast and
    their rows get their values map-side. The shuffled join that serves the
    cold keys is keyed on (key, spreader): a hot row's key is NULL there (it
    matches nothing) and its spreader is a hash of the row, so hot rows are
    scattered over all partitions; a cold row's spreader is 0, the same as
    every value row. One pass over ``rows``. ``how`` is ``left`` or
    ``inner``; the result has ``rows``' columns plus the value columns.
    """
    vcols = [c for c in values.columns if c not in (key, count_col)]
    total = values.agg(F.sum(count_col)).scalar()
    is_hot_key = F.col(count_col) * hot_share > total
    hot = values.where(is_hot_key).select(
        F.col(key).alias("_hk"), *[F.col(c).alias("_h_" + c) for c in vcols])
    cold = values.where(~is_hot_key).select(
        F.col(key).alias("_ck"), F.lit(0).cast("long").alias("_cs"), *[F.col(c).alias("_c_" + c) for c in vcols])
    tagged = rows.join(F.broadcast(hot), rows[key] == hot["_hk"], "left")
    is_hot = F.col("_hk").isNotNull()
    tagged = (tagged.withColumn("_k2", F.when(~is_hot, F.col(key)))
              .withColumn("_s2", F.when(is_hot, F.xxhash64(*[F.col(c) for c, t in rows.dtypes
                                                               if not t.startswith("map")]))
                          .otherwise(F.lit(0).cast("long"))))
    joined = tagged.join(cold, (tagged["_k2"] == cold["_ck"]) & (tagged["_s2"] == cold["_cs"]), "left")
    if how == "inner":
        joined = joined.where(is_hot | F.col("_ck").isNotNull())
    return joined.select(*rows.columns, *[F.when(is_hot, F.col("_h_" + c)).otherwise(F.col("_c_" + c)).alias(c)
                                          for c in vcols])


def text_key(c: Column) -> Column:
    """256-bit hash that stands for a text as a key; NULL has one too."""
    return F.coalesce(F.sha2(c, 256), F.lit("null"))


def distinct_values(df: DataFrame, key: str, fn, out: str) -> DataFrame:
    """One row per distinct ``key`` (NULL is one): ``_k`` (its hash), ``_n``
    (its rows) and ``out`` = ``fn`` of it, in the only place that calls ``fn``.

    Rows meet on a hash of the key, combined map-side first, so a text that
    a third of all rows share is one row per map task.
    """
    per = df.groupBy(text_key(F.col(key)).alias("_k")).agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("_text"))
    return per.select("_k", "_n", fn(F.col("_text")).alias(out))


def per_distinct(df: DataFrame, key: str, fn, out: str, hot_share: int = HOT_SHARE) -> DataFrame:
    """Evaluate the Column function ``fn`` once per distinct ``key`` and
    fan the result back to all rows (NULL keys and NULL results included).
    The fan-back joins on the key's hash, hot keys apart (``hot_cold_join``)."""
    keyed = df.withColumn("_k", text_key(F.col(key)))
    return hot_cold_join(keyed, distinct_values(df, key, fn, out), "_k", "_n", hot_share).drop("_k")


def enrich_or_drop(df: DataFrame, values: DataFrame, on: Sequence[str] | str, value: str,
                   target: str) -> DataFrame:
    """Set ``target`` from ``values`` and keep only rows that got a
    non-empty one (inner join)."""
    on = [on] if isinstance(on, str) else list(on)
    v = values.where(F.col(value).isNotNull() & (F.col(value) != "")).select(*on, F.col(value).alias("_v"))
    return df.join(v, on, "inner").withColumn(target, F.col("_v")).drop("_v")


def repeat_rows(df: DataFrame, n: int | Column, name: str = "request_no") -> DataFrame:
    """Every input row ``n`` times, numbered 1..n."""
    n_col = n if isinstance(n, Column) else F.lit(n)
    return df.withColumn(name, F.explode(F.sequence(F.lit(1), n_col)))


def gather_requests(df: DataFrame, id_col: str, output: str, name: str = "request_no") -> DataFrame:
    """J9 back: one row per input with the outputs of its repeated requests
    in request order (as many as the parameter asked for)."""
    return df.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct(name, output))),
                                              lambda x: x[output]).alias("outputs"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns missing on one side become NULL."""
    it = iter(frames)
    out = next(it)
    for f in it:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
