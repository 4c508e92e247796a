"""Projections and filters.

Catalyst pushes a filter below the projection that defines its inputs and
substitutes the definitions into the condition, so a filter on an expensive
computed column (normalised text, say) would evaluate that text twice: once
in the filter, once in the projection. ``select_where`` filters inside a
generator instead (``inline`` of a filtered one-element array): every
computed column is evaluated once per row, and the rest of the plan is
unchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_where(df: DataFrame, keep: Sequence[str], computed: Mapping[str, Column],
                 cond: Callable[[Column], Column]) -> DataFrame:
    """``keep`` columns plus ``computed`` ones, only rows where ``cond(row)``
    holds; ``cond`` receives the row as a struct Column."""
    row = F.struct(*[F.col(k) for k in keep], *[v.alias(k) for k, v in computed.items()])
    return df.select(F.inline(F.filter(F.array(row), cond)))


def equal_filter(df: DataFrame, **values) -> DataFrame:
    """Keep rows whose columns equal the given values (pushed to the
    Parquet scan when the columns come straight from it)."""
    cond = F.lit(True)
    for k, v in values.items():
        cond = cond & (F.col(k) == F.lit(v))
    return df.where(cond)


def choose_column(df: DataFrame, name: str, alias: str) -> DataFrame:
    """A column chosen by name at run time, under a fixed alias."""
    if name not in df.columns:
        raise ValueError(f"no column {name!r}")
    return df.withColumn(alias, F.col(name))


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """P2."""
    return df.drop(*names)
