"""Operator 3: mixing sources to target weights by the cube method.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating;
together they share 100% of all words; a target stops at three times its
source's size and the excess is reshared by weight among the others.

A document of a source with ratio ``r = target / size`` is taken
``floor(r)`` times for certain and once more with inclusion probability
``r - floor(r)``. The cube method settles these probabilities: its flight
phase moves them through the null space of two balancing constraints, the
number of documents and their words, until they are 0 or 1. It runs on
hash-dealt chunks of each source; a chunk leaves at most two documents open,
and the open ones of all chunks meet in the next round, so a source shrinks a
thousandfold per round until one chunk is left. Its last flight spares a dozen
documents spread over all sizes; they and the two that stay open are the
landing problem, settled by the subset nearest to the remaining word total. All random steps are seeded by content, so reruns
agree.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, columns, words_size

#: Weights of the sources in order, repeating (fixed values).
WEIGHTS = (5, 2, 1)
CAP = 3
_EPS = 1e-9


def source_targets(units: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) for a table with source and size.

    Capped targets are those whose size is too small for their weight: sorted
    by ``cap * size / weight``, they are a prefix, found with running sums.
    The windows see one row per source."""
    sizes = units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    w = sizes.withColumn("w", weight).withColumn("limit", cap * F.col("source_size").cast("double"))
    by_need = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    everything = by_need.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ((F.sum(F.col("source_size").cast("double")).over(everything)
              - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
             / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    w = w.withColumn("level", level).withColumn("capped", F.col("level") * F.col("w") > F.col("limit"))
    last = F.min(F.when(~F.col("capped"), F.struct(F.col("limit") / F.col("w"), F.col("level").alias("at")))).over(
        Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(0)))
    return w.withColumn("first", last).select(
        "source", "source_size", "n",
        F.when(F.col("capped"), F.col("limit")).otherwise(F.col("first.at") * F.col("w")).alias("target"))


def flight(p: list[float], z: list[float], rng: random.Random) -> None:
    """Move ``p`` in place along the null space of (1, z) until at most two
    entries are strictly between 0 and 1; sums of p and p * z stay put."""
    queue = [i for i in range(len(p)) if _EPS < p[i] < 1 - _EPS]
    queue.reverse()
    active: list[int] = []
    while True:
        while len(active) < 3 and queue:
            active.append(queue.pop())
        if len(active) < 3:
            break
        i, j, k = active
        u = (z[k] - z[j], z[i] - z[k], z[j] - z[i])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[a]) / d if d > 0 else p[a] / -d for a, d in zip(active, u) if d)
        down = min(p[a] / d if d > 0 else (1 - p[a]) / -d for a, d in zip(active, u) if d)
        step = up if rng.random() * (up + down) < down else -down
        for a, d in zip(active, u):
            p[a] = min(1.0, max(0.0, p[a] + step * d))
        moved = [a for a in active if _EPS < p[a] < 1 - _EPS]
        if len(moved) == 3:  # rounding: settle the entry nearest to 0 or 1
            near = min(moved, key=lambda a: min(p[a], 1 - p[a]))
            p[near] = float(round(p[near]))
            moved.remove(near)
        active = moved


def landing(p: list[float], z: list[float]) -> None:
    """Settle the few open entries by the subset whose words come nearest to
    what their probabilities promise, then whose number does."""
    left = [i for i in range(len(p)) if _EPS < p[i] < 1 - _EPS]
    if not left:
        return
    masks = np.arange(1 << len(left))
    on = (masks[:, None] >> np.arange(len(left))) & 1
    words = np.abs(on @ np.array([z[i] for i in left]) - sum(p[i] * z[i] for i in left))
    count = np.abs(on.sum(axis=1) - sum(p[i] for i in left))
    best = on[np.lexsort((masks, count, np.round(words, 6)))[0]]
    for b, i in enumerate(left):
        p[i] = float(best[b])


def settle_giants(p: list[float], z: list[float], room: float, rng: random.Random) -> None:
    """Settle the entries of more than ``room`` words, which the flight would
    keep open to its end and the landing could not make up for: systematic
    sampling by their probabilities. What that adds or takes in words is
    spread evenly over the probabilities of the others."""
    begin, at, spare = rng.random(), 0.0, 0.0
    for i in range(len(p)):
        if z[i] > room and _EPS < p[i] < 1 - _EPS:
            before, at = math.floor(at + begin), at + p[i]
            chosen = float(math.floor(at + begin) - before)
            spare += (p[i] - chosen) * z[i]
            p[i] = chosen
    for _ in range(20):
        rest = [i for i in range(len(p)) if z[i] and (_EPS < p[i] if spare < 0 else p[i] < 1 - _EPS) and z[i] <= room]
        words = sum(z[i] for i in rest if _EPS < p[i] < 1 - _EPS)
        if abs(spare) < 0.5 or not words:
            return
        shift = spare / words
        for i in rest:
            if _EPS < p[i] < 1 - _EPS:
                moved = min(1.0, max(0.0, p[i] + shift))
                spare -= (moved - p[i]) * z[i]
                p[i] = moved


def _settle(seed: int, round_no: int, land: int):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["size", "tie"], ascending=[False, True], kind="stable")
        p, z = g["p"].tolist(), g["size"].astype(float).tolist()
        last = g["chunks"].iloc[0] == 1
        rng = random.Random(f"{seed}|{round_no}|{g['source'].iloc[0]!r}|{g['chunk'].iloc[0]}")
        spared = {i for i in (int((i + 1) * len(p) / land) - 1 for i in range(land)) if i >= 0} if last else set()
        if last:
            settle_giants(p, z, sum(z[i] for i in spared) / 2, rng)
        kept = {i: p[i] for i in spared}
        for i in kept:  # these take no part in the last flight, only in the landing
            p[i] = 0.0
        flight(p, z, rng)
        if last:
            for i, q in kept.items():
                p[i] = q
            landing(p, z)
        return g.assign(p=[1.0 if x > 1 - _EPS else 0.0 if x < _EPS else x for x in p])
    return run


_UNIT = "id long, source string, size long, tie long, p double"


def cube(units: DataFrame, scratch: Scratch, seed: int = 0, chunk_rows: int = 2048,
         land: int = 12) -> DataFrame:
    """``units`` (id, source, size, p) with every p settled to 0 or 1."""
    rows = units.select("id", "source", "size", F.xxhash64("id", "size", F.lit(seed)).alias("tie"), "p")
    done = rows.where(f"p <= {_EPS} or p >= {1 - _EPS}").withColumn("p", F.round("p"))
    open_rows, round_no = rows.where(f"p > {_EPS} and p < {1 - _EPS}"), 0
    while True:
        counts = open_rows.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).alias("chunks"))
        dealt = (open_rows.withColumnRenamed("source", "_s")
                 .join(counts, F.col("_s").eqNullSafe(F.col("source"))).drop("_s")
                 .withColumn("chunk", F.pmod(F.xxhash64("tie", F.lit(round_no)), F.col("chunks"))))
        out = scratch.save(dealt.groupBy("source", "chunk").applyInPandas(
            _settle(seed, round_no, land), _UNIT + ", chunks long, chunk long"), f"flight-{round_no}")
        done = done.unionByName(out.where("p = 0 or p = 1").select(*rows.columns))
        open_rows, round_no = out.where("p > 0 and p < 1").select(*rows.columns), round_no + 1
        if open_rows.isEmpty():
            return done


def mix(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        seed: int = 0) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target,
    copies, taken (= copies * size).

    Rows that share id and source are one unit and settled together. A null
    text has size 0; a source without words has target 0 and gives no copies;
    a null source is a source of its own, last in order; null ids are ids
    like any other. An empty table gives no rows."""
    scratch = Scratch(documents.sparkSession, "mix")
    docs = scratch.save(columns(documents, id=id_col, source=source_col, text=text_col)
                        .select(F.col("id").cast("long").alias("id"), F.col("source").cast("string").alias("source"),
                                words_size("text").alias("size")), "sizes")
    units = docs.groupBy("id", "source").agg(F.sum("size").alias("size"))
    targets = scratch.save(source_targets(docs).drop("n"), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    planned = (units.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
               .withColumn("r", ratio).withColumn("base", F.floor(F.col("r") + 1e-12))
               .withColumn("p", F.greatest(F.lit(0.0), F.col("r") - F.col("base"))))
    planned = scratch.save(planned.drop("_s", "r"), "planned")
    picked = cube(planned, scratch, seed).select(F.col("id").alias("_i"), F.col("source").alias("_s"), "p")
    units = (planned.drop("p", "size").join(picked, F.col("id").eqNullSafe(F.col("_i"))
                                            & F.col("source").eqNullSafe(F.col("_s")))
             .select("_i", "_s", "source_size", "target", (F.col("base") + F.col("p")).cast("long").alias("copies")))
    return (docs.join(units, F.col("id").eqNullSafe(F.col("_i")) & F.col("source").eqNullSafe(F.col("_s")))
            .select(F.col("id").alias("doc_id"), "size", "source", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))
