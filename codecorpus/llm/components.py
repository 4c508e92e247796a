"""Connected components over an edge table, distributed.

Alternating star contraction over edges (a, b), a > b: the large-star step
hangs every a on the smallest neighbour of its b, the small-star step hangs
the b's of an a, and a itself, on the smallest of them, until the edges stop
changing; then every node points at the smallest node of its component. The
neighbour of b comes from a table with one row for each child, combined
before its shuffle, by a join whose skew adaptive execution can split.
Before the first round every task contracts the links it holds to stars,
without a shuffle, so chains and repeated links are gone and few rounds
remain. Nothing is collected but one observed fingerprint per round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import Scratch


def _saved(edges: DataFrame, scratch: Scratch, tag: str) -> tuple[DataFrame, tuple]:
    """The saved edges and their fingerprint, observed on the write."""
    seen = Observation()
    told = edges.observe(seen, F.count("a").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"))
    saved = scratch.save(told, tag)
    return saved, (seen.get["n"], seen.get["sum"])


class Forest:
    """Union by smallest id over the links of one task."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = self.root(x), self.root(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        """(id, smallest id of its tree) of all but the smallest."""
        ids = list(self.up)
        return np.array(ids, np.int64), np.array([self.root(x) for x in ids], np.int64)


def _contracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    forest = Forest()
    for batch in batches:
        forest.add(batch["a"].to_numpy(np.int64), batch["b"].to_numpy(np.int64))
    a, b = forest.stars()
    yield pd.DataFrame({"a": a, "b": b})


def components(links: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(id, component): for each id with a link, the smallest id reachable.

    ``links`` has columns a and b of longs. Repeated links and links of an
    id to itself change nothing; an empty table gives no rows."""
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges, mark = _saved(pairs.mapInPandas(_contracted, "a long, b long").distinct(), scratch, f"{tag}-0")
    rounds = 0
    while mark[0]:
        up = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        large = edges.join(up, F.col("b") == F.col("u"), "left").select("a", F.coalesce("m", "b").alias("b"))
        least = F.min("b").over(Window.partitionBy("a"))
        both = large.select("a", "b", least.alias("m")).select(F.explode(F.when(F.col("b") == F.col("m"), F.array(
            F.struct("a", F.col("m").alias("b")))).otherwise(F.array(
                F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))).alias("e"))
        rounds += 1
        before = mark
        edges, mark = _saved(both.select("e.a", "e.b").distinct(), scratch, f"{tag}-{rounds}")
        scratch.drop(f"{tag}-{rounds - 1}")
        if mark == before:
            break
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
