"""Operator 1: approximate nearest neighbours by collision-counting hashing.

Query-aware hashing: every hash function is one random projection, and its
index is the sorted array of the vectors' projections. A query looks at the
window of radius R centred on its own projection in every array; a vector
that falls into at least ``threshold`` windows has collided often enough and
is verified by its exact inner product. Virtual rehashing widens the same
windows until the k-th best verified vector is within R. A vector within R
falls into a window with probability erf(1 / sqrt 2) at least, which sets the
threshold: one at distance R is missed with probability ``miss`` at most, nearer
ones with less. No candidate count stops the search.

Counting is done for many queries at once. A sorted array keeps, at every
64th part of its ranks, the bit set of the vectors before it; a window
(rounded outward to whole parts) is the difference of two of them. Windows
are added up in bit-sliced counters, 64 vectors to a word.

Largest inner product becomes smallest distance by the usual lift: vectors
are divided by the largest norm M and get sqrt(1 - |v|^2) as one more
component, queries are scaled to length 1 and get 0. A block keeps its
vectors in ranges of norm, each with its own M, so that a few long vectors do
not press all others together; ranges are searched largest first, and one
whose bound |q| M is below the k-th best found is not looked at.

Data and queries are dealt into blocks of bounded size; a task holds one data
block's sorted arrays and one query block, and each query's block results (20
rows) meet in a top-k aggregation. Copies of one vector spread over blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns

#: Projections (hash functions) and parts of a sorted array.
PROJECTIONS, PARTS = 320, 64
#: Vectors of a norm range that are verified without counting.
SMALL_RANGE = 256
#: Queries that are counted at once.
QUERY_BATCH = 64


def collision_threshold(m: int, miss: float) -> int:
    """Largest count that a vector within the radius misses with probability
    at most ``miss`` (normal bound of the binomial count)."""
    p = math.erf(math.sqrt(0.5))
    z, low, high = 0.0, 0.0, 8.0
    for _ in range(60):
        z = (low + high) / 2
        low, high = (z, high) if math.erfc(z / math.sqrt(2)) / 2 > miss else (low, z)
    return max(1, math.floor(m * p - z * math.sqrt(m * p * (1 - p))))


def add_sets(sets: Iterator[np.ndarray], planes: int) -> list[np.ndarray]:
    """Bit-sliced sums of bit sets (lowest plane first): carries of one plane
    wait in pairs for the next, a full adder takes two at a time."""
    total: list[np.ndarray | None] = [None] * planes
    waiting: list[np.ndarray | None] = [None] * planes

    def add(x: np.ndarray, i: int) -> None:
        while i < planes:
            if waiting[i] is None:
                waiting[i] = x
                return
            y, waiting[i] = waiting[i], None
            if total[i] is None:
                total[i], x = x ^ y, x & y
            else:
                u = total[i] ^ x
                x = (total[i] & x) | (u & y)
                total[i] = u ^ y
            i += 1
    zero = None
    for x in sets:
        zero = x
        add(x, 0)
    for i in range(planes):
        if waiting[i] is not None:
            x, waiting[i] = waiting[i], None
            if total[i] is None:
                total[i] = x
            else:
                total[i], carry = total[i] ^ x, total[i] & x
                add(carry, i + 1)
    return [np.zeros_like(zero) if t is None else t for t in total]


def at_least(planes: list[np.ndarray], n: int) -> np.ndarray:
    """Bit set of the counters that hold ``n`` or more."""
    out = np.full_like(planes[0], np.iinfo(planes[0].dtype).max)
    for i, plane in enumerate(planes):
        out = plane & out if n >> i & 1 else plane | out
    return out


class Range:
    """Sorted projection arrays of the vectors of one range of norms."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int, miss: float):
        self.ids, self.components = ids, np.ascontiguousarray(vectors.T)
        n, dim = vectors.shape
        norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        self.largest = float(norms.max())
        self.start = 0.8
        self.small = n <= SMALL_RANGE
        if self.small:
            return
        m = PROJECTIONS
        self.threshold = collision_threshold(m, miss)
        self.axes = np.random.default_rng(seed).standard_normal((m, dim + 1))
        lift = np.sqrt(np.maximum(0.0, 1 - (norms / self.largest) ** 2))
        projected = self.axes[:, :dim] @ (vectors / self.largest).T + self.axes[:, dim:] * lift
        order = np.argsort(projected, axis=1, kind="stable")
        self.shift = np.arange(m) * (8 * float(np.abs(self.axes).max()) * math.sqrt(dim + 1) + 64)
        # one array after the other, each moved beyond its predecessor, so
        # that one search serves all windows
        ranked = np.take_along_axis(projected, order, axis=1) + self.shift[:, None]
        step = -(-n // PARTS)
        self.parts = -(-n // step)
        self.low = ranked[:, ::step].ravel()  # smallest and largest value of each part
        self.high = ranked[:, np.minimum(np.arange(step - 1, n - 1 + step, step), n - 1)].ravel()
        self.first = np.arange(m) * self.parts
        self.words = -(-n // 64)
        part = np.empty((m, n), np.uint8)
        np.put_along_axis(part, order, (np.arange(n) // step).astype(np.uint8)[None, :], axis=1)
        self.before = np.zeros((m, PARTS + 1, self.words), np.uint64)
        view = self.before.view(np.uint8)
        for k in range(1, PARTS + 1):
            view[:, k, :-(-n // 8)] = np.packbits(part < k, axis=1, bitorder="little")

    def products(self, which: np.ndarray, queries: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Inner products in double precision, summed in component order, so
        equal vectors have equal products wherever they lie."""
        out = np.zeros(len(which))
        for values, x in zip(self.components, queries.T, strict=True):
            out += values[which] * x[asked]
        return out

    def collided(self, unit: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, vector) places of the pairs that collide often enough."""
        n, m = len(self.ids), PROJECTIONS
        centre = unit @ self.axes[:, :-1].T + self.shift
        # parts that end before the window, parts that begin before its end
        left = np.clip(np.searchsorted(self.high, centre - radius[:, None], "left") - self.first, 0, self.parts)
        right = np.clip(np.searchsorted(self.low, centre + radius[:, None], "right") - self.first, 0, self.parts)
        right = np.maximum(left, right)
        windows = (self.before[j, right[:, j]] ^ self.before[j, left[:, j]] for j in range(m))
        good = at_least(add_sets(windows, m.bit_length()), self.threshold)
        bits = np.unpackbits(good.view(np.uint8), axis=1, bitorder="little").view(np.bool_)
        asked, which = np.divmod(np.flatnonzero(bits), bits.shape[1])
        return asked, which  # places beyond n are in no part, so they are in no window

    def search(self, queries: np.ndarray, best: "Best") -> int:
        """Improve ``best`` for all queries that this range can improve;
        returns how many pairs were verified."""
        length = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        live = np.flatnonzero(best.worst() < length * self.largest)
        if self.small:
            asked, which = np.repeat(live, len(self.ids)), np.tile(np.arange(len(self.ids)), len(live))
            best.add(asked, self.ids[which], self.products(which, queries, asked))
            return len(which)
        verified = 0
        radius = np.full(len(queries), self.start)
        ended = []
        known = best.state()
        while len(live):
            whole = live[radius[live] >= 2]  # no lifted pair is further apart
            some = live[radius[live] < 2]
            asked, which = self.collided(queries[some] / length[some, None], radius[some])
            asked = np.concatenate([some[asked], np.repeat(whole, len(self.ids))])
            which = np.concatenate([which, np.tile(np.arange(len(self.ids)), len(whole))])
            verified += len(which)
            # a wider window holds all that a narrower one held: its vectors replace the earlier ones
            best.reset(live, known)
            best.add(asked, self.ids[which], self.products(which, queries, asked))
            # the distance of a lifted pair is 2 - 2 <q, v> / (|q| M), squared
            kth = np.sqrt(np.maximum(0.0, 2 - 2 * best.worst()[live] / (length[live] * self.largest)))
            done = (kth <= radius[live]) | (radius[live] >= 2)
            ended += radius[live[done]].tolist()
            radius[live] = np.clip(kth, radius[live] * 1.02, radius[live] * 1.15)
            live = live[~done]
        if ended:
            self.start = min(1.5, 0.97 * float(np.median(ended)))
        return verified


class Best:
    """The k best verified vectors of each query, best first, ties to the
    smaller id, without the query itself."""

    def __init__(self, query_ids: np.ndarray, k: int):
        self.query_ids, self.k = query_ids, k
        self.asked, self.ids, self.scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def add(self, asked: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        other = ids != self.query_ids[asked]
        a = np.concatenate([self.asked, asked[other]])
        i = np.concatenate([self.ids, ids[other]])
        s = np.concatenate([self.scores, scores[other]])
        order = np.lexsort((i, -s, a))
        a, i, s = a[order], i[order], s[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        keep = rank < self.k
        self.asked, self.ids, self.scores = a[keep], i[keep], s[keep]

    def state(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.asked, self.ids, self.scores

    def reset(self, queries: np.ndarray, state: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        """What these queries knew in an earlier state."""
        keep, back = ~np.isin(self.asked, queries), np.isin(state[0], queries)
        both = [np.concatenate([x[keep], y[back]]) for x, y in zip(self.state(), state, strict=True)]
        order = np.argsort(both[0], kind="stable")
        self.asked, self.ids, self.scores = (x[order] for x in both)

    def worst(self) -> np.ndarray:
        """The k-th best score of each query, -inf if fewer are known."""
        out = np.full(len(self.query_ids), -np.inf)
        last = np.searchsorted(self.asked, np.arange(len(out)), "right") - 1
        full = np.bincount(self.asked, minlength=len(out)) == self.k
        out[full] = self.scores[last[full]]
        return out


def norm_ranges(norms: np.ndarray) -> list[np.ndarray]:
    """Places of the vectors by powers of two of the norm, largest first."""
    level = np.frexp(norms)[1]
    return [np.flatnonzero(level == x) for x in np.unique(level)[::-1]]


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, seed: int,
                 miss: float) -> tuple[Iterator[Best], list[int]]:
    """Results of each batch of queries, and a list that gathers the numbers
    of verified pairs."""
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    ranges = [Range(ids[at], vectors[at], seed, miss) for at in norm_ranges(norms)]
    verified: list[int] = []

    def run() -> Iterator[Best]:
        for i in range(0, len(query_ids), QUERY_BATCH):
            best = Best(query_ids[i:i + QUERY_BATCH], k)
            verified.append(sum(r.search(queries[i:i + QUERY_BATCH], best) for r in ranges))
            yield best
    return run(), verified


def _usable(vec) -> F.Column:
    return ((F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists(vec, lambda x: x != 0))


def nearest(vectors: DataFrame, queries: DataFrame | None = None, id_col: str = "vec_id",
            vector_col: str = "embedding", k: int = 20, block_rows: int = 16_384, query_rows: int = 1_024,
            seed: int = 0, miss: float = 0.5) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) of each query's k nearest found,
    by inner product, ties to the smaller id.

    ``queries`` defaults to the rows whose id is divisible by 20. Vectors
    that are null, empty, zero or hold null or non-finite components, and
    rows without id, take no part on either side; a query is compared with
    vectors of its own dimension. Repeated rows are candidates each; a query
    id that repeats is asked once. Empty tables give no rows."""
    def usable(df: DataFrame) -> DataFrame:
        rows = columns(df, id=id_col, vec=vector_col).select(
            F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
        return rows.where(F.col("id").isNotNull() & _usable(F.col("vec"))).withColumn("dim", F.size("vec"))

    data = usable(vectors)
    asked = (data.where("id % 20 = 0") if queries is None else usable(queries)).dropDuplicates(["id"])
    sizes = {r["dim"]: r["n"] for r in data.groupBy("dim").agg(F.count("id").alias("n")).collect()}
    wanted = {r["dim"]: r["n"] for r in asked.groupBy("dim").agg(F.count("id").alias("n")).collect()}
    dims = sorted(set(sizes) & set(wanted))

    def per_dim(count, default: int = 1):
        out = F.lit(default)
        for d in dims:
            out = F.when(F.col("dim") == d, F.lit(count(d))).otherwise(out)
        return out

    data_blocks = per_dim(lambda d: -(-sizes[d] // block_rows))
    query_blocks = per_dim(lambda d: -(-wanted[d] // query_rows))
    known = F.col("dim").isin(dims) if dims else F.lit(False)
    place = F.xxhash64("id", F.lit(seed))
    left = (data.where(known).withColumn("salt", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(64)))
            .withColumn("block", F.pmod(F.xxhash64("id", "salt"), data_blocks)).drop("salt"))
    left = left.withColumn("qblock", F.explode(F.sequence(F.lit(0), query_blocks - 1)))
    right = (asked.where(known).withColumn("qblock", F.pmod(place, query_blocks).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), (data_blocks - 1).cast("long")))))

    def search(a: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(a) and len(q):
            results, _ = search_block(a["id"].to_numpy(np.int64), np.vstack(a["vec"].to_numpy()), q["id"].to_numpy(np.int64),
                                      np.vstack(q["vec"].to_numpy()), k, seed, miss)
            found += [(best.query_ids[best.asked], best.ids, best.scores) for best in results]
        return pd.DataFrame({c: np.concatenate([f[i] for f in found]) for i, c in enumerate(("query_id", "vec_id", "score"))})

    pick = ["dim", "block", "qblock", "id", "vec"]
    found = (left.select(*pick).groupBy("dim", "block", "qblock")
             .cogroup(right.select(*pick).groupBy("dim", "block", "qblock"))
             .applyInPandas(search, "query_id long, vec_id long, score double"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
