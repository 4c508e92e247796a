"""Global order, splits, shards and batches.

A global row position is the one thing these operators need that plain SQL
would compute with ``row_number() OVER (ORDER BY ..)`` - a window that pulls
every row into one task. ``with_row_index`` computes it distributed in two
passes instead:

1. ``orderBy`` (range partitioning + sort within partitions); each row is
   tagged with its partition id and its rank inside the partition; the result
   is checkpointed to the shared checkpoint folder so both passes see the
   same partitioning even if an executor is lost.
2. Row counts per partition (one row per partition) are turned into
   starting offsets; that table has exactly ``numPartitions`` rows, so its
   broadcast has a proven size bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.permutation import RoundHash, hash_round, permuted, unpermuted
from ..session import ensure_checkpoint_dir


def _cols(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def with_row_index(df: DataFrame, order: Sequence[str | Column], name: str = "pos") -> DataFrame:
    """0-based position of each row in the total order ``order`` (make the
    order total by ending it with a unique key)."""
    ensure_checkpoint_dir(df.sparkSession)
    tagged = (df.orderBy(*_cols(order))
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_rin", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
              .checkpoint(eager=True))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"))
    return (tagged.join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.col("_off") + F.col("_rin"))
            .drop("_pid", "_rin", "_off"))


def category_length_order(category: str = "seq_category", length: str = "seq_length", tie: str = "row_id",
                          bin_col: str | None = None) -> list[str]:
    """Ascending (category, length), a unique id as tie-break; inside
    bins, if there are any."""
    return [*([bin_col] if bin_col else []), category, length, tie]


def seeded_order_key(id_col: str, seed: int, epoch: int) -> Column:
    """Per-epoch shuffle key: a hash of (id, seed, epoch)."""
    return F.xxhash64(F.col(id_col), F.lit(seed), F.lit(epoch))


def sharded_order(df: DataFrame, id_col: str, replicas: int, seed: int = 0, epoch: int = 0,
                  start_index: int = 0, drop_last: bool = False, order_key: Column | None = None) -> DataFrame:
    """Seeded per-epoch order split over ``replicas``; each replica skips
    its first ``start_index`` positions (resume). ``order_key`` replaces the
    default hash key (any deterministic per-row Column). Without ``drop_last`` the
    order is padded with its own first rows up to a multiple of
    ``replicas``; with it, the tail is dropped. Adds ``rank`` and
    ``local_pos`` (position within the replica after the skip)."""
    key = seeded_order_key(id_col, seed, epoch) if order_key is None else order_key
    pos = with_row_index(df, [key, F.col(id_col)], "_p")
    n = pos.agg(F.count(F.lit(1))).first()[0]
    if drop_last:
        total = (n // replicas) * replicas
        rows = pos.where(F.col("_p") < total)
    else:
        total = -(-n // replicas) * replicas
        pad = total - n
        rows = pos
        if pad:
            # padding repeats the order from its start (cycling if pad > n)
            reps = F.sequence(F.lit(1), F.lit(-(-pad // n) if n else 0))
            extra = (pos.withColumn("_k", F.explode(reps))
                     .withColumn("_p", F.col("_p") + F.col("_k") * n).drop("_k")
                     .where(F.col("_p") < total))
            rows = pos.unionByName(extra)
    out = (rows.withColumn("rank", (F.col("_p") % replicas).cast("int"))
           .withColumn("local_pos", (F.col("_p") / replicas).cast("long") - start_index)
           .where(F.col("local_pos") >= 0))
    return out.drop("_p")


def arithmetic_order(df: DataFrame, index: str, n: int, replicas: int, seed: int = 0, epoch: int = 0,
                     start_index: int = 0, drop_last: bool = False, h: RoundHash = hash_round) -> DataFrame:
    """W3 without a sort: rows that carry their 0-based input position (0 to
    n - 1, see ``sources.positions``) get ``rank`` and ``local_pos`` by
    arithmetic, a seeded permutation of the positions. Same padding, tail and
    resume rules as ``sharded_order``. Narrow: an epoch exchanges no row, and a
    resume is a filter."""
    total = (n // replicas) * replicas if drop_last else -(-n // replicas) * replicas
    place = permuted(F.col(index), n, seed, epoch, h)
    # the order is repeated from its start up to a multiple of replicas: places p, p + n, ..
    last = F.call_function("div", F.lit(total - 1).cast("long") - F.col("_p"), F.lit(max(n, 1)).cast("long"))
    every = F.when(F.col("_p") < total, F.sequence(F.lit(0).cast("long"), last)).otherwise(
        F.array().cast("array<bigint>"))
    rows = df.withColumn("_p", place).withColumn("_k", F.explode(every)).withColumn("_p", F.col("_p") + F.col("_k") * n)
    out = (rows.withColumn("rank", (F.col("_p") % replicas).cast("int"))
           .withColumn("local_pos", F.call_function("div", F.col("_p"), F.lit(replicas).cast("long")) - start_index))
    return out.where(F.col("local_pos") >= 0).drop("_p", "_k")


def order_range(spark: SparkSession, n: int, replicas: int, rank: int, start: int, stop: int, seed: int = 0,
                epoch: int = 0, drop_last: bool = False, h: RoundHash = hash_round) -> DataFrame:
    """The other direction: (local_pos, row_index) of the places ``start`` to
    ``stop`` - 1 of one replica, from the places alone. A resumed reader
    fetches just these rows; nothing before them is looked at."""
    local = (n // replicas) if drop_last else -(-n // replicas)
    places = spark.range(start, max(start, min(stop, local)) if n else start).withColumnRenamed("id", "local_pos")
    return places.select("local_pos", unpermuted((F.col("local_pos") * replicas + rank) % max(n, 1), n, seed, epoch, h)
                         .alias("row_index"))


def batch_number(pos: str | Column, size: int) -> Column:
    """Consecutive fixed-size batches of a 0-based position."""
    p = F.col(pos) if isinstance(pos, str) else pos
    return (p / size).cast("long")


def running_number(df: DataFrame, order: Sequence[str], name: str = "file_no") -> DataFrame:
    """One counter over the whole order (0-based)."""
    return with_row_index(df, order, name)


def contiguous_split(df: DataFrame, order: Sequence[str], split: int, name: str = "part") -> DataFrame:
    """``split`` contiguous parts of ``int(N / split)`` rows, the last
    taking the rest; ``split = 0`` keeps everything in part 0."""
    pos = with_row_index(df, order, "_p")
    if split == 0:
        return pos.withColumn(name, F.lit(0)).drop("_p")
    n = pos.agg(F.count(F.lit(1))).first()[0]
    size = n // split
    if size == 0:
        part = F.lit(split - 1)
    else:
        part = F.least((F.col("_p") / size).cast("int"), F.lit(split - 1))
    return pos.withColumn(name, part).drop("_p")


def percent_bins(n_bins: int) -> list[tuple[int, int]]:
    """P13 boundaries in percent: slices of ``ceil(100 / n_bins)`` percent,
    the last clipped at 100."""
    if n_bins >= 100000:
        raise ValueError("too many bins, must be smaller than 100000")
    step = -(-100 // n_bins)
    return [(i, min(i + step, 100)) for i in range(0, 100, step)]


def percent_split(df: DataFrame, order: Sequence[str], n_bins: int, name: str = "bin") -> DataFrame:
    """Row position -> percent slice, boundaries rounded to the closest
    row (half to even) like the original ``train[a%:b%]`` slices."""
    pos = with_row_index(df, order, "_p")
    n = pos.agg(F.count(F.lit(1))).first()[0]
    starts = [round(a * n / 100.0) for a, _ in percent_bins(n_bins)]
    ends = [round(b * n / 100.0) for _, b in percent_bins(n_bins)]
    starts_col = F.array(*[F.lit(s) for s in starts])
    ends_col = F.array(*[F.lit(e) for e in ends])
    b = F.size(F.filter(starts_col, lambda s: s <= F.col("_p"))) - 1
    return (pos.withColumn(name, b)
            .where(F.col("_p") < F.element_at(ends_col, F.col(name) + 1))
            .drop("_p"))


def random_peek(df: DataFrame, key: str, n: int, seed: int = 0, order_key: Column | None = None) -> DataFrame:
    """``n`` pseudo-random rows, deterministic for a seed (a top-n by
    hash: each task keeps n rows, the driver sees n x tasks at most).
    ``order_key`` replaces the default hash."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)) if order_key is None else order_key, F.col(key)).limit(n)


def capped(df: DataFrame, order: Sequence[str], max_rows: int) -> DataFrame:
    """P10: the first ``max_rows`` rows in a defined order."""
    return df.orderBy(*_cols(order)).limit(max_rows)


def strided(df: DataFrame, idx: str, stride: int = 4) -> DataFrame:
    """File number ``j * stride + i`` is level ``i`` of task ``j``."""
    return (df.withColumn("level", F.pmod(F.col(idx), F.lit(stride)))
            .withColumn("task", (F.col(idx) / stride).cast("long")))
