"""Sequence packing (W2) and the vocabulary job (R2).

Packing is greedy next-fit in the (bin, category, length, id) order: a
window is closed when the next row would overflow ``max_length``. Next-fit
is sequential, but what a stretch of rows does depends only on how full the
window is that enters it: one of ``max_length + 1`` fill levels. So

1. every chunk of consecutive rows of a bin is reduced to a map from entry
   fill to (exit fill, windows closed), all entries at once;
2. maps of neighbouring chunks compose; a tree of compositions, ``fan`` maps
   per step, gives every chunk the entry fill and the window number that the
   first row of its bin implies;
3. every chunk packs its own rows from its entry.

The windows are those of one sequential pass, whatever the chunk size. Only
(position, length) pairs reach Python, at most ``chunk_rows`` per task.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import FIRST_TOKEN_ID, tokens
from ..session import ensure_checkpoint_dir
from .joins import HOT_SHARE, hot_cold_join
from .ordering import category_length_order, with_row_index

cloudpickle.register_pickle_by_value(sys.modules[__name__])

def next_fit(lengths: list[int], max_length: int, used: int = 0, pack: int = 0) -> list[int]:
    """Pack number of each item, items in order, windows of <= max_length,
    continuing a window that already holds ``used``."""
    out = []
    for n in lengths:
        n = min(n, max_length)
        if used and used + n > max_length:
            pack += 1
            used = 0
        used += n
        out.append(pack)
    return out


def fill_map(lengths: np.ndarray, max_length: int) -> tuple[np.ndarray, np.ndarray]:
    """(exit fill, windows closed) for every entry fill 0..max_length.

    From right to left, a fresh window that starts at row i either reaches
    the end or is closed at the first row that overflows it, where the next
    one starts; an entry fill joins these trajectories at its own overflow."""
    n = len(lengths)
    total = np.concatenate([[0], np.cumsum(np.minimum(lengths, max_length))])
    left = np.zeros(n + 1, np.int64)
    closed = np.zeros(n + 1, np.int64)
    over = np.searchsorted(total, total[:-1] + max_length, "right") - 1  # first row that does not fit
    for i in range(n - 1, -1, -1):
        j = over[i]
        left[i], closed[i] = (total[n] - total[i], 0) if j >= n else (left[j], closed[j] + 1)
    entry = np.arange(max_length + 1)
    first = np.searchsorted(total, max_length - entry, "right") - 1
    through = first >= n
    at = np.minimum(first, n)
    fill = np.where(through, entry + total[n], left[at])
    return fill, np.where(through, 0, closed[at] + 1)


def _chunk_map(max_length: int):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        fill, closed = fill_map(pdf["length"].to_numpy(), max_length)
        return pd.DataFrame({"bin": pdf["bin"].iloc[:1], "idx": pdf["chunk"].iloc[:1],
                             "fill": [fill], "closed": [closed]})
    return fn


def _compose(pdf: pd.DataFrame) -> pd.DataFrame:
    """One map for a run of neighbouring maps."""
    pdf = pdf.sort_values("idx")
    fill = closed = None
    for f, c in zip(pdf["fill"], pdf["closed"]):
        if fill is None:
            fill, closed = np.asarray(f), np.asarray(c)
        else:
            fill, closed = np.asarray(f)[fill], closed + np.asarray(c)[fill]
    return pd.DataFrame({"bin": pdf["bin"].iloc[:1], "idx": pdf["up"].iloc[:1], "fill": [fill], "closed": [closed]})


def _descend(pdf: pd.DataFrame) -> pd.DataFrame:
    """Entry (fill, window) of each map of a run whose first entry is known."""
    pdf = pdf.sort_values("idx")
    used, pack, out = int(pdf["entry"].iloc[0]), int(pdf["base"].iloc[0]), []
    for i, f, c in zip(pdf["idx"], pdf["fill"], pdf["closed"]):
        out.append((pdf["bin"].iloc[0], i, used, pack))
        pack, used = pack + int(c[used]), int(f[used])
    return pd.DataFrame(out, columns=["bin", "idx", "entry", "base"])


def _pack_chunk(max_length: int):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        packs = next_fit(pdf["length"].tolist(), max_length, int(pdf["entry"].iloc[0]), int(pdf["base"].iloc[0]))
        return pd.DataFrame({"pos": pdf["pos"].to_numpy(), "window": packs})
    return fn


def pack(df: DataFrame, id_col: str, length_col: str, max_length: int, bin_col: str = "bin",
         category_col: str = "seq_category", chunk_rows: int = 200_000, fan: int = 256) -> DataFrame:
    """W1 + W2: the order's columns with ``pos`` (W1 order) and ``window``
    (numbered from 0 in each bin). Rows longer than ``max_length`` fill a
    window alone (their tokens are truncated by R5)."""
    order = category_length_order(category_col, length_col, id_col, bin_col)
    ordered = with_row_index(df.select(*order), order, "pos")  # token arrays stay out of the sort
    kind = ordered.schema[bin_col].dataType.simpleString()
    rows = ordered.select(F.col(bin_col).alias("bin"), "pos", F.col(length_col).cast("long").alias("length"),
                          (F.col("pos") / chunk_rows).cast("long").alias("chunk"))
    maps = f"bin {kind}, idx long, fill array<long>, closed array<long>"
    levels = [rows.groupBy("bin", "chunk").applyInPandas(_chunk_map(max_length), maps).checkpoint()]
    height = levels[0].agg(F.max("idx")).first()[0] or 0
    while height > 0:
        up = levels[-1].withColumn("up", F.floor(F.col("idx") / fan))
        levels.append(up.groupBy("bin", "up").applyInPandas(_compose, maps).checkpoint())
        height //= fan
    entries = levels[-1].select("bin", "idx", F.lit(0).cast("long").alias("entry"), F.lit(0).cast("long").alias("base"))
    for level in reversed(levels[:-1]):
        parent = entries.select(F.col("bin").alias("_b"), F.col("idx").alias("_i"), "entry", "base")
        runs = level.withColumn("up", F.floor(F.col("idx") / fan))
        entries = (runs.join(parent, F.col("bin").eqNullSafe(F.col("_b")) & (F.col("up") == F.col("_i"))).drop("_b", "_i")
                   .groupBy("bin", "up").applyInPandas(_descend, f"bin {kind}, idx long, entry long, base long"))
    entries = entries.select(F.col("bin").alias("_b"), F.col("idx").alias("_i"), "entry", "base")
    windows = (rows.join(entries, F.col("bin").eqNullSafe(F.col("_b")) & (F.col("chunk") == F.col("_i")))
               .groupBy("bin", "chunk").applyInPandas(_pack_chunk(max_length), "pos long, window long"))
    return ordered.join(windows, "pos")


def packed_rows(windows: DataFrame, ids: DataFrame, id_col: str, max_length: int, bin_col: str = "bin",
                ids_col: str = "input_ids") -> DataFrame:
    """W2's rows: per window the truncated ids of its rows in W1 order, and
    labels equal to them. Rows without tokens add nothing and are left out
    of the gathering, so a window gathers at most ``max_length`` rows."""
    cut = ids.select(id_col, F.slice(ids_col, 1, max_length).alias("_ids")).where(F.size("_ids") > 0)
    got = windows.join(cut, id_col).groupBy(bin_col, "window").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_ids"))), lambda x: x["_ids"])).alias("input_ids"))
    return got.withColumn("labels", F.col("input_ids"))


def vocabulary(token_rows: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """R2 vocabulary: (token, n, id); ids are dense from ``FIRST_TOKEN_ID``
    by descending count, then token. Counting runs map-side first, so a
    token holding a third of all occurrences is one row per task before
    the shuffle."""
    counts = (token_rows.select(F.explode(tokens_col).alias("token"))
              .groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    ranked = with_row_index(counts, [F.col("n").desc(), F.col("token")], "rank")
    return ranked.select("token", "n", (F.col("rank") + FIRST_TOKEN_ID).cast("int").alias("id"))


#: The most frequent tokens, of at most so many characters, that every task holds.
COMMON, COMMON_CHARS = 1 << 16, 64


def _common_ids(names: list[str], ids: list[int], key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per row: its tokens' ids (0: not a common token) and the others with their positions."""
        known, values = pa.array(names, pa.string()), pa.array(ids, pa.int32())
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            lens = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(lens)])
            got = values.take(pc.index_in(flat, known))
            rest = np.flatnonzero(pc.is_null(got).to_numpy(zero_copy_only=False))
            others = pa.StructArray.from_arrays([pa.array((rest - np.repeat(ends[:-1], lens)[rest]).astype(np.int32)),
                                                 flat.take(pa.array(rest))], ["p", "token"])
            cuts = np.searchsorted(rest, ends)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pc.fill_null(got, 0)),
                pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), others)], [key, "_ids", "_rest"])
    return run


def encode(rows: DataFrame, key: str, text_col: str, vocab: DataFrame, out: str = "input_ids",
           hot_share: int = HOT_SHARE, tokens_col: str | None = None) -> DataFrame:
    """R2 encode: token ids of ``text_col`` in text order, one array per row.
    ``tokens_col`` names a column that holds the tokens already.

    The ``COMMON`` most frequent tokens get their ids map-side, where the row's
    tokens are. Only the others, with their positions, shuffle to the vocabulary
    (one with more than one use in ``hot_share`` is joined map-side there). Ids
    are then gathered per row and put in position order.
    """
    # ids go by descending count: a filter, no top list of every partition
    common = vocab.where((F.col("id") < FIRST_TOKEN_ID + COMMON) & (F.length("token") <= COMMON_CHARS)).select("token", "id").collect()
    toks = rows.select(key, (F.col(tokens_col) if tokens_col else tokens(F.col(text_col))).alias("_t"))
    kind = toks.schema[key].dataType.simpleString()
    # read twice: tokens are cut and looked up once
    ensure_checkpoint_dir(rows.sparkSession)
    found = toks.mapInArrow(_common_ids([r["token"] for r in common], [r["id"] for r in common], key),
                            f"`{key}` {kind}, _ids array<int>, _rest array<struct<p:int,token:string>>").checkpoint()
    flat = found.select(key, F.explode("_rest").alias("r")).select(key, "r.p", "r.token")
    ided = hot_cold_join(flat, vocab.select("token", "n", "id"), "token", "n", hot_share, how="inner")
    none = F.lit(None)
    both = found.select(key, "_ids", none.cast("struct<p:int,id:int>").alias("_one")).unionByName(
        ided.select(key, none.cast("array<int>").alias("_ids"), F.struct("p", "id").alias("_one")))
    placed = F.flatten(F.transform(F.collect_list("_ids"), lambda ids: F.filter(
        F.transform(ids, lambda x, i: F.struct(i.alias("p"), x.alias("id"))), lambda s: s["id"] != 0)))
    enc = both.groupBy(key).agg(F.transform(F.array_sort(F.concat(placed, F.collect_list("_one"))), lambda s: s["id"]).alias(out))
    return rows.join(enc, key, "left").withColumn(out, F.coalesce(F.col(out), F.array().cast("array<int>")))
