"""JSON arrays read by several tasks.

A file that holds one array is cut at ``}`` by the text reader, whose splits
are byte ranges, so a file of any size is read by as many tasks as it has
splits. Whether a piece begins inside a string, and at which depth, follows
from all text before it. A split is therefore reduced to a map: for each of
the two ways to enter it (outside or inside a string) the way it is left and
the change of depth. Maps compose along the file, which gives every split its
entry; after that every split cuts its own records, at the pieces that end
outside strings at depth 1. A record that several splits share is put
together from its fragments, at most two a split.

Records are objects. A cut between a backslash and ``}`` would need the
escape ``\\}``, which JSON does not have.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ensure_checkpoint_dir
from .positions import tagged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ESCAPED = re.compile(r"\\.", re.S)
#: What follows the last record, with the "}" it is counted with.
_END = re.compile(r"\s*(\[\s*)?\]\s*\}")
_WHOLE, _TAIL, _THROUGH, _HEAD, _LAST = 0, 1, 2, 3, 4


def piece_map(piece: str) -> tuple[bool, int, int]:
    """(does the string state change, depth change when entered outside a
    string, depth change when entered inside one)."""
    runs = _ESCAPED.sub("", piece).split('"')

    def depth(texts: list[str]) -> int:
        return sum(t.count("{") + t.count("[") - t.count("}") - t.count("]") for t in texts)
    return len(runs) % 2 == 0, depth(runs[::2]), depth(runs[1::2])


def _split_maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each split: its pieces' maps composed."""
    at, flips, out, inside = None, False, 0, 0
    done = []
    for batch in batches:
        for file, start, value in zip(batch["_file"], batch["_start"], batch["value"], strict=True):
            if (file, start) != at:
                if at:
                    done.append((*at, flips, out, inside))
                at, flips, out, inside = (file, start), False, 0, 0
            change, a, b = piece_map(value + "}")
            out, inside = (out + b, inside + a) if flips else (out + a, inside + b)
            flips ^= change
    if at:
        done.append((*at, flips, out, inside))
    yield pd.DataFrame(done, columns=["file", "start", "flips", "out", "inside"])


_ENTRY = "file string, start long, in_string boolean, depth long, last boolean"


def _entries(rows: pd.DataFrame) -> pd.DataFrame:
    """Entry state of every split of one file, and whether it is the last."""
    rows = rows.sort_values("start")
    state, depth, out = False, 0, []
    for file, start, flips, plain, inside in rows.itertuples(index=False, name=None):
        out.append((file, start, state, depth, False))
        depth += inside if state else plain
        state ^= flips
    out[-1] = (*out[-1][:4], True)
    # the reader's last piece ends without the "}" that it is counted with
    if state or depth != -1:
        raise ValueError(f"top level is not a JSON array, or it is cut off: {rows['file'].iloc[0]}")
    return pd.DataFrame(out, columns=["file", "start", "in_string", "depth", "last"])


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records of every split; what is left open at its two ends as fragments."""
    at, held, whole, state, depth = None, [], True, False, 0
    for batch in batches:
        rows: list[tuple] = []
        for file, start, value, in_string, entry, last in zip(
                *(batch[c] for c in ("_file", "_start", "value", "in_string", "depth", "last")), strict=True):
            if (file, start) != at:
                if at:
                    rows += _open_end(at, held, whole, was_last)
                at, held, state, depth = (file, start), [], bool(in_string), int(entry)
                whole = not state and depth <= 1  # the split begins between two records
            was_last = last
            held.append(value + "}")
            change, plain, inside = piece_map(held[-1])
            depth += inside if state else plain
            state ^= change
            if depth == 1 and not state:
                rows.append((*at, _WHOLE if whole else _TAIL, "".join(held)))
                held, whole = [], True
        yield _frame(rows)
    if at:
        yield _frame(_open_end(at, held, whole, was_last))


def _open_end(at: tuple, held: list[str], whole: bool, last: bool) -> list[tuple]:
    if not held:
        return []
    if last and not _END.fullmatch("".join(held)):
        raise ValueError(f"malformed end of a JSON array: {''.join(held)[:80]!r}")
    kind = _LAST if last else _HEAD if whole else _THROUGH
    return [(*at, kind, "".join(held))]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["file", "start", "kind", "text"])


def read_json_array(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Files that hold one JSON array of objects each, pretty-printed or
    not, any size. The depths of all splits are found by a first scan, which
    runs at once; a file whose top level is not an array, or is cut off,
    fails there. A malformed record fails the read when it is computed."""
    ensure_checkpoint_dir(spark)
    pieces = tagged(spark.read.text(path, lineSep="}"))
    maps = pieces.select("_file", "_start", "value").mapInPandas(
        _split_maps, "file string, start long, flips boolean, out long, inside long")
    # one row for each split, which the driver plans anyway: small enough to broadcast
    entries = maps.groupBy("file").applyInPandas(_entries, _ENTRY).checkpoint(eager=True)
    known = pieces.join(F.broadcast(entries), (F.col("_file") == F.col("file")) & (F.col("_start") == F.col("start")))
    rows = known.select("_file", "_start", "value", "in_string", "depth", "last").mapInPandas(
        _records, "file string, start long, kind int, text string")
    texts = rows.where(F.col("kind") == _WHOLE).select("text")
    shared = entries.where("in_string or depth > 1")
    if not shared.isEmpty():
        parts = rows.where(F.col("kind").isin(_TAIL, _THROUGH, _HEAD))
        so_far = Window.partitionBy("file").orderBy("start", "kind")
        parts = parts.withColumn("opened", F.max(F.when(F.col("kind") == _HEAD, F.col("start"))).over(so_far))
        texts = texts.unionByName(parts.groupBy("file", "opened").agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "").alias("text")).select("text"))
    # "[" opens the first record, "," every other one
    body = F.regexp_replace("text", r"\A\s*[\[,]\s*(?=\{)", "")
    told = F.concat(F.lit("malformed record in a JSON array: "), F.substring("text", 1, 80))
    one = F.when(body.startswith("{"), F.from_json(body, schema, {"mode": "FAILFAST"})).otherwise(
        F.raise_error(told).cast(schema))
    return texts.select(one.alias("r")).select("r.*")
