"""Operator 5: best-fit packing of token sequences.

A document is its token ids followed by id 0. Longer ones than a sequence are
cut into full pieces, the first piece taking the remainder. Packing is
planned on the histogram of piece lengths, which has at most ``max_len``
rows whatever the corpus: best-fit decreasing over counts fills whole runs
of equal sequences at once. The plan gives every length its slots as ranges
of ranks; a piece takes the slot of its rank within its length, a join of
ranks found by a distributed sort. Texts are tokenised once, in one narrow
pass; only lengths, not tokens, are shuffled (unless the ids are asked for).
"""

from __future__ import annotations

import base64
import bisect
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import with_row_index
from .common import Scratch, columns

END = 0
MAX_LEN = 2048


class Encoder:
    """Token ids of ``byte_bpe_50k.json``.

    The rank file of the same vocabulary gives the same ids five times as
    fast (tested); the JSON tokenizer remains for texts the quick encoder
    refuses and for texts with the string of an added token, which is that
    token's one id."""

    def __init__(self, ranks_file: str, json_file: str):
        import public_tokenizers
        import tiktoken
        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.json_file = json_file
        with open(json_file, encoding="utf-8") as f:
            self.added = [t["content"] for t in json.load(f).get("added_tokens", [])]
        self.quick = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                       special_tokens={})
        self.exact = None

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        if any(t in text for t in self.added):
            return self.slow(text)
        try:
            return self.quick.encode_ordinary(text)
        except (ValueError, UnicodeEncodeError, RuntimeError):
            return self.slow(text)

    def slow(self, text: str) -> list[int]:
        if self.exact is None:
            from tokenizers import Tokenizer
            self.exact = Tokenizer.from_file(self.json_file)
        return self.exact.encode(text, add_special_tokens=False).ids


def default_files() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def cuts(total: int, max_len: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: one, or a first piece with the
    remainder followed by full ones."""
    first = total if total <= max_len else total % max_len or max_len
    return [(0, first)] + [(s, max_len) for s in range(first, total, max_len)]


def plan(histogram: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Rows (length, rank_from, rank_to, sequence, per, offset): the pieces of
    that length ranked from ``rank_from`` fill sequences ``sequence``,
    ``sequence`` + 1, .. with ``per`` pieces each, the first at ``offset``.
    A piece goes to the fullest sequence it fits, so a sequence that takes
    one piece of a length takes as many as fit."""
    free: dict[int, list[tuple[int, int]]] = {}
    room: list[int] = []

    def put(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            if capacity not in free:
                bisect.insort(room, capacity)
            free.setdefault(capacity, []).append((first, n))

    slots, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(room, length)
            if at == len(room):
                n = -(-left // (max_len // length))
                put(max_len, sequences, n)
                sequences += n
                continue
            capacity = room[at]
            first, n = free[capacity].pop()
            if not free[capacity]:
                del free[capacity], room[at]
            per = min(capacity // length, left)
            used = min(n, left // per)
            slots.append((length, rank, rank + used * per, first, per, max_len - capacity))
            put(capacity, first + used, n - used)
            put(capacity - per * length, first, used)
            left, rank = left - used * per, rank + used * per
    return slots


def _pieces(files: tuple[str, str], max_len: int, with_ids: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = Encoder(*files)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.array([*encode(text), END], "<u4")
                for i, (start, length) in enumerate(cuts(len(ids), max_len)):
                    part = ids[start:start + length]
                    rows.append((doc, i, start, length, zlib.crc32(part.tobytes()))
                                + ((part.astype(np.int32),) if with_ids else ()))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]
                               + ["ids"] * with_ids)
    return run


def pack(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN,
         files: tuple[str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset (and ids, if asked for).

    Null and empty texts are the single id 0. Repeated rows are packed each.
    An empty table gives no rows."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "pack")
    docs = columns(documents, doc_id=id_col, text=text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    pieces = scratch.save(docs.mapInPandas(_pieces(files or default_files(), max_len, with_ids), schema), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("piece").alias("n")).collect()}
    slots = plan(histogram, max_len)
    first, at = [], 0
    for length in sorted(histogram):
        first.append((length, at))
        at += histogram[length]
    firsts = spark.createDataFrame(first, "length long, first long")
    table = spark.createDataFrame(slots, "length long, lo long, hi long, seq long, per long, off long")
    small = F.broadcast if len(slots) <= 200_000 else (lambda df: df)  # one entry per planned run
    placed = (with_row_index(pieces, ["length", "doc_id", "piece", "ids_crc32"], "pos")
              .join(F.broadcast(firsts), "length")  # at most max_len rows
              .withColumn("rank", F.col("pos") - F.col("first"))
              .join(small(table), "length").where("rank >= lo and rank < hi"))
    step = F.col("rank") - F.col("lo")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids,
        (F.col("seq") + F.floor(step / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("off") + (step % F.col("per")) * F.col("length")).cast("long").alias("offset"))
