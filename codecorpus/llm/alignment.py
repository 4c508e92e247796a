"""Operator 12: alignment of two tokenizers by lockstep merging.

Both token rows of a text spell the same bytes, so a token's end is a byte
offset. The ends of tokenizer A and tokenizer B are merged like two sorted
runs, but for all documents of a batch at once: a state vector holds every
document's place in A and in B; a step advances the place whose token ends
first, or both where they end together, which is a link and a cut; finished
documents are compacted away. Very long documents take several lanes of the
vector, cut at byte offsets, so that no document keeps a batch waiting.

How often two ids are linked in the whole corpus is counted in a second
step from the distinct id pairs of the documents.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import hot_cold_join
from .common import Scratch, columns

#: Tokens of A in one lane of the state vector.
LANE = 1024
#: Distinct id pairs (16 bytes each) that are broadcast; more are joined.
BROADCAST_PAIRS = 1_000_000
#: The marker that stands for a space in B's pieces (fixed value).
SPACE_MARK = "▁"


class Tokenizers:
    """Ids of both tokenizers and the bytes of every id."""

    def __init__(self, ranks_file: str, json_file: str, piece_file: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.json_file = json_file
        self.quick = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                       special_tokens={})
        self.exact = None
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        self.b_bytes = [self._piece_bytes(i) for i in range(self.pieces.get_piece_size())]
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)

    def _piece_bytes(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        if self.pieces.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace(SPACE_MARK, " ").encode("utf-8")

    def a(self, text: str) -> list[int]:
        """The rank file of A's vocabulary gives A's ids faster; the JSON
        tokenizer remains for texts that the quick encoder refuses."""
        try:
            return self.quick.encode_ordinary(text)
        except (ValueError, UnicodeEncodeError, RuntimeError):
            if self.exact is None:
                from tokenizers import Tokenizer
                self.exact = Tokenizer.from_file(self.json_file)
                self.exact.encode_special_tokens = True
            return self.exact.encode(text, add_special_tokens=False).ids

    def both(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Token rows of each text; empty for a null or empty text and where
        a row's bytes are not those of a space and the text."""
        rows_a, rows_b = [], self.pieces.encode([t or "" for t in texts], num_threads=1)
        for i, text in enumerate(texts):
            a = self.a(" " + text) if text else []
            want = (" " + text).encode("utf-8", "surrogatepass") if text else b""
            if not text or b"".join(map(self.a_bytes.__getitem__, a)) != want \
                    or b"".join(map(self.b_bytes.__getitem__, rows_b[i])) != want:
                a = rows_b[i] = []
            rows_a.append(a)
        return rows_a, rows_b


@lru_cache(maxsize=1)
def _tokenizers(files: tuple[str, str, str]) -> Tokenizers:
    return Tokenizers(*files)


def default_files() -> tuple[str, str, str]:
    import public_tokenizers as p
    return p.path("byte_bpe_50k.tiktoken"), p.path("byte_bpe_50k.json"), p.path("piece_bpe_32k.model")


def lanes(ends_a: np.ndarray, first_a: np.ndarray, ends_b: np.ndarray, first_b: np.ndarray,
          size: int = LANE) -> tuple[np.ndarray, ...]:
    """Lanes (from, to) in A and in B of all documents: at most ``size``
    tokens of A each, B's tokens with ends up to the lane's last end in A.

    Ends count from the batch's start, so they rise over documents;
    ``first_*`` are the documents' bounds in the token rows."""
    n = np.diff(first_a)
    per = -(-n // size)
    doc = np.repeat(np.arange(len(n)), per)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    a0 = first_a[doc] + k * size
    a1 = np.minimum(a0 + size, first_a[doc + 1])
    b1 = np.searchsorted(ends_b, ends_a[a1 - 1], side="right")
    b1 = np.where(a1 == first_a[doc + 1], first_b[doc + 1], b1)
    b0 = np.where(k == 0, first_b[doc], np.concatenate(([0], b1[:-1])))
    return a0, a1, b0, b1


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray,
             b1: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of each step: places in A and B of tokens that end together."""
    live = (a0 < a1) & (b0 < b1)
    i, j, i1, j1 = a0[live], b0[live], a1[live], b1[live]
    while len(i):
        x, y = ends_a[i], ends_b[j]
        both = x == y
        if both.any():
            yield i[both], j[both]
        i = i + (x <= y)
        j = j + (y <= x)
        live = (i < i1) & (j < j1)
        if not live.all():
            i, j, i1, j1 = i[live], j[live], i1[live], j1[live]


def _flat(rows: list[list[int]], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all documents in one row, the documents' bounds in it, and the
    tokens' ends counted from the batch's first byte."""
    first = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)
    ids = np.fromiter((x for r in rows for x in r), np.int64, first[-1])
    return ids, first, np.cumsum(sizes[ids])


def align(rows_a: list[list[int]], rows_b: list[list[int]], size_a: np.ndarray, size_b: np.ndarray,
          lane: int = LANE) -> tuple[tuple, tuple, np.ndarray, np.ndarray]:
    """Token rows of a batch -> (ids, bounds) of A and of B, and the links as
    sorted places in A and in B. No token is without bytes, so every common
    end is one link and one cut."""
    ids_a, first_a, ends_a = _flat(rows_a, size_a)
    ids_b, first_b, ends_b = _flat(rows_b, size_b)
    steps = list(lockstep(ends_a, ends_b, *lanes(ends_a, first_a, ends_b, first_b, lane)))
    at_a = np.concatenate([s[0] for s in steps]) if steps else np.empty(0, np.int64)
    at_b = np.concatenate([s[1] for s in steps]) if steps else np.empty(0, np.int64)
    order = np.argsort(at_a)
    return (ids_a, first_a), (ids_b, first_b), at_a[order], at_b[order]


@lru_cache(maxsize=8)
def _written(n: int, mark: str) -> np.ndarray:
    return np.array([f"{i}{mark}" for i in range(n)], object)


def group_digests(a: tuple, b: tuple, at_a: np.ndarray, at_b: np.ndarray, n_a: int, n_b: int) -> list[str]:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3`` of each document, '' without tokens."""
    (ids_a, first_a), (ids_b, first_b) = a, b
    # a token's place in the text: the tokens of its row before it, and those of the other row's finished groups
    group_a = np.searchsorted(at_a, np.arange(len(ids_a)))
    group_b = np.searchsorted(at_b, np.arange(len(ids_b)))
    done_b = np.concatenate(([0], at_b + 1))[group_a]
    done_a = (at_a + 1)[group_b]
    text = np.empty(len(ids_a) + len(ids_b), object)
    text[np.arange(len(ids_a)) + done_b] = _written(n_a, ",")[ids_a]
    text[at_a + done_b[at_a]] = _written(n_a, "|")[ids_a[at_a]]
    text[np.arange(len(ids_b)) + done_a] = _written(n_b, ",")[ids_b]
    text[at_b + done_a[at_b]] = _written(n_b, ";")[ids_b[at_b]]
    bounds = first_a + first_b
    return [hashlib.sha256("".join(text[i:j].tolist())[:-1].encode()).hexdigest() if i < j else ""
            for i, j in zip(bounds[:-1], bounds[1:], strict=True)]


def _aligned(files: tuple[str, str, str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = _tokenizers(files)
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at:at + 1000]
                rows_a, rows_b = t.both([x if isinstance(x, str) else None for x in part["text"]])
                a, b, at_a, at_b = align(rows_a, rows_b, t.a_size, t.b_size)
                links = np.searchsorted(at_a, a[1])
                pair = (a[0][at_a] << 32) | b[0][at_b]
                pairs, times = [], []
                for i, j in zip(links[:-1], links[1:], strict=True):
                    keys, n = np.unique(pair[i:j], return_counts=True)
                    pairs.append(keys)
                    times.append(n)
                yield pd.DataFrame({
                    "doc_id": part["doc_id"], "n_a": np.diff(a[1]), "n_b": np.diff(b[1]), "n_links": np.diff(links),
                    "groups_sha256": group_digests(a, b, at_a, at_b, len(t.a_bytes), len(t.b_bytes)),
                    "pairs": pairs, "times": times})
    return run


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best): how often two ids are linked in the corpus, and
    whether that is the most of the pair's B id."""
    counts = (aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
              .groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("count"), F.count("x.times").alias("rows")))
    most = counts.groupBy(F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b")).agg(F.max("count").alias("most"))
    return (counts.join(most, F.col("pair").bitwiseAND(0xFFFFFFFF) == F.col("b"))
            .select("pair", "count", (F.col("count") == F.col("most")).alias("best"), "rows"))


def alignment(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              files: tuple[str, str, str] | None = None, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256.

    Null and empty texts, and texts whose tokens do not spell a space and
    the text, have no tokens: zeros and ''. Strings of special tokens are
    plain text. Repeated rows each count. An empty table gives no rows; other
    columns of the input are not looked at."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "alignment")
    docs = columns(documents, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = scratch.save(docs.mapInPandas(
        _aligned(files or default_files()), "doc_id long, n_a long, n_b long, n_links long, groups_sha256 string, "
        "pairs array<long>, times array<long>"), "aligned")
    counts = scratch.save(pair_counts(rows), "counts")
    # file and place in it name a row: the saved table does not change
    row = F.struct(F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i"))
    links = rows.select(row.alias("row"), F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(
        "row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    if counts.count() <= broadcast_pairs:
        links = links.join(F.broadcast(counts), "pair")
    else:
        links = hot_cold_join(links, counts, "pair", "rows", how="inner")
    sums = links.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                                    F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    none = F.lit(0).cast("long")
    return (rows.select(row.alias("_row"), "doc_id", "n_a", "n_b", "n_links", "groups_sha256")
            .join(sums, F.col("_row") == F.col("row"), "left")
            .select("doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links",
                    F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"),
                    "groups_sha256"))
