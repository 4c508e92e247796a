"""Operator 2: near-duplicate documents by circulant MinHash.

A document is the set of its distinct 5-word shingles. One permutation
(sigma) scatters the shingles over a ring of 2^32 places; a second one (pi),
circularly shifted by k, gives coordinate k of the signature as the smallest
``pi(sigma(x) + k)``. So two permutations make all coordinates. Bands of
coordinates deal documents to buckets; every pair of a bucket whose sets can
reach the threshold is either confirmed on the full shingle sets or already
connected by confirmed links, so no link that a shared bucket shows can
change a component unseen. With 72 bands of 6 rows a pair at similarity 0.75
misses every bucket with probability 7.5e-7.

How large groups stay cheap, without caps:

* exact copies (equal word sequences) collapse to the smallest id first;
* a bucket's members are first compared with its smallest id only (a star);
* then, in buckets that still hold several components, the rows outside the
  bucket's largest component are compared with the other components' rows.
  These comparisons are not rows: a task streams bounded parts of a bucket,
  with 32-bit shingle sets, and emits only pairs within reach of the
  threshold, each in the first bucket that its documents share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import hot_cold_join
from .common import Scratch, columns
from .components import components

SHINGLE = 5
_CACHE_WORDS = 500_000
_BLOCK = 48


class _WordHashes(dict):
    """64-bit hash of a word, remembered; the memory is emptied at a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lowered: ``bytes.lower`` touches only A-Z and
    ``bytes.split`` cuts at exactly \\x20 and \\x09-\\x0D."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(words: list[bytes], hashes: _WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; the whole sequence
    counts as one if it is shorter; empty without words."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(size, len(h))
    n = len(h) - size + 1
    acc = np.full(n, size, np.uint64)
    for i in range(size):
        acc = (acc ^ h[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(29)
    return np.unique(acc)


def signature(shingles: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Circulant MinHash: coordinate k is ``min pi(sigma(x) + k * step)``
    over the ring of 2^32 places (``step`` is odd, so the shifts are distinct)."""
    x = shingles ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    sigma = (x >> np.uint64(32)).astype(np.uint32)
    first, second = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)
    # pi(y) = second * (z ^ z >> 15) with z = first * y, and first * (x + shift) = first * x + first * shift
    sigma *= first
    shifts = np.arange(length, dtype=np.uint32) * np.uint32(0x9E3779B1) * first
    a, b = np.empty((_BLOCK, length), np.uint32), np.empty((_BLOCK, length), np.uint32)
    out = np.full(length, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(sigma), _BLOCK):
        part = sigma[i:i + _BLOCK]
        p, q = a[:len(part)], b[:len(part)]
        np.add(part[:, None], shifts, out=p)
        np.right_shift(p, np.uint32(15), out=q)
        np.bitwise_xor(p, q, out=p)
        np.multiply(p, second, out=p)
        np.minimum(out, p.min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket key per band."""
    acc = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for column in sig.reshape(bands, rows).T:
        acc = (acc ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(31)
    return acc.view(np.int64)


def _sketcher(bands: int, rows: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()
        for batch in batches:
            sizes, prints, keys = [], [], []
            for text in batch["text"]:
                words = words_of(text)
                s = shingle_set(words, hashes)
                sizes.append(len(s))
                prints.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                keys.append(band_keys(signature(s, bands * rows, seed), bands, rows) if words else None)
            yield pd.DataFrame({"id": batch["id"], "n": sizes, "print": prints, "keys": keys})
    return run


def _verifier(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows arrive sorted by (a, part, leader first): only the current
        leader's set is held."""
        hashes, leader, lead_set = _WordHashes(), None, np.empty(0, np.uint64)
        for batch in batches:
            a_out, b_out = [], []
            for a, part, first, b, text in zip(batch["a"], batch["part"], batch["role"], batch["id"], batch["text"],
                                               strict=True):
                s = shingle_set(words_of(text), hashes)
                if first == 0:
                    leader, lead_set = (a, part), s
                elif leader == (a, part):
                    both = np.intersect1d(lead_set, s, assume_unique=True).size
                    if both and 100 * both >= percent * (lead_set.size + s.size - both):
                        a_out.append(a)
                        b_out.append(b)
            yield pd.DataFrame({"a": np.array(a_out, np.int64), "b": np.array(b_out, np.int64)})
    return run


def small_set(shingles: np.ndarray) -> bytes:
    """The set with 32 bits per shingle, sorted."""
    return np.sort((shingles >> np.uint64(32)).astype(np.uint32)).tobytes()


def _small_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = _WordHashes()
    for batch in batches:
        yield pd.DataFrame({"id": batch["id"], "items": [small_set(shingle_set(words_of(t), hashes))
                                                         for t in batch["text"]]})


def near_pairs(key: int, rows: list[tuple], percent: int, slack: int = 2) -> Iterator[tuple[int, int]]:
    """Pairs of one bucket part: a row outside the bucket's largest component
    with a row of another component, if their 32-bit sets come within
    ``slack`` percent of the threshold and no earlier band shows the pair.

    ``rows``: (minor, id, n, component, band keys, items)."""
    ids = np.array([r[1] for r in rows])
    sizes = np.array([r[2] for r in rows])
    parts = np.array([r[3] for r in rows])
    keys = np.array([r[4] for r in rows])
    sets = [np.frombuffer(r[5], np.uint32) for r in rows]
    band = int(np.flatnonzero(keys[0] == key)[0])
    whole = np.array([not r[0] for r in rows])
    for x in np.flatnonzero(~whole):
        fits = (whole & (parts != parts[x]) & (100 * np.minimum(sizes, sizes[x]) >= percent * np.maximum(sizes, sizes[x])))
        near = np.flatnonzero(fits)
        near = near[(keys[near] == keys[x]).argmax(axis=1) == band]
        if not len(near):
            continue
        items = np.concatenate([sets[i] for i in near])
        at = np.minimum(np.searchsorted(sets[x], items), len(sets[x]) - 1)
        both = np.add.reduceat((sets[x][at] == items).astype(np.int64), np.cumsum([0] + [len(sets[i]) for i in near[:-1]]))
        for i in near[100 * both >= (percent - slack) * (sizes[near] + sizes[x] - both)]:
            yield (int(min(ids[i], ids[x])), int(max(ids[i], ids[x])))


def _bucket_pairs(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows arrive sorted by bucket part; one part is held at a time."""
        part, rows = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for key, i, j, *row in batch.itertuples(index=False, name=None):
                if (key, i, j) != part:
                    if part:
                        out += near_pairs(part[0], rows, percent)
                    part, rows = (key, i, j), []
                rows.append(row)
            yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)
        if part:
            yield pd.DataFrame(list(near_pairs(part[0], rows, percent)), columns=["a", "b"], dtype=np.int64)
    return run


def cross_pairs(rest: DataFrame, percent: int, part_rows: int = 2048) -> DataFrame:
    """Candidate pairs (a, b) across the components of mixed buckets.

    ``rest`` has key, id, n, c, top (the bucket's largest component), keys
    and items. A bucket is dealt into parts of about ``part_rows`` of its rows
    times as many of its minor rows, whatever its size."""
    minor = F.col("c") != F.col("top")
    sizes = rest.groupBy("key").agg(F.ceil(F.count("id") / part_rows).cast("int").alias("wide"),
                                    F.greatest(F.lit(1), F.ceil(F.count_if(minor) / part_rows).cast("int")).alias("tall"))
    rows = rest.join(sizes, "key")
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keep = ["id", "n", "c", "keys", "items"]
    whole = rows.select("key", every("tall").alias("i"), place("wide").alias("j"), F.lit(False).alias("minor"), *keep)
    few = rows.where(minor).select("key", place("tall").alias("i"), F.lit(None).cast("int").alias("j"),
                                   F.lit(True).alias("minor"), *keep, "wide")
    few = few.withColumn("j", every("wide")).drop("wide")
    n = int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (whole.unionByName(few).repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "minor")
            .select("key", "i", "j", "minor", *keep).mapInPandas(_bucket_pairs(percent), "a long, b long"))


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, part_rows: int = 256) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity.

    A pair's first text is sent once per ``part_rows`` partners, so the texts
    of a document with very many partners spread over tasks and no group is
    ever held: tasks stream their sorted rows."""
    spark = pairs.sparkSession
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    roles = (dealt.select("a", "part", F.lit(0).alias("role"), F.col("a").alias("id")).distinct()
             .unionByName(dealt.select("a", "part", F.lit(1).alias("role"), F.col("b").alias("id"))))
    rows = roles.join(texts.hint("merge"), "id")  # neither side has a bound, so neither is broadcast
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (rows.repartition(n, "a", "part").sortWithinPartitions("a", "part", "role")
            .select("a", "part", "role", "id", "text").mapInPandas(_verifier(percent), "a long, b long"))


def _with_parts(pairs: DataFrame, part_rows: int = 256) -> DataFrame:
    """The pairs with the number of parts of their first document; a hub's
    pairs get it without meeting in one task."""
    counts = pairs.groupBy("a").agg(F.count("b").alias("n")).withColumn("parts", F.ceil(F.col("n") / part_rows))
    return hot_cold_join(pairs, counts, "a", "n")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75,
                    bands: int = 72, rows: int = 6, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Texts without words and null texts have an empty set and are linked with
    nothing. Repeated rows share id and component. A row without id links
    with nothing, has no component and is kept. Set members are 64-bit
    hashes of shingles."""
    scratch = Scratch(documents.sparkSession, "minhash")
    docs = columns(documents, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    texts = docs.where("id is not null and text is not null")
    sketch = scratch.save(docs.mapInPandas(_sketcher(bands, rows, seed),
                                           "id long, n long, print binary, keys array<long>"), "sketch")
    ids = scratch.save(sketch.drop("keys"), "ids")
    full = ids.where("n > 0 and id is not null")
    per_id = full.groupBy("print", "id").agg(F.count("n").alias("times"))
    classes = scratch.save(per_id.groupBy("print").agg(F.min(F.struct("id", "times")).alias("first"))
                           .select("print", F.col("first.id").alias("rep"), F.col("first.times").alias("times")), "classes")
    reps = sketch.where("n > 0 and id is not null").join(
        classes.select(F.col("print").alias("_p"), "rep"), (F.col("print") == F.col("_p")) & (F.col("id") == F.col("rep")))
    if not classes.where("times > 1").isEmpty():  # the row of a class's smallest id is repeated
        reps = reps.dropDuplicates(["id", "print"])
    reps = scratch.save(reps.select("id", "n", "keys"), "reps")
    scratch.drop("sketch")
    members = reps.select("id", "n", F.explode("keys").alias("key"))
    leads = (members.groupBy("key").agg(F.min(F.struct("id", "n")).alias("lead"), F.count("id").alias("size"))
             .where("size > 1").select(F.col("key").alias("_k"), "lead"))
    buckets = scratch.save(members.join(leads, F.col("key") == F.col("_k")).select("key", "id", "n", "lead"), "buckets")
    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    alike = buckets.select("id").distinct().hint("merge")  # ids with a candidate; as many as the corpus has
    texts = scratch.save(texts.join(alike, "id", "left_semi"), "texts")
    star = scratch.save(buckets.where((F.col("id") != F.col("lead.id")) & fits(F.col("n"), F.col("lead.n")))
                        .select(F.col("lead.id").alias("a"), F.col("id").alias("b")).distinct(), "star")
    links = scratch.save(confirmed(_with_parts(star), texts, percent), "links-star")
    found = components(links, scratch, "comp-star")

    marked = scratch.save(buckets.select("key", "id", "n").join(found, "id", "left")
                          .select("key", "id", "n", F.coalesce("component", "id").alias("c")), "marked")
    scratch.drop("buckets")
    counts = marked.groupBy("key", "c").agg(F.count("id").alias("size"))
    mixed = (counts.groupBy("key").agg(F.count("c").alias("kinds"), F.max(F.struct("size", "c")).alias("top"))
             .where("kinds > 1").select("key", F.col("top.c").alias("top")))
    rest = scratch.save(marked.join(mixed, "key"), "rest")
    compared = rest.select("id").distinct()
    items = texts.join(compared.hint("merge"), "id", "left_semi").mapInPandas(_small_sets, "id long, items binary")
    views = scratch.save(reps.select("id", "keys").join(items, "id"), "views")
    scratch.drop("reps")
    cross = cross_pairs(rest.join(views.hint("merge"), "id"), percent).distinct().join(star, ["a", "b"], "left_anti")
    cross = scratch.save(cross, "cross")
    more = scratch.save(confirmed(_with_parts(cross), texts, percent), "links-cross")
    final = components(links.unionByName(more), scratch, "comp")
    scratch.drop("marked", "rest", "cross", "star", "views", "texts")

    named = (classes.join(final, classes["rep"] == final["id"], "left")
             .select(F.col("print").alias("_p"), F.coalesce("component", "rep").alias("_c")))
    linked = (full.select("id", "n", "print").join(named, F.col("print") == F.col("_p"), "left")
              .select("id", "n", "_c"))
    alone = ids.where("n = 0 or id is null").select("id", "n", F.col("id").alias("_c"))
    return (linked.unionByName(alone)
            .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("_c").alias("component_id"),
                    F.coalesce(F.col("id") == F.col("_c"), F.lit(True)).alias("kept")))


#: The same rows by brute force: all pairs of documents that share a shingle,
#: exact similarity, smallest reachable id.
ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]) END AS sh FROM words),
items AS (SELECT doc_id, md5_number(unnest(sh)) AS h FROM sets),
sizes AS (SELECT doc_id, len(sh) AS n FROM sets),
both_have AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM items x JOIN items y ON x.h = y.h AND x.doc_id < y.doc_id
  GROUP BY ALL),
links AS (
  SELECT a, b FROM both_have JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * k >= 75 * (p.n + q.n - k)),
edges AS (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links),
reach(id, far) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT id, v FROM reach JOIN edges ON u = far)
SELECT doc_id, n::BIGINT AS n_shingles, min(far)::BIGINT AS component_id, doc_id = min(far) AS kept
FROM sizes JOIN reach ON id = doc_id GROUP BY doc_id, n
"""
