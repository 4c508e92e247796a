"""Operator 11: how far the sources of a language diverge in their terms.

Counting is single-pass in-memory indexing: a task keeps a block of postings
(term -> occurrences and documents, for each language and source) until the
block is full, then spills it as term-sorted runs, one for each language and
hash shard. A shard's runs are merged with a heap into frequencies; terms in
too few documents of their language go.

A term's share is an integer, p = 1 + floor(10^9 (count + 5) / (N + 5 V)), so
a source without the term has one constant share. A pair of sources starts
at V times the difference of their constants; kept terms then stream by, and
each corrects the pairs of the sources that hold it. A task hands on one sum
for each pair, never a row for a term and a pair.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, columns

#: Fixed values of the measure.
MIN_DOCS, SCALE, PRIOR, TOP = 30, 10 ** 9, 5, 50
#: Postings of a block and bytes of its texts (so that its counts fit 32 bits); a full block spills.
BLOCK_POSTINGS, BLOCK_BYTES = 400_000, 1 << 30
#: Postings of the runs that a merge holds before it makes them one run.
MERGE_POSTINGS = 1_000_000
#: Bytes of input files for one hash shard (at most one shard for each shuffle partition).
SHARD_BYTES = 8 << 20
#: Kept terms of a language in one task of the pair corrections, and sources
#: that are the first of its pairs.
PAIR_TERMS, PAIR_SOURCES = 50_000, 100

#: Bytes that are no part of a term (fixed values): all ASCII but letters.
#: A-Z become lower-case, letters and bytes of other characters stay.
_FOLD = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_RUN = ("shard int, lang string, names array<string>, terms array<binary>, sources array<int>, counts array<int>, "
        "docs array<int>")


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a UTF-8 text: runs of letters and non-ASCII characters, only
    A-Z lowered."""
    return text.translate(_FOLD).split() if text else []


class Block:
    """Postings of one task until memory fills."""

    def __init__(self, shards: int):
        self.shards, self.size, self.bytes = shards, 0, 0
        self.postings: dict[str, dict[str, tuple[Counter, Counter]]] = {}

    def add(self, lang: str, source: str, text: bytes) -> None:
        terms = terms_of(text)
        if not terms:
            return
        counts, docs = self.postings.setdefault(lang, {}).setdefault(source, (Counter(), Counter()))
        self.size -= len(counts)
        counts.update(terms)
        docs.update(set(terms))
        self.size += len(counts)
        self.bytes += len(text)

    def spill(self) -> Iterator[pa.RecordBatch]:
        """The block as runs sorted by term and source, one row per language
        and shard. A run names its sources once."""
        for lang, held in self.postings.items():
            names = sorted(held)
            terms = [t for name in names for t in held[name][0]]
            columns = [[n for name in names for n in map(held[name][i].__getitem__, held[name][0])] for i in (0, 1)]
            sources = np.repeat(np.arange(len(names)), [len(held[name][0]) for name in names])
            order = np.array(sorted(range(len(terms)), key=terms.__getitem__))  # equal terms stay in source order
            shard = np.fromiter(map(crc32, terms), np.int64, len(terms))[order] % self.shards
            by_shard = np.argsort(shard, kind="stable")
            shard, order = shard[by_shard], order[by_shard]
            first = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
            bounds = pa.array(np.append(first, len(terms)).astype(np.int32))

            def lists(values, kind: pa.DataType) -> pa.Array:
                return pa.ListArray.from_arrays(bounds, pa.array(values, kind).take(pa.array(order)))
            n = len(first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard[first].astype(np.int32)), pa.array([lang] * n), pa.array([names] * n, pa.list_(pa.string())),
                 lists(terms, pa.binary()), lists(sources, pa.int32()), *[lists(c, pa.int32()) for c in columns]],
                names=["shard", "lang", "names", "terms", "sources", "counts", "docs"])
        self.postings, self.size, self.bytes = {}, 0, 0


def _indexer(shards: int, block_postings: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(shards)
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block.add(lang, source, text)
                if block.size >= block_postings or block.bytes >= BLOCK_BYTES:
                    yield from block.spill()
        yield from block.spill()
    return run


def merge_runs(runs: list[Iterable[tuple]]) -> Iterator[tuple]:
    """(term, source, occurrences, documents) of term-sorted runs, summed, in
    order: a heap holds the head of every run."""
    term = source = None
    for t, s, x, y in heapq.merge(*runs):
        if t == term and s == source:
            n += x
            docs += y
            continue
        if term is not None:
            yield term, source, n, docs
        term, source, n, docs = t, s, x, y
    if term is not None:
        yield term, source, n, docs


def kept_terms(runs: list[Iterable[tuple]], min_docs: int) -> Iterator[tuple[bytes, list[str], list[int]]]:
    """(term, sources, occurrences) of the terms that enough documents hold."""
    term, seen, sources, counts = None, 0, [], []
    for t, s, n, docs in merge_runs(runs):
        if t != term:
            if seen >= min_docs:
                yield term, sources, counts
            term, seen, sources, counts = t, 0, [], []
        seen += docs
        sources.append(s)
        counts.append(n)
    if seen >= min_docs:
        yield term, sources, counts


def _values(cell: pa.Scalar) -> list:
    """A list cell as a Python list, without an object for each scalar."""
    return cell.values.to_numpy(zero_copy_only=False).tolist()


def _merger(min_docs: int, merge_postings: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs arrive sorted by (lang, shard): one shard of one language is
        merged at a time, early when its runs grow beyond the bound."""
        at, runs, held, limit = None, [], 0, merge_postings
        for batch in batches:
            for row in range(batch.num_rows):
                shard, lang, names = (batch.column(i)[row].as_py() for i in range(3))
                terms, sources, counts, docs = (_values(batch.column(i)[row]) for i in range(3, 7))
                if (lang, shard) != at:
                    if runs:
                        yield from _kept(at, runs)
                    at, runs, held, limit = (lang, shard), [], 0, merge_postings
                runs.append(zip(terms, map(names.__getitem__, sources), counts, docs))
                held += len(terms)
                if held > limit and len(runs) > 1:
                    runs = [list(merge_runs(runs))]
                    held = len(runs[0])
                    limit = max(merge_postings, 2 * held)
        if runs:
            yield from _kept(at, runs)

    def _kept(at: tuple[str, int], runs: list[Iterable[tuple]]) -> Iterator[pa.RecordBatch]:
        rows = list(kept_terms(runs, min_docs))
        for i in range(0, len(rows), 10_000):
            terms, sources, counts = zip(*rows[i:i + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([at[0]] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string()),
                 pa.array(sources, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))],
                names=["lang", "term", "sources", "counts"])
    return run


def frequencies(documents: DataFrame, scratch: Scratch, min_docs: int = MIN_DOCS, block_postings: int = BLOCK_POSTINGS,
                merge_postings: int = MERGE_POSTINGS) -> DataFrame:
    """(lang, term, sources, counts): the kept terms of each language
    with their occurrences in each source that holds them.

    ``documents`` has lang, source and text without nulls."""
    partitions = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    shards = max(1, min(partitions, -(-size // SHARD_BYTES)))
    runs = documents.select("lang", "source", F.col("text").cast("binary")).mapInArrow(
        _indexer(shards, block_postings), _RUN)
    merged = runs.repartition(partitions, "lang", "shard").sortWithinPartitions("lang", "shard").mapInArrow(
        _merger(min_docs, merge_postings), "lang string, term string, sources array<string>, counts array<long>")
    return scratch.save(merged, "frequencies")


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (N + 5 V)), in whole numbers of 38 digits."""
    wide = "decimal(20,0)"
    return (F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + PRIOR).cast(wide),
                            (n + PRIOR * v).cast(wide)) + 1).cast("long")


def corrections(shares: np.ndarray, held: np.ndarray, absent: np.ndarray, mine: range) -> tuple[np.ndarray, np.ndarray]:
    """For the sources of ``mine`` and every source: the sum, over the terms
    that the first holds, of |p_a - p_b| - |absent_a - absent_b|, and the part
    of it from terms that both hold. Terms that neither holds need none.

    ``shares``: terms x sources; ``held``: where a source holds the term."""
    one = np.zeros((len(mine), len(absent)), np.int64)
    both = np.zeros_like(one)
    for row, a in enumerate(mine):
        at = np.flatnonzero(held[:, a])
        d = np.abs(shares[at, a][:, None] - shares[at]) - np.abs(absent[a] - absent)
        one[row] = d.sum(axis=0)
        both[row] = (d * held[at]).sum(axis=0)
    return one, both


def _pair_sums(pair_sources: int, cells: int = 2_000_000):
    def run(key: tuple, terms: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        """One shard of a language's kept terms, all its sources, and one cut
        of them as the first of the pairs."""
        if terms.empty or len(groups) < 2:
            return _rows(key[0], [], [], [])
        groups = groups.sort_values("source")
        names = groups["source"].tolist()
        place = {s: i for i, s in enumerate(names)}
        n, v = [int(x) for x in groups["n"]], int(groups["v"].iloc[0])
        absent = np.array([1 + SCALE * PRIOR // (x + PRIOR * v) for x in n], np.int64)
        mine = range(key[2] * pair_sources, min((key[2] + 1) * pair_sources, len(n)))
        one, both = np.zeros((2, len(mine), len(n)), np.int64)
        step = max(1, cells // len(n))
        for i in range(0, len(terms), step):
            part = terms.iloc[i:i + step]
            shares = np.tile(absent, (len(part), 1))
            held = np.zeros(shares.shape, bool)
            for row, (sources, counts) in enumerate(zip(part["sources"], part["counts"], strict=True)):
                for s, c in zip(sources, counts, strict=True):
                    x = place[s]
                    shares[row, x] = 1 + SCALE * (int(c) + PRIOR) // (n[x] + PRIOR * v)
                    held[row, x] = True
            x, y = corrections(shares, held, absent, mine)
            one, both = one + x, both + y
        # a pair's sum: what its first holds, what its second holds, less what both hold
        a, b = np.nonzero(one)
        c, d = np.nonzero(one - both)
        return _rows(key[0], [names[mine[i]] for i in c] + [names[i] for i in b],
                     [names[i] for i in d] + [names[mine[i]] for i in a], np.concatenate([(one - both)[c, d], one[a, b]]))
    return run


def _rows(lang: str, source: list[str], item: list[str], value) -> pd.DataFrame:
    text = {"lang": [lang] * len(source), "source": source, "item": item}
    return pd.DataFrame({**{k: pd.Series(v, dtype=object) for k, v in text.items()}, "value": np.array(value, np.int64)})


def divergence(documents: DataFrame, lang: str = "lang", source: str = "source", text: str = "text",
               min_docs: int = MIN_DOCS, top: int = TOP, block_postings: int = BLOCK_POSTINGS,
               pair_terms: int = PAIR_TERMS, pair_sources: int = PAIR_SOURCES) -> DataFrame:
    """Rows (lang, source, part, item, value, rank).

    Part ``pair``: the other sources of the language, by the sum of share
    differences over its kept terms. Part ``term``: the kept terms a source
    uses more than its language does, by the difference, down to rank
    ``top``. Ties go to the smaller item by UTF-8.

    Null language, source or text count as ''. A group without terms, or a
    language without kept terms, gives pairs all the same (value 0 if no term
    is kept). An empty table gives no rows. Other columns are not looked at."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "divergence")
    docs = columns(documents, lang=lang, source=source, text=text).select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    freq = frequencies(docs, scratch, min_docs, block_postings)
    held = scratch.save(freq.select("lang", "term", F.posexplode(F.arrays_zip("sources", "counts")).alias("_", "x"))
                        .select("lang", "term", F.col("x.sources").alias("source"), F.col("x.counts").alias("c")), "held")
    sizes = held.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    kept = freq.groupBy("lang").agg(F.count("term").alias("v"))
    everyone = docs.select("lang", "source").distinct()
    groups = (everyone.join(sizes, ["lang", "source"], "left").join(kept, "lang", "left")
              .select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v")))
    groups = scratch.save(groups, "groups")
    whole = groups.groupBy("lang").agg(F.sum("n").alias("all"))

    zero = F.lit(0).cast("long")
    # dealt by the numbers of terms and of sources alone
    sized = kept.join(groups.groupBy("lang").agg(F.count("source").alias("s")), "lang").select(
        "lang", F.ceil(F.col("v") / pair_terms).cast("int").alias("deals"), F.ceil(F.col("s") / pair_sources).cast("int").alias("cuts"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    to = (groups.join(sized, "lang").withColumn("at", every("deals")).withColumn("to", every("cuts"))
          .select("lang", "at", "to", "source", "n", "v"))
    dealt = (freq.join(sized, "lang").withColumn("shard", F.pmod(F.xxhash64("term"), F.col("deals")).cast("int"))
             .withColumn("cut", every("cuts")).select("lang", "shard", "cut", "term", "sources", "counts"))
    sums = (dealt.groupBy("lang", "shard", "cut").cogroup(to.groupBy("lang", "at", "to"))
            .applyInPandas(_pair_sums(pair_sources), "lang string, source string, item string, value long")
            .groupBy("lang", "source", "item").agg(F.sum("value").alias("sum")))
    absent = F.when(F.col("v") > 0, share(zero, F.col("n"), F.col("v"))).otherwise(zero)
    mine = groups.select("lang", "source", "v", absent.alias("p"))
    other = groups.select("lang", F.col("source").alias("item"), absent.alias("q"))
    pairs = (mine.join(other, "lang").where("source <> item").join(sums, ["lang", "source", "item"], "left")
             .select("lang", "source", F.lit("pair").alias("part"), "item",
                     (F.col("v") * F.abs(F.col("p") - F.col("q")) + F.coalesce("sum", zero)).alias("value")))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(best))

    all_counts = freq.select("lang", F.col("term"), F.aggregate("counts", zero, lambda a, x: a + x).alias("total"))
    told = all_counts.join(whole, "lang").join(kept, "lang").select(
        "lang", "term", share(F.col("total"), F.col("all"), F.col("v")).alias("q"))
    shown = (held.join(groups, ["lang", "source"]).select("lang", "source", "term", share(F.col("c"), F.col("n"), F.col("v")).alias("p"))
             .join(told, ["lang", "term"]).where("p > q")
             .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                     (F.col("p") - F.col("q")).alias("value")))
    shown = shown.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return pairs.unionByName(shown)


#: The same rows in SQL, all pairs and terms spelled out.
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text
           FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}),
voc AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
cells AS (SELECT lang, source, term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, source, sum(c) AS n FROM cells GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
        1 + ({SCALE}::HUGEINT * (coalesce(c.c, 0) + {PRIOR})) // (coalesce(s.n, 0) + {PRIOR} * v.v) AS p
      FROM groups g JOIN voc v USING (lang) JOIN kept k USING (lang) LEFT JOIN cells c USING (lang, source, term)
      LEFT JOIN sizes s USING (lang, source)),
q AS (SELECT k.lang, k.term, 1 + ({SCALE}::HUGEINT * (t.c + {PRIOR})) // (a.n + {PRIOR} * v.v) AS q
      FROM kept k JOIN voc v USING (lang) JOIN (SELECT lang, term, sum(c) AS c FROM cells GROUP BY ALL) t USING (lang, term)
      JOIN (SELECT lang, sum(c) AS n FROM cells GROUP BY ALL) a USING (lang)),
apart AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
          FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pairs AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0)::BIGINT AS value
          FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
          LEFT JOIN apart a ON a.lang = g.lang AND a.source = g.source AND a.item = h.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value
          FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
