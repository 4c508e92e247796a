"""Operator 13: n-gram Jaccard join by T-occurrence search.

A document is the set of its distinct 4-word shingles; two documents link at
similarity 0.85 or more. A document searches the inverted index of a block:
every partner holds at least T of its shingles, T following from the sizes.
DivideSkip splits the shingles' lists: the short ones are merged with a heap
that skips what cannot reach the threshold any more, the long ones are only
probed by binary search for the few documents that the merge leaves.

Blocks are found exactly, without a candidate list. Sizes n and m differ in
at most k = 15 (n + m) / 185 shingles if they link. The hash space is cut
into more than k parts, of which at most k differ, so among any k + 1 parts
one holds the same shingles in both documents; a part's content is a key. A
document shows its fullest k + 1 parts and all that are as full, as keys of
few shingles would join strangers. (The agreeing part is as full in the other
document, and the one of the two that shows less decides. A document with
fewer filled parts shows one more key of its own.) Sizes are classed by
powers of two, with one more family of parts around each border.
Connected keys make clusters; no link leaves a cluster. A cluster is dealt
into parts of bounded size: first each part joins with itself, then the
documents outside the cluster's largest component search the other parts.

Skew: rows of one key collapse in every batch to its smallest id before the
shuffle, tasks hand on stars instead of all links of keys, equal sets collapse to one before the search, and inside a part the
document with the most common shingles searches first, so that the members
of its component need no search of their own (a pair inside one component is
no news). Nothing is capped.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import hot_cold_join
from .common import Scratch, columns
from .components import Forest, components
from .minhash import _WordHashes, shingle_set

SHINGLE = 4
PERCENT = 85
#: Shingles of one block part; a part's index takes about 50 bytes for each.
PART_SHINGLES = 1_000_000
#: Short lists with more postings are merged by counting instead of the heap.
HEAP_POSTINGS = 512
#: DivideSkip's weight of the longest list's length (a cost constant).
LONG_WEIGHT = 0.05

_ROW, _EDGE, _NODE = 0, 1, 2
#: rows: key, id; edges: -, id, smaller id; nodes: -, id, size, print in two halves.
_FOUND = "kind int, key long, a long, b long, c long, d long"


def most_apart(n: int, m: int, percent: int = PERCENT) -> int:
    """Largest symmetric difference of linked sets of n and m members."""
    return (100 - percent) * (n + m) // (100 + percent)


def least_common(n: int | np.ndarray, m: int | np.ndarray, percent: int = PERCENT):
    """Smallest intersection of linked sets of n and m members."""
    return -(-percent * (n + m) // (100 + percent))


def families(n: int, percent: int = PERCENT) -> list[tuple[int, int, int]]:
    """(name, largest difference for this n, parts) of the part families of
    a set of n members: its size class, and a border nearby."""
    c = n.bit_length()
    low, high = 1 << (c - 1), (1 << c) - 1
    out = []

    def add(name: int, worst: int, mine: int) -> None:
        out.append((name, mine, worst + 2 + worst // 4))
    add(2 * c, most_apart(high, high, percent), most_apart(n, min(high, 100 * n // percent), percent))
    for border, name in ((low, 2 * c - 1), (high + 1, 2 * c + 1)):
        largest = 100 * (border - 1) // percent
        if percent * border <= 100 * n and n <= largest:
            partner = border - 1 if n >= border else 100 * n // percent
            add(name, most_apart(border - 1, largest, percent), most_apart(n, partner, percent))
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def part_keys(shingles: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Keys of a sorted set of 64-bit hashes: of each family the fullest
    parts, one more than can differ, and one key more if there are too few."""
    n, out = len(shingles), []
    mixed = _mix(shingles)
    for name, worst, parts in families(n, percent):
        at = ((shingles >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        tag = np.uint64((name * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        keys = _mix(np.add.reduceat(mixed, first) ^ (at[first] * np.uint64(0xD6E8FEB86659FD93) + tag))
        spare = len(first) - worst - 1
        if spare < 0:
            out.append(_mix(np.array([tag ^ np.uint64(0x5851F42D4C957F2D)])))
        elif spare:
            full = np.diff(np.append(first, n))
            keys = keys[full >= np.partition(full, spare)[spare]]
        out.append(keys)
    return np.concatenate(out).view(np.int64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _emitter(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per document a node row (print, id, size); per key its smallest id
        of the batch; the batch's other ids of the key as edges to it."""
        hashes, at = _WordHashes(), 0
        for batch in batches:
            ids = np.asarray(batch.column(0).fill_null(0))
            known = np.asarray(batch.column(0).is_valid())
            nodes, keys, owners = [], [], []
            for i, (text, ok) in enumerate(zip(batch.column(1).to_pylist(), known, strict=True)):
                s = shingle_set(text.lower().split() if text else [], hashes, size)
                p = xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else 0
                nodes.append((_signed(p >> 64), len(s), _signed(p & 0xFFFFFFFFFFFFFFFF)))
                if ok and len(s):
                    keys.append(part_keys(s, percent))
                    owners.append(np.full(len(keys[-1]), ids[i]))
            if nodes:
                p, n, q = (np.array(x, np.int64) for x in zip(*nodes, strict=True))
                deal = _mix(np.arange(at, at + len(n), dtype=np.uint64)).view(np.int64)  # evenly, whatever the rows hold
                at += len(n)
                yield _rows(_NODE, deal, batch.column(0), n, p, q)
            if keys:
                k, o = np.concatenate(keys), np.concatenate(owners)
                order = np.lexsort((o, k))
                k, o = k[order], o[order]
                new = np.concatenate(([True], k[1:] != k[:-1]))
                lead = o[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
                yield _rows(_ROW, k[new], pa.array(o[new]), o[new])
                rest = ~new & (o != lead)
                if rest.any():
                    yield _edges(o[rest], lead[rest])
    return run


def _rows(kind: int, key: np.ndarray, a, b: np.ndarray, *more: np.ndarray) -> pa.RecordBatch:
    n = len(key)
    c, d = more or (np.zeros(n, np.int64),) * 2
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(key), a.cast(pa.int64()),
                                       pa.array(b), pa.array(c), pa.array(d)], names=["kind", "key", "a", "b", "c", "d"])


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack((a, b), axis=1), axis=0)
    return _rows(_EDGE, _mix(pairs[:, 0].astype(np.uint64)).view(np.int64), pa.array(pairs[:, 0]), pairs[:, 1])


def _key_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by (kind, key, a): the ids of a key hang on its
    smallest one, and with the edges of the batches they become stars, one
    for each cluster that this task sees. Nodes pass."""
    forest = Forest()
    last_key, last_lead = None, None
    for batch in batches:
        kind = np.asarray(batch.column(0))
        n, e = (int(np.searchsorted(kind, x)) for x in (_EDGE, _NODE))
        if n:
            k, o = np.asarray(batch.column(1))[:n], np.asarray(batch.column(3))[:n]
            new = np.concatenate(([last_key is None or k[0] != last_key], k[1:] != k[:-1]))
            lead = o[np.maximum.accumulate(np.where(new, np.arange(n), 0))]
            if not new[0]:
                run = int(np.argmax(new)) if new.any() else n
                lead[:run] = last_lead
            last_key, last_lead = k[-1], lead[-1]
            rest = o != lead
            forest.add(o[rest], lead[rest])
        if n < e:
            forest.add(*(np.asarray(batch.column(i))[n:e] for i in (2, 3)))
        if e < batch.num_rows:
            yield batch.slice(e)
    a, b = forest.stars()
    if len(a):
        yield _rows(_EDGE, a, pa.array(a), b)


def heap_merge(lists: list[list[int]], need: int) -> dict[int, int]:
    """Members of at least ``need`` of the sorted lists and in how many:
    heads wait in a heap; when the smallest cannot reach ``need``, the lists
    that hold the next ``need`` - 1 heads skip to the first head beyond them."""
    heap = [(x[0], i, 0) for i, x in enumerate(lists) if x]
    heapq.heapify(heap)
    out = {}
    while len(heap) >= need:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= need:
            out[top] = len(popped)
            goal = top + 1
        else:
            while heap and len(popped) < need - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                break
            goal = heap[0][0]
        for _, i, at in popped:
            at = bisect_left(lists[i], goal, at)
            if at < len(lists[i]):
                heapq.heappush(heap, (lists[i][at], i, at))
    return out


class Index:
    """Inverted lists of the sets of one block part."""

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT):
        self.percent = percent
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.edges = np.concatenate(([0], np.cumsum(self.sizes)))
        self.tokens, inverse, self.counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        self.inverse = inverse.reshape(-1)
        doc = np.repeat(np.arange(len(sets)), self.sizes)
        self.docs = doc[np.argsort(self.inverse, kind="stable")]
        self.starts = np.concatenate(([0], np.cumsum(self.counts)))
        # (list, document) as one sorted number: all binary probes are one call
        self.codes = np.repeat(np.arange(len(self.tokens)), self.counts) * len(sets) + self.docs

    def own_lists(self, i: int) -> np.ndarray:
        return self.inverse[self.edges[i]:self.edges[i + 1]]

    def lists_of(self, tokens: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return at[self.tokens[at] == tokens]

    def search(self, n: int, lists: np.ndarray, allowed: np.ndarray) -> np.ndarray:
        """Documents among ``allowed`` (a mask) that link with a set of n
        members whose lists here are ``lists``."""
        allowed = allowed & (self.percent * self.sizes <= 100 * n) & (self.percent * n <= 100 * self.sizes)
        if not allowed.any():
            return np.empty(0, np.int64)
        need = int(least_common(n, int(self.sizes[allowed].min()), self.percent))
        if len(lists) < need:
            return np.empty(0, np.int64)
        size = self.counts[lists]
        lists = lists[np.argsort(size, kind="stable")]
        longest = int(size.max())
        long = min(need - 1, int(need / (LONG_WEIGHT * np.log2(longest + 1) + 1)))
        short, probes = lists[:len(lists) - long], lists[len(lists) - long:]
        found, seen = self._merge(short, need - long)
        ok = allowed[found]
        found, seen = found[ok], seen[ok]
        goal = least_common(n, self.sizes[found], self.percent)
        for at in range(0, long, 64):
            if not len(found):
                break
            part = probes[at:at + 64]
            wanted = part[:, None] * len(self.sizes) + found
            spot = np.minimum(np.searchsorted(self.codes, wanted), len(self.codes) - 1)
            seen = seen + (self.codes[spot] == wanted).sum(axis=0)
            ok = seen + (long - at - len(part)) >= goal
            found, seen, goal = found[ok], seen[ok], goal[ok]
        return found[seen >= goal]

    def _merge(self, short: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.docs[self.starts[x]:self.starts[x + 1]] for x in short]
        if sum(map(len, parts)) <= HEAP_POSTINGS:
            got = heap_merge([p.tolist() for p in parts], need)
            return np.array(list(got), np.int64), np.array(list(got.values()), np.int64)
        seen = np.bincount(np.concatenate(parts), minlength=len(self.sizes))
        found = np.flatnonzero(seen >= need)
        return found, seen[found]


def self_links(index: Index) -> list[tuple[int, int]]:
    """Links that connect whatever the part's own links connect. The first
    searcher is the document with the most common shingles; members of its
    component are not searched for again, nor do they search: a pair inside
    a component connects nothing new, and a pair of a member and another
    document is found by the other."""
    n = len(index.sizes)
    group, out = np.arange(n), []
    reach = np.add.reduceat(index.counts[index.inverse], index.edges[:-1])
    order = np.argsort(-reach, kind="stable")
    hub = order[0]
    for i in order:
        if i != hub and group[i] == group[hub]:
            continue
        lists = index.own_lists(i)
        for j in index.search(int(index.sizes[i]), lists[index.counts[lists] > 1], group != group[i]):
            if group[j] != group[i]:
                out.append((int(i), int(j)))
                group[group == group[j]] = group[i]
    return out


def _sets(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()
        for batch in batches:
            items = [shingle_set(t.encode("utf-8", "surrogatepass").lower().split(), hashes, size) for t in batch["text"]]
            yield batch[["id", "cluster", "part", "parts"]].assign(items=[s.tobytes() for s in items])
    return run


def _blocks(batches: Iterator[pd.DataFrame], names: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Rows that arrive sorted by ``names``, one group after the other."""
    held: list[pd.DataFrame] = []
    at = None
    for batch in batches:
        for key, rows in batch.groupby(names, sort=False):
            if key != at:
                if held:
                    yield at, pd.concat(held)
                at, held = key, []
            held.append(rows)
    if held:
        yield at, pd.concat(held)


def _joined_with_itself(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, rows in _blocks(batches, ["cluster", "part"]):
            ids = rows["id"].to_numpy()
            index = Index([np.frombuffer(x, np.uint64) for x in rows["items"]], percent)
            pairs = self_links(index) if len(ids) > 1 else []
            yield pd.DataFrame({"a": ids[[a for a, _ in pairs]], "b": ids[[b for _, b in pairs]]}, dtype=np.int64)
    return run


def _searched(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows arrive sorted by (cluster, part, role): a part's own rows
        first, then the searchers of other parts, a batch at a time."""
        index, at, ids, groups = None, None, None, None
        for (cluster, part, role, _), rows in _blocks(_numbered(batches), ["cluster", "part", "role", "chunk"]):
            if role == 0:
                if at != (cluster, part):
                    index, at, held = None, (cluster, part), []
                held.append(rows)
                continue
            if at != (cluster, part):
                continue
            if index is None:
                own = pd.concat(held)
                ids, groups = own["id"].to_numpy(), own["c"].to_numpy()
                index = Index([np.frombuffer(x, np.uint64) for x in own["items"]], percent)
            out = []
            for i, c, items in zip(rows["id"], rows["c"], rows["items"], strict=True):
                tokens = np.frombuffer(items, np.uint64)
                out += [(i, ids[j]) for j in index.search(len(tokens), index.lists_of(tokens), groups != c)]
            yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)
    return run


def _numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for i, batch in enumerate(batches):
        yield batch.assign(chunk=i)


def _dealt(rows: DataFrame, *order: str) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "cluster", "part").sortWithinPartitions("cluster", "part", *order)


def ngram_join(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT,
               size: int = SHINGLE, part_shingles: int = PART_SHINGLES) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Null texts and texts without words have an empty set and link with
    nothing; a text with fewer words than a shingle is one shingle. Repeated
    rows share id and component. A row without id links with nothing and has
    no component. Set members are 64-bit hashes of shingles. An empty table
    gives no rows; other columns of the input are not looked at."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "ngram-join")
    docs = columns(documents, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("id", F.col("text").cast("binary")).mapInArrow(_emitter(size, percent), _FOUND)
    found = scratch.save(rows.repartition(n, "key").sortWithinPartitions("kind", "key", "a")
                         .mapInArrow(_key_runs, _FOUND), "found")
    clusters = components(found.where(f"kind = {_EDGE}").select("a", "b"), scratch, "clusters")
    nodes = found.where(f"kind = {_NODE}").select(F.col("a").alias("id"), F.col("b").alias("n"),
                                                 F.struct("c", "d").alias("print"))
    full = nodes.where("n > 0 and id is not null")
    # equal sets are one member; all of them are in one cluster, as they show the same keys
    classes = scratch.save(full.groupBy("print").agg(F.min("id").alias("rep"), F.count("id").alias("rows"),
                                                     F.first("n").alias("n")), "classes")
    clusters = clusters.withColumnRenamed("component", "cluster")
    members = scratch.save(classes.join(clusters, F.col("rep") == F.col("id")).select("id", "cluster", "n"), "members")
    sizes = (members.groupBy("cluster").agg(F.count("id").alias("sets"), F.sum("n").alias("all"))
             .where("sets > 1").select(F.col("cluster").alias("_c"), F.ceil(F.col("all") / part_shingles).alias("parts")))
    placed = scratch.save(members.join(sizes, F.col("cluster") == F.col("_c")).select(
        "id", "cluster", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "parts").distinct(), "placed")
    texts = docs.where("id is not null and text is not null").join(placed, "id")
    sets = scratch.save(texts.mapInPandas(_sets(size), "id long, cluster long, part int, parts long, items binary"), "sets")
    links = scratch.save(_dealt(sets.drop("parts")).mapInPandas(_joined_with_itself(percent), "a long, b long"), "links")

    final = components(links, scratch, "near")
    wide = placed.where("parts > 1")
    if not wide.isEmpty():
        links = links.unionByName(_cross_links(wide, sets, final, percent, scratch))
        final = components(links, scratch, "final")
    named = scratch.save(classes.join(final, F.col("rep") == F.col("id"), "left").select(
        "print", "rows", F.coalesce("component", "rep").alias("component_id")), "named")
    scratch.drop("members", "placed", "sets", "classes")
    linked = hot_cold_join(full.select("id", "n", "print"), named, "print", "rows")
    alone = nodes.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
    return (linked.select("id", "n", "component_id").unionByName(alone)
            .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id"))


def _cross_links(wide: DataFrame, sets: DataFrame, near: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links between the parts of clusters dealt into several: every member
    outside its cluster's largest component searches the other parts."""
    marked = wide.join(near, "id", "left").select("id", "cluster", "part", "parts", F.coalesce("component", "id").alias("c"))
    marked = scratch.save(marked, "marked")
    top = (marked.groupBy("cluster", "c").agg(F.count("id").alias("rows")).groupBy("cluster")
           .agg(F.max(F.struct("rows", "c")).alias("top")).select(F.col("cluster").alias("_c"), F.col("top.c").alias("top")))
    marked = marked.join(top, F.col("cluster") == F.col("_c"))
    items = sets.where("parts > 1").select(F.col("id").alias("_id"), "items")
    own = marked.select("id", "cluster", "part", F.lit(0).alias("role"), "c")
    other = (marked.where("c <> top").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)))
             .where("to <> part").select("id", "cluster", F.col("to").alias("part"), F.lit(1).alias("role"), "c"))
    rows = own.unionByName(other).join(items, F.col("id") == F.col("_id")).drop("_id")
    out = scratch.save(_dealt(rows, "role").select("cluster", "part", "role", "id", "c", "items")
                       .mapInPandas(_searched(percent), "a long, b long"), "cross")
    scratch.drop("marked")
    return out


#: The same rows by brute force: all pairs of documents that share a shingle,
#: exact similarity, smallest reachable id.
ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)]) END AS sh FROM words),
items AS (SELECT doc_id, md5_number(unnest(sh)) AS h FROM sets),
sizes AS (SELECT doc_id, len(sh) AS n FROM sets),
both_have AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM items x JOIN items y ON x.h = y.h AND x.doc_id < y.doc_id
  GROUP BY ALL),
links AS (
  SELECT a, b FROM both_have JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * k >= 85 * (p.n + q.n - k)),
edges AS (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links),
reach(id, far) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT id, v FROM reach JOIN edges ON u = far)
SELECT doc_id, n::BIGINT AS n_shingles, min(far)::BIGINT AS component_id
FROM sizes JOIN reach ON id = doc_id GROUP BY doc_id, n
"""
