import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from codecorpus.llm import ngram_join as J
from llm_fixtures import edge_docs, no_docs  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_matches_brute_force_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(map(tuple, con.execute(J.ORACLE_SQL).fetchall()))
    got = J.ngram_join(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert sorted(map(tuple, got)) == want


def test_edges(edge_docs, no_docs):
    rows = J.ngram_join(edge_docs).collect()
    assert len(rows) == 13 and J.ngram_join(no_docs).collect() == []
    by_id = {r["doc_id"]: r for r in rows}
    for i in (1, 2, 3, 11):
        assert (by_id[i]["n_shingles"], by_id[i]["component_id"]) == (0, i)
    assert [by_id[i]["component_id"] for i in (5, 6, 7, 10)] == [5] * 4
    assert by_id[8]["component_id"] == by_id[9]["component_id"] == 8 and by_id[8]["n_shingles"] == 1
    assert by_id[None]["component_id"] is None and by_id[4]["component_id"] == 4


def test_same_id_with_two_texts(spark):
    a, b = ("alpha beta gamma delta epsilon zeta eta theta iota kappa", "one two three four five six seven eight nine ten")
    rows = J.ngram_join(spark.createDataFrame([(3, a), (3, b), (5, a), (4, b), (9, "other words entirely here now")],
                                              "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in rows) == [(3, 3), (3, 3), (4, 3), (5, 3), (9, 9)]


def _brute(docs, size=4, percent=85):
    sets = {i: set(zip(*[t.split()[k:] for k in range(size)])) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i in ids}


def _variants(rng, n, words, edits):
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(words)]
    for _ in range(n):
        text = list(base)
        for _ in range(rng.randrange(edits)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10 ** 6)}"
        yield " ".join(text[:len(text) - rng.randrange(3)])


@pytest.mark.parametrize("part_shingles", [J.PART_SHINGLES, 1500])
def test_groups_around_the_threshold(spark, part_shingles):
    """Variants above and below the similarity of each other, chains of
    windows, and clusters dealt into many parts."""
    rng = random.Random(part_shingles)
    texts = [t for words, edits in ((60, 6), (200, 14), (31, 3)) for t in _variants(rng, 40, words, edits)]
    long = [f"z{k}" for k in range(900)]
    texts += [" ".join(long[i * 10:i * 10 + 150]) for i in range(60)]  # neighbours link, others do not
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    got = {r["doc_id"]: r["component_id"] for r in J.ngram_join(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(5), part_shingles=part_shingles).collect()}
    assert got == _brute(docs)


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(3)
    hidden = 0
    for n in [*range(1, 70), 100, 127, 128, 129, 255, 257, 500, 1023, 1024, 3000]:
        for _ in range(6):
            a = np.unique(rng.integers(0, 2 ** 64, n, np.uint64))
            drop = rng.integers(0, max(1, len(a) * 15 // 100) + 1)
            b = a[rng.permutation(len(a))[drop:]]
            add = rng.integers(0, 3 + len(a) // 10)
            b = np.unique(np.concatenate((b, rng.integers(0, 2 ** 64, add, np.uint64))))
            both = len(np.intersect1d(a, b))
            if both and 100 * both >= 85 * (len(a) + len(b) - both):
                assert len(np.intersect1d(J.part_keys(a), J.part_keys(b))), n
            else:
                hidden += 1
    assert hidden  # pairs below the similarity occurred too


def test_few_filled_parts_show_a_key_of_their_own():
    """All members in one corner of the hash space: most parts are empty."""
    a = np.arange(1, 41, dtype=np.uint64)
    b = np.concatenate((a[:-1], [np.uint64(99)]))
    assert len(np.intersect1d(J.part_keys(a), J.part_keys(b)))


def test_heap_merge_counts_members():
    rng = random.Random(7)
    for need in (1, 2, 5, 9):
        lists = [sorted(rng.sample(range(60), rng.randrange(0, 40))) for _ in range(12)]
        want = {x: n for x, n in Counter(x for one in lists for x in one).items() if n >= need}
        assert J.heap_merge(lists, need) == want


@pytest.mark.parametrize("heap", [0, 512])
def test_search_finds_all_partners(monkeypatch, heap):
    monkeypatch.setattr(J, "HEAP_POSTINGS", heap)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2 ** 60, 80).astype(np.uint64)
    sets = [np.unique(np.concatenate((base[rng.random(80) > 0.06], rng.integers(0, 2 ** 60, rng.integers(1, 9)).astype(np.uint64))))
            for _ in range(50)]
    index = J.Index(sets)
    for i, a in enumerate(sets):
        want = [j for j, b in enumerate(sets) if j != i
                and 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))]
        got = index.search(len(a), index.lists_of(a), np.arange(50) != i)
        assert sorted(got) == want
