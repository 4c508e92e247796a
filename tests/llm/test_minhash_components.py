import random

import duckdb
import numpy as np

from codecorpus.llm import minhash
from codecorpus.llm.common import Scratch
from codecorpus.llm.components import components
from llm_fixtures import edge_docs, no_docs  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_matches_brute_force(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(map(tuple, con.execute(minhash.ORACLE_SQL).fetchall()))
    got = minhash.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert sorted(map(tuple, got)) == want


def test_edges(edge_docs, no_docs):
    rows = minhash.near_duplicates(edge_docs).collect()
    assert len(rows) == 13 and minhash.near_duplicates(no_docs).collect() == []
    by_id = {r["doc_id"]: r for r in rows}
    for i in (1, 2, 3, 11):
        assert (by_id[i]["n_shingles"], by_id[i]["component_id"], by_id[i]["kept"]) == (0, i, True)
    assert [by_id[i]["component_id"] for i in (5, 6, 7, 10)] == [5] * 4
    assert by_id[8]["component_id"] == by_id[9]["component_id"] == 8 and by_id[8]["n_shingles"] == 1
    assert by_id[None]["component_id"] is None and by_id[None]["kept"]


def test_link_not_seen_from_the_smallest_id(spark):
    """A bucket's star has its hub at the smallest id; links among the other
    members must be found too."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(400)]
    docs = [(i, " ".join(base[i * 45:i * 45 + 220])) for i in range(4)]  # neighbours share less than 0.75
    near = [" ".join(base[20:220] + [f"x{k}" for k in range(j)]) for j in range(12)]
    docs += [(10 + j, t) for j, t in enumerate(near)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(
        spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    sets = {i: set(zip(*[t.split()[k:] for k in range(5)])) for i, t in docs}
    want = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    want[a] = want[b] = min(want[a], want[b])
    assert got == want


def test_circulant_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2 ** 63, 3000).astype(np.uint64)
    a, b = pool[:2000], pool[500:2500]  # similarity 0.6
    x, y = minhash.signature(a, 4096), minhash.signature(b, 4096)
    assert abs((x == y).mean() - 0.6) < 0.04
    assert len(np.unique(x)) > 400  # coordinates are not copies of one another


def test_words_rule():
    assert minhash.words_of("AÄ\x1cb\x0bC d  E") == ["aÄ\x1cb".encode(), "c d ".encode(), b"e"]


def test_components_against_union_find(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in links)}
    df = spark.createDataFrame(links, "a long, b long")
    got = {r["id"]: r["component"] for r in components(df, Scratch(spark, "t"), "c").collect()}
    assert got == want
