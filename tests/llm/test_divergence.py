import random

import duckdb
import pytest

from codecorpus.llm import divergence as D
from llm_fixtures import edge_docs, no_docs  # noqa: F401

SF = "/root/testdata/sf0.01"


def _sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (text VARCHAR, lang VARCHAR, source VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    return sorted(con.execute("SELECT lang, source, part, item, value, rank FROM (" + D.ORACLE_SQL + ")").fetchall())


def _spark(df, **more):
    return sorted(tuple(r) for r in D.divergence(df, **more).select("lang", "source", "part", "item", "value", "rank").collect())


def test_matches_sql(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert _spark(df) == _sql([tuple(r) for r in df.select("text", "lang", "source").collect()])


@pytest.mark.parametrize("block", [1, 40, 10 ** 6])
def test_small_blocks_and_odd_rows(spark, monkeypatch, block):
    """Nulls, empty texts, groups without terms, languages without kept
    terms, ties, non-ASCII letters, terms at 29, 30 and 31 documents."""
    rng = random.Random(1)
    words = ["alpha", "Beta", "ÄÖ", "ß", "naïve", "x", "ΣΑΣ", "日本", "I"]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(1, 12))) + ("!" if i % 2 else "_7"), rng.choice(["en", "de", None]),
             rng.choice(["a", "b", "c", "é", None])) for i in range(300)]
    rows += [("edge29", "en", "a")] * 29 + [("edge30 tie", "en", "a")] * 30 + [("edge31 ILK", "de", "b")] * 31
    rows += [(None, "en", "void"), ("", "fr", "a"), ("only 1 few", "fr", "b"), ("12 34", "xx", "solo"), ("rare", "", "")]
    monkeypatch.setattr(D, "MERGE_POSTINGS", 50)
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    assert _spark(df, block_postings=block, pair_terms=block, pair_sources=min(block, 2)) == _sql(rows)


def test_edges(edge_docs, no_docs):
    rows = [(r["text"], r["lang"], r["source"]) for r in edge_docs.collect()]
    assert _spark(edge_docs) == _sql(rows)
    assert _spark(no_docs) == []


def test_early_merge_gives_the_same_frequencies():
    runs = [sorted((bytes([97 + (i * j) % 7]), f"s{j % 3}", i + 1, 1) for i in {1, 2, 5}) for j in range(20)]
    at_once = list(D.merge_runs(runs))
    early = list(D.merge_runs([list(D.merge_runs(runs[:11])), *runs[11:]]))
    assert at_once == early and len(at_once) == len({x[:2] for x in at_once})
