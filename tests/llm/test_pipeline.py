"""The pipeline's stages, one by one and together."""
from collections import Counter

import pytest

import corpus_pipeline as P
from codecorpus.llm import cotraining, minhash, mixing, packing, toxicity
from llm_fixtures import BODY, LONG, edge_docs, edge_labels, no_docs  # noqa: F401

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _toxicity string, _Quality string, copies long, i long"


@pytest.fixture(scope="module")
def folder(spark, edge_labels, tmp_path_factory):
    """A data folder with labels, and documents whose further columns have
    the names that stages use."""
    root = str(tmp_path_factory.mktemp("stages"))
    edge_labels.write.parquet(f"{root}/labels.parquet")
    return root


@pytest.fixture(scope="module")
def odd(spark):
    texts = [(1, None), (2, ""), (3, " \n"), (4, LONG), (5, BODY), (6, BODY), (6, BODY), (7, BODY.upper()), (None, BODY),
             (None, BODY), (8, "one two"), (9, "one two"), (11, "a text of its own"), (11, "another text under the same id")]
    rows = [(i, t, None if i == 7 else "en", [None, "s1", "s2"][k % 3], None if t is None else len(t), "T", "Q", 7, 8)
            for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


STAGES = dict(P.STAGES)


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_stages_keep_columns_and_whole_rows(spark, folder, odd, name):
    out = STAGES[name](spark, odd, folder)
    assert out.dtypes == odd.dtypes
    have = {tuple(r) for r in odd.collect()}
    assert {tuple(r) for r in out.collect()} <= have
    assert STAGES[name](spark, odd.where("false"), folder).collect() == []


def test_stage_order():
    assert list(STAGES) == ["toxicity", "quality", "near_duplicates", "mixing", "packing"]


def test_classifying_stages_follow_the_scores(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r["doc_id"] for r in toxicity.toxicity(docs, labels).where("predicted = 0").collect()}
    assert {r["doc_id"] for r in P.drop_toxic(spark, docs, SF).collect()} == toxic
    good = {r["doc_id"] for r in cotraining.quality_rows(docs, labels).where("kept").collect()}
    assert {r["doc_id"] for r in P.drop_low_quality(spark, docs, SF).collect()} == good


def test_near_duplicates_stage(spark, folder, odd):
    got = Counter((r["doc_id"], r["text"]) for r in P.drop_near_duplicates(spark, odd, folder).collect())
    assert got == Counter([(1, None), (2, ""), (3, " \n"), (4, LONG), (5, BODY), (None, BODY), (8, "one two"),
                           (11, "a text of its own"), (11, "another text under the same id")])
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"] for r in minhash.near_duplicates(docs).where("kept").collect()}
    assert sorted(r["doc_id"] for r in P.drop_near_duplicates(spark, docs, SF).collect()) == sorted(kept)


def test_mixing_stage_takes_what_the_mix_says(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).where("copies > 0").collect()}
    assert Counter(r["doc_id"] for r in P.mix_sources(spark, docs, SF).collect()) == Counter(want)


def test_packing_stage(spark, folder, odd):
    got = P.pack_sequences(spark, odd, folder).collect()
    assert len(got) == len(packing.pack(odd.select("doc_id", "text")).collect()) and len(got) > 14
    assert P.pack_sequences(spark, odd.where("false"), folder).collect() == []


def test_run_is_its_stages(spark):
    """The whole run against the stages called by hand, brute force as far as
    SQL cannot go: every packed document passed every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name in list(STAGES)[:-1]:
        docs = spark.createDataFrame(STAGES[name](spark, docs, SF).collect(), docs.schema)
    tokens = Counter()
    for r in P.run(spark, SF).collect():
        tokens[r["doc_id"]] += r["length"]
    encode = packing.Encoder(*packing.default_files())
    want = Counter()
    for r in docs.collect():
        want[r["doc_id"]] += len(encode(r["text"])) + 1
    assert tokens == want and len(want) > 20
