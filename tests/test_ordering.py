import math

from pyspark.sql import functions as F

import pytest

from codecorpus.operators import ordering, packing


def test_row_index_is_global_order(spark):
    df = spark.range(0, 5000).select(((F.col("id") * 7919) % 5000).alias("k")).repartition(7)
    rows = ordering.with_row_index(df, ["k"], "pos").collect()
    assert sorted((r["k"], r["pos"]) for r in rows) == [(k, k) for k in range(5000)]


def test_sharded_order_disjoint_and_complete(spark):
    df = spark.range(0, 100).withColumnRenamed("id", "doc_id")
    rows = ordering.sharded_order(df, "doc_id", replicas=3, seed=1, epoch=0).collect()
    assert len(rows) == 102                                  # padded to a multiple of 3
    per_rank = {}
    for r in rows:
        per_rank.setdefault(r["rank"], []).append(r["local_pos"])
    assert all(sorted(v) == list(range(34)) for v in per_rank.values())
    assert {r["doc_id"] for r in rows} == set(range(100))
    dropped = ordering.sharded_order(df, "doc_id", replicas=3, seed=1, epoch=0, drop_last=True, start_index=30)
    assert dropped.count() == 3 * 3 and dropped.agg(F.max("local_pos")).first()[0] == 2
    other = ordering.sharded_order(df, "doc_id", replicas=3, seed=1, epoch=1).collect()
    assert [r["doc_id"] for r in sorted(other, key=lambda r: (r["local_pos"], r["rank"]))] != \
        [r["doc_id"] for r in sorted(rows, key=lambda r: (r["local_pos"], r["rank"]))]


def test_contiguous_split(spark):
    df = spark.range(0, 10).withColumnRenamed("id", "i")
    got = {r["i"]: r["part"] for r in ordering.contiguous_split(df, ["i"], 3).collect()}
    size = 10 // 3
    assert got == {i: min(i // size, 2) for i in range(10)}
    assert {r["part"] for r in ordering.contiguous_split(df, ["i"], 0).collect()} == {0}


def test_percent_split(spark):
    n = 1001
    df = spark.range(0, n).withColumnRenamed("id", "i")
    got = {r["i"]: r["bin"] for r in ordering.percent_split(df, ["i"], 7).collect()}
    step = math.ceil(100 / 7)
    bounds = [(round(a * n / 100.0), round(min(a + step, 100) * n / 100.0)) for a in range(0, 100, step)]
    expect = {}
    for b, (lo, hi) in enumerate(bounds):
        for i in range(lo, hi):
            expect[i] = b
    assert got == expect and len(bounds) == math.ceil(100 / step)


def brute_next_fit(lengths, max_length):
    packs, cur = [], []
    for n in lengths:
        n = min(n, max_length)
        if sum(cur) and sum(cur) + n > max_length:
            packs.append(cur)
            cur = []
        cur.append(n)
    if cur:
        packs.append(cur)
    return packs


@pytest.mark.parametrize("chunk_rows,fan", [(1000, 256), (50, 256), (20, 4), (7, 2), (1, 3)])
def test_packing_does_not_depend_on_the_chunks(spark, chunk_rows, fan):
    rows = [(i, f"c{i % 3}", (i * 37) % 75, i % 2) for i in range(400)]  # some empty, some above the maximum
    df = spark.createDataFrame(rows, "row_id long, seq_category string, seq_length int, bin int")
    got = {r["row_id"]: r["window"] for r in packing.pack(df, "row_id", "seq_length", 60, chunk_rows=chunk_rows,
                                                          fan=fan).collect()}
    for b in (0, 1):
        ordered = sorted((r for r in rows if r[3] == b), key=lambda r: (r[1], r[2], r[0]))
        packs = brute_next_fit([r[2] for r in ordered], 60)
        expect = [w for w, p in enumerate(packs) for _ in p]
        assert [got[r[0]] for r in ordered] == expect


def test_packed_rows(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(1, "a", 3, 0), (2, "a", 2, 0), (3, "b", 0, 0), (4, "b", 9, 0)],
                               "row_id long, seq_category string, seq_length int, bin int")
    ids = df.select("row_id", F.when(F.col("seq_length") > 0, F.transform(F.sequence(F.lit(1), "seq_length"), lambda x: (
        x + F.col("row_id") * 10).cast("int"))).otherwise(F.array().cast("array<int>")).alias("input_ids"))
    out = packing.packed_rows(packing.pack(df, "row_id", "seq_length", 5), ids, "row_id", 5).orderBy("window").collect()
    assert [r["input_ids"] for r in out] == [[21, 22, 11, 12, 13], [41, 42, 43, 44, 45]]
    assert all(r["labels"] == r["input_ids"] for r in out)



def test_vocabulary_and_encode(spark):
    from codecorpus.functions.arrays import tokens
    df = spark.createDataFrame([(1, "a b a, c"), (2, "b a")], "k long, t string")
    v = packing.vocabulary(df.select(tokens("t").alias("tokens")))
    ids = {r["token"]: r["id"] for r in v.collect()}
    assert ids == {"a": 2, "b": 3, ",": 4, "c": 5}
    enc = {r["k"]: r["input_ids"] for r in packing.encode(df, "k", "t", v).collect()}
    assert enc == {1: [2, 3, 2, 4, 5], 2: [3, 2]}
