import random

from pyspark.sql import functions as F

from codecorpus.functions.similarity import edit_distance, edit_distance_py, with_edit_similarity
from codecorpus.functions.text import edit_similarity_jvm


def lev_dp(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def test_bit_parallel_equals_dp():
    rng = random.Random(5)
    for _ in range(3000):
        a = "".join(rng.choice("ab\n é😀") for _ in range(rng.randint(0, 70)))
        b = "".join(rng.choice("ab\n é😀") for _ in range(rng.randint(0, 70)))
        assert edit_distance_py(a, b) == lev_dp(a, b)
    for m in (63, 64, 65, 200):
        a = "".join(rng.choice("xy") for _ in range(m))
        b = a[: m // 2] + "z" + a[m // 2:]
        assert edit_distance_py(a, b) == lev_dp(a, b) == 1


def test_udf_matches_spark_levenshtein(spark):
    rng = random.Random(9)
    pairs = [("".join(rng.choice("abc \n") for _ in range(rng.randint(0, 300))),
              "".join(rng.choice("abc \n") for _ in range(rng.randint(0, 300)))) for _ in range(200)]
    pairs += [("", ""), ("same", "same"), (None, "x")]
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = df.select(edit_distance(F.col("a"), F.col("b")).alias("d"), F.levenshtein("a", "b").alias("e")).collect()
    assert all(r["d"] == r["e"] for r in rows)


def test_edit_similarity_invariants(spark):
    df = spark.createDataFrame([("a\n b\n", "a\nb"), ("", ""), ("abc", ""), ("x y", "x z"), ("  \n", "")],
                               "a string, b string")
    out = with_edit_similarity(df, "a", "b").withColumn("jvm", edit_similarity_jvm(F.col("a"), F.col("b")))
    rows = out.collect()
    assert [r["edit_sim"] for r in rows] == [1.0, 1.0, 0.0, 1 - 1 / 3, 1.0]
    assert all(abs(r["edit_sim"] - r["jvm"]) < 1e-12 for r in rows)


def test_edit_similarity_with_large_arrow_strings(spark):
    spark.conf.set("spark.sql.execution.arrow.useLargeVarTypes", "true")
    try:
        df = spark.createDataFrame([("x" * 5000 + "y", "x" * 5000), ("", "")], "a string, b string")
        got = [r["edit_sim"] for r in with_edit_similarity(df, "a", "b").collect()]
        assert got == [1 - 1 / 5001, 1.0]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.useLargeVarTypes")
