import pytest
from pyspark.sql import functions as F

from codecorpus.operators.memo import Memo
from codecorpus.operators import joins, metrics, select


def test_strict_join_fails_on_missing(spark):
    left = spark.createDataFrame([(1,), (2,)], "k long")
    right = spark.createDataFrame([(1, "a")], "k long, v string")
    with pytest.raises(Exception, match="no match on .*k.* for 2"):
        joins.strict_join(left, right, "k").collect()
    assert joins.strict_join(left.where("k = 1"), right, "k").collect() == [(1, "a")]


def test_tolerant_join_defaults(spark):
    left = spark.createDataFrame([(1,), (2,)], "k long")
    right = spark.createDataFrame([(1, "a")], "k long, v string")
    got = {r["k"]: (r["v"], r["_matched"]) for r in joins.tolerant_join(left, right, "k", {"v": ""}).collect()}
    assert got == {1: ("a", True), 2: ("", False)}


def test_per_distinct_once_per_key_and_nulls(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, "yy")], "id long, t string")
    out = joins.per_distinct(df, "t", lambda c: F.coalesce(F.length(c), F.lit(-1)), "n")
    assert {r["id"]: r["n"] for r in out.collect()} == {1: 1, 2: 1, 3: -1, 4: 2}


def test_enrich_or_drop_and_fallback(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    vals = spark.createDataFrame([(1, "h1"), (2, ""), (3, None)], "k long, h string")
    assert [r["dep"] for r in joins.enrich_or_drop(df, vals, "k", "h", "dep").collect()] == ["h1"]
    cached = spark.createDataFrame([(2, "c2")], "k long, h string")
    got = {r["k"]: r["h"] for r in joins.with_fallback(df, cached, ["k"], "h", F.concat(F.lit("n"), "k")).collect()}
    assert got == {1: "n1", 2: "c2", 3: "n3"}


def test_expand_and_repeat(spark):
    df = spark.createDataFrame([(1,)], "k long")
    assert sorted(r["d"] for r in joins.expand_values(df, "d", ["a", "b"]).collect()) == ["a", "b"]
    assert [r["request_no"] for r in joins.repeat_rows(df, 3).collect()] == [1, 2, 3]
    with pytest.raises(ValueError):
        joins.expand_values(df, "d", [])


def test_count_per_opt_zero_fill(spark):
    df = spark.createDataFrame([("O1",), ("O1",), ("O3",)], "opt string")
    assert {r["opt"]: r["n"] for r in metrics.count_per_opt(spark, df).collect()} == \
        {"O0": 0, "O1": 2, "O2": 0, "O3": 1}


def test_repeat_rates_average_over_repeats(spark):
    v = spark.createDataFrame([(1, "O0", 1, 1, 1), (2, "O0", 1, 1, 0), (1, "O0", 2, 0, 0), (3, "O1", 2, 1, 1)],
                              "sample_id long, opt string, repeat_no int, flag_compile int, flag_run int")
    got = {r["opt"]: r for r in metrics.repeat_rates(v).collect()}
    assert got["O0"]["avg_total"] == 1.5 and got["O0"]["compile_rate"] == round(2 / 3, 6)
    assert got["O1"]["avg_total"] == 0.5 and got["O1"]["run_rate"] == 1.0
    assert got["O3"]["avg_total"] == got["O3"]["run_rate"] == 0.0 and len(got) == 4


def test_select_where_and_filters(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "abcd")], "k long, t string")
    out = select.select_where(df, ["k"], {"n": F.length("t")}, lambda r: r["n"] > 2)
    assert [(r["k"], r["n"]) for r in out.collect()] == [(2, 4)]
    assert select.equal_filter(df, k=1).count() == 1
    assert select.choose_column(df, "t", "x").select("x").first()[0] == "ab"
    with pytest.raises(ValueError):
        select.choose_column(df, "nope", "x")


def test_hot_keys_split_from_cold(spark):
    rows = [(i, "hot") for i in range(50)] + [(100 + i, f"c{i}") for i in range(10)] + [(200, None)]
    df = spark.createDataFrame(rows, "id long, t string")
    out = joins.per_distinct(df, "t", lambda c: F.length(c), "n", hot_share=2)
    got = {r["id"]: r["n"] for r in out.collect()}
    assert len(got) == 61 and got[0] == 3 and got[105] == 2 and got[200] is None
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_encode_with_hot_tokens(spark):
    from codecorpus.functions.arrays import tokens
    from codecorpus.operators import packing
    df = spark.createDataFrame([(1, "a a a b"), (2, "a c")], "k long, t string")
    v = packing.vocabulary(df.select(tokens("t").alias("tokens")))
    for hot in (1, 3, 10 ** 6):
        enc = {r["k"]: r["input_ids"] for r in packing.encode(df, "k", "t", v, hot_share=hot).collect()}
        assert enc == {1: [2, 2, 2, 3], 2: [2, 4]}


def test_hot_cold_join_with_map_column(spark):
    rows = spark.createDataFrame([(i, "k", {"a": i}) for i in range(5)], "id long, key string, m map<string,long>")
    vals = spark.createDataFrame([("k", 5, "v")], "key string, n long, val string")
    out = joins.hot_cold_join(rows, vals, "key", "n", hot_share=2).collect()
    assert len(out) == 5 and all(r["val"] == "v" for r in out)


def test_per_distinct_calls_an_external_function_once_per_key(spark):
    df = spark.createDataFrame([(i, [None, "a", "bb"][i % 3]) for i in range(300)], "id long, t string")
    calls = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def slow(t):
        calls.add(1)
        return -1 if t is None else len(t)
    got = {r["id"]: r["n"] for r in joins.per_distinct(df, "t", slow, "n").collect()}
    assert got == {i: [-1, 1, 2][i % 3] for i in range(300)} and calls.value == 3


def test_fallback_computes_misses_only(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "k long")
    cached = spark.createDataFrame([(i, "c") for i in range(8)], "k long, h string")
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def slow(k):
        calls.add(1)
        return "n"
    rows = joins.with_fallback(df, cached, ["k"], "h", slow("k"), python=True).collect()
    assert sorted(r["h"] for r in rows) == ["c"] * 8 + ["n"] * 2 and calls.value == 2


def test_fallback_with_a_built_in_expression_joins_once(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    cached = spark.createDataFrame([(2, "c2"), (3, None)], "k long, h string")
    out = joins.with_fallback(df, cached, ["k"], "h", F.concat(F.lit("n"), "k"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
    assert {r["k"]: r["h"] for r in out.collect()} == {i: "c2" if i == 2 else f"n{i}" for i in range(10)}


def test_memo_computes_only_new_texts(spark, tmpdir_path):
    """Three runs and one that died before its commit."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def slow(t):
        calls.add(1)
        return None if not t else t.upper()
    memo = Memo(spark, f"{tmpdir_path}/memo")
    first = spark.createDataFrame([(i, ["a", "b", "", None][i % 4]) for i in range(40)], "id long, t string")
    want = {"a": "A", "b": "B", "": None, None: None, "c": "C"}
    got = memo.apply(first, "t", slow, "u").collect()
    assert calls.value == 4 and len(got) == 40 and all(r["u"] == want[r["t"]] for r in got)
    second = first.unionByName(spark.createDataFrame([(50, "c"), (51, "c")], first.schema))
    got = Memo(spark, f"{tmpdir_path}/memo").apply(second, "t", slow, "u").collect()
    assert calls.value == 5 and all(r["u"] == want[r["t"]] for r in got) and len(memo.versions()) == 2
    spark.createDataFrame([("dead", "x", 0)], "key string, value string, bucket int").write.partitionBy("bucket").parquet(
        f"{tmpdir_path}/memo/version=dead")
    assert memo.extend(second, "t", slow).count() == 0 and calls.value == 5 and len(memo.versions()) == 2
    assert memo.table().count() == 5
