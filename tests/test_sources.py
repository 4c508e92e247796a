import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from codecorpus.sources import readers, sinks

SCHEMA = StructType([StructField("index", LongType()), StructField("func", StringType()),
                     StructField("opt", StringType())])


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_json_array_and_non_list(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "a.json")
    _write(p, json.dumps([{"index": 1, "func": "f", "opt": "O0"}, {"index": 2, "func": "g", "opt": "O1"}], indent=2))
    assert sorted(r["index"] for r in readers.read_json_array(spark, p, SCHEMA).collect()) == [1, 2]
    q = os.path.join(tmpdir_path, "b.json")
    _write(q, json.dumps({"index": 1}))
    with pytest.raises(Exception, match="not a JSON array"):
        readers.read_json_array(spark, q, SCHEMA).collect()
    _write(q, '[{"index": 1}, {"index": tru')
    with pytest.raises(Exception):
        readers.read_json_array(spark, q, SCHEMA).collect()


def test_jsonl_and_dirs(spark, tmpdir_path):
    d1, d2 = os.path.join(tmpdir_path, "d1"), os.path.join(tmpdir_path, "d2")
    _write(os.path.join(d1, "x.jsonl"), '{"index": 1, "func": "a", "opt": "O0"}\n\n{"index": 2, "func": "b", "opt": "O1"}\n')
    _write(os.path.join(d1, "skip.json"), '{"index": 9}\n')
    _write(os.path.join(d1, "sub", "deep.jsonl"), '{"index": 8}\n')
    _write(os.path.join(d2, "y.jsonl"), '{"index": 3, "func": "c", "opt": "O2"}\n')
    assert readers.read_jsonl(spark, os.path.join(d1, "x.jsonl"), SCHEMA).count() == 2
    got = readers.read_jsonl_dirs(spark, f"{d1},{d2}", SCHEMA)
    assert sorted(r["index"] for r in got.collect()) == [1, 2, 3]
    with pytest.raises(Exception):
        readers.read_jsonl_dirs(spark, os.path.join(tmpdir_path, "missing"), SCHEMA).count()


def test_source_and_prediction_trees(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "src")
    _write(os.path.join(src, "a", "x.c"), "int f() {\n  return 1;\n}\n")
    _write(os.path.join(src, "b", "c", "y.c"), "int g;\n")
    _write(os.path.join(src, "b", "z.h"), "int h;\n")
    rows = readers.read_source_tree(spark, src).collect()
    assert sorted(r["text"] for r in rows) == ["int f() {\n  return 1;\n}\n", "int g;\n"]
    pred = os.path.join(tmpdir_path, "pred")
    _write(os.path.join(pred, "m1", "O0", "0_O0.c"), "  int a() {}\n\n")
    _write(os.path.join(pred, "m1", "O2", "1_O2.cpp"), "int b() {}")
    _write(os.path.join(pred, "m2", "O0", "0_O0.c"), "int c() {}")
    _write(os.path.join(pred, "m2", "O0", "notes.txt"), "x")
    for opt in ("O0", "O1", "O2", "O3"):
        _write(os.path.join(pred, "m3", opt, f"7_{opt}.c"), f"int {opt}() {{}}")
    _write(os.path.join(pred, "m3", "Os", "7_Os.c"), "int Os() {}")
    got = {(r["decompiler"], r["index"], r["opt"], r["language"]): r["prediction"]
           for r in readers.read_prediction_tree(spark, pred).collect()}
    assert got == {("m1", 0, "O0", "c"): "int a() {}", ("m1", 1, "O2", "cpp"): "int b() {}",
                   ("m2", 0, "O0", "c"): "int c() {}",
                   **{("m3", 7, o, "c"): f"int {o}() {{}}" for o in ("O0", "O1", "O2", "O3", "Os")}}
    last = {(r["decompiler"], r["index"]): r["opt"] for r in readers.read_prediction_tree(
        spark, pred, last_wins=True).collect()}
    assert last == {("m1", 0): "O0", ("m1", 1): "O2", ("m2", 0): "O0", ("m3", 7): "Os"}


def test_tokenized_and_registry_and_keywords(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "tok")
    spark.createDataFrame([([1, 2], "train"), ([3], "validation")], "input_ids array<int>, split string") \
        .write.parquet(p)
    assert readers.load_tokenized(spark, p, "dev").count() == 1
    assert readers.load_tokenized(spark, [p, p], "train").count() == 2
    assert readers.load_tokenized(spark, p, "test") is None
    unsplit = os.path.join(tmpdir_path, "unsplit")
    spark.createDataFrame([([4],)], "input_ids array<int>").write.parquet(unsplit)
    assert readers.load_tokenized(spark, [p, unsplit], "dev").count() == 2
    with pytest.raises(ValueError):
        readers.load_tokenized(spark, p, "bad")
    names = readers.register_datasets(spark, {"ds_a": spark.range(3)})
    assert names == ["ds_a"] and spark.sql("SELECT count(*) FROM ds_a").first()[0] == 3
    k = os.path.join(tmpdir_path, "kw.txt")
    _write(k, "printf, malloc,printf ,free,, memcpy\n")
    assert sorted(r["name"] for r in readers.read_keyword_list(spark, k).collect()) == \
        ["free", "malloc", "memcpy", "printf"]


def test_sinks_round_trip(spark, tmpdir_path):
    df = spark.createDataFrame([(1, "O0", "c", "m", 50.0), (2, "O1", "cpp", "m", 12.125)],
                               "index long, opt string, language string, decompiler string, exe_rate double")
    j = os.path.join(tmpdir_path, "j")
    sinks.write_jsonl(df, j)
    sinks.write_jsonl(df, j, mode="append")
    assert spark.read.json(j).count() == 4
    a = os.path.join(tmpdir_path, "arr")
    sinks.write_json_array(df, a, order=["index"])
    parts = [open(os.path.join(a, f)).read() for f in sorted(os.listdir(a)) if f.startswith("part-")]
    assert [r["index"] for p in parts if p for r in json.loads(p)] == [1, 2]
    t = os.path.join(tmpdir_path, "tree")
    sinks.write_result_tree(df, t)
    assert os.path.isdir(os.path.join(t, "opt=O1", "language=cpp"))
    c = os.path.join(tmpdir_path, "csv")
    sinks.write_group_csv(df.drop("index"), c)
    assert spark.read.option("header", True).csv(c).count() == 2
    lines = sorted(r[0] for r in sinks.result_lines(df).collect())
    assert lines == ["O0: 50.00", "O1: 12.12"]  # 12.125 is a tie
    r = os.path.join(tmpdir_path, "res")
    sinks.append_result_lines(df, r)
    sinks.append_result_lines(df, r)
    assert spark.read.text(r).count() == 4
    p = os.path.join(tmpdir_path, "parts")
    sinks.write_parts(df, p)
    assert spark.read.parquet(p).count() == 2
    log = os.path.join(tmpdir_path, "log")
    sinks.write_run_log(df.withColumn("stripped", F.lit(None).cast("string")), log, ["index", "opt", "stripped"])
    assert "stripped" not in open([os.path.join(log, f) for f in os.listdir(log) if f.endswith(".json")][0]).read()


def test_scratch_folders_can_be_dropped(spark):
    from codecorpus.session import drop_scratch, scratch_folder
    drop_scratch(spark)
    path = scratch_folder(spark, "scratch-test")
    spark.range(3).write.parquet(path)
    spark.range(3).checkpoint().count()
    assert drop_scratch(spark) == 1 and drop_scratch(spark) == 0
    with pytest.raises(Exception):
        spark.read.parquet(path).count()
