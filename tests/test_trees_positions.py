import bz2
import gzip
import json
import os
import random
from urllib.parse import unquote

import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codecorpus.functions.permutation import hash_round, md5_round, permuted, unpermuted
from codecorpus.operators import ordering
from codecorpus.operators.partitioning import cost_shares, dealt_by_cost
from codecorpus.sources import json_arrays, positions, readers, sinks, trees


def _files(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), encoding="utf-8").read()
            for d, _, fs in os.walk(root) for f in fs}


# ------------------------------------------------------------------ K3, S5, K8

RESULTS = "index long, opt string, language string, decompiler string, prediction string"


def test_result_files_round_trip_and_replace(spark, tmpdir_path):
    rows = [(i, f"O{i % 4}", "c" if i % 3 else "cpp", "m", f" int é{i}();\n") for i in range(40)] + [(99, "O1", "c", "n", None)]
    df = spark.createDataFrame(rows, RESULTS).repartition(4)
    sinks.write_result_files(df, tmpdir_path, ["decompiler", "opt"])
    assert _files(tmpdir_path) == {f"{m}/{o}/{i}_{o}.{lang}": t or "" for i, o, lang, m, t in rows}
    got = {tuple(r) for r in readers.read_prediction_tree(spark, tmpdir_path).collect()}
    assert got == {(i, o, lang, m, (t or "").strip()) for i, o, lang, m, t in rows}
    sinks.write_result_files(df.where("index = 3"), tmpdir_path, ["decompiler", "opt"])
    assert set(_files(tmpdir_path)) == {"m/O3/3_O3.cpp"}
    sinks.write_result_files(df.where("index < 0"), tmpdir_path, ["decompiler", "opt"])
    assert _files(tmpdir_path) == {}


@pytest.mark.parametrize("bad", ["../x.c", "/x.c", "a//b.c", "", None, "a/./b", "_tree-1/x"])
def test_a_name_that_leaves_the_tree_leaves_it_as_it_was(spark, tmpdir_path, bad):
    trees.write_tree(spark.createDataFrame([("a.c", "old")], "path string, text string"), tmpdir_path)
    with pytest.raises(Exception, match="not a file name"):
        trees.write_tree(spark.createDataFrame([("b.c", "new"), (bad, "x")], "path string, text string"), tmpdir_path)
    assert _files(tmpdir_path) == {"a.c": "old"}


def test_two_rows_for_a_file_are_an_error(spark, tmpdir_path):
    with pytest.raises(Exception, match="two rows for the file"):
        trees.write_tree(spark.createDataFrame([("a.c", "1"), ("b.c", "2"), ("a.c", "3")], "path string, text string")
                         .repartition(3), tmpdir_path)
    assert _files(tmpdir_path) == {}


def test_a_task_that_fails_once_leaves_nothing_behind(spark, tmpdir_path):
    """An attempt that dies after writing files is not in the manifest."""
    writer = trees.TreeWriter(tmpdir_path, "job", False)
    lost = writer.write(iter([("a.c", "lost"), ("only-lost.c", "x")]))
    good = writer.write(iter([("a.c", "good")]))
    assert lost.folder != good.folder and readers.read_source_tree(spark, tmpdir_path).count() == 0
    writer.commit([good, None])
    assert trees.recover_tree(spark, tmpdir_path) == 1 and _files(tmpdir_path) == {"a.c": "good"}


def test_recovery(spark, tmpdir_path):
    trees.write_tree(spark.createDataFrame([("old.c", "old"), ("both.c", "1")], "path string, text string"), tmpdir_path)
    half = trees.TreeWriter(tmpdir_path, "half", True)
    told = half.write(iter([("both.c", "2"), ("d/new.c", "3")]))
    half.commit([told])
    # the publishing job died after it had cleared the tree and moved one file
    staging = os.path.join(tmpdir_path, "_tree-half")
    os.remove(os.path.join(tmpdir_path, "old.c"))
    os.replace(os.path.join(staging, told.folder, "both.c"), os.path.join(tmpdir_path, "both.c"))
    open(os.path.join(staging, "cleared"), "w").close()
    trees.TreeWriter(tmpdir_path, "never", True).write(iter([("x.c", "x")]))
    assert trees.recover_tree(spark, tmpdir_path) == 1
    assert _files(tmpdir_path) == {"both.c": "2", "d/new.c": "3"} and trees.recover_tree(spark, tmpdir_path) == 0


def test_no_task_lists_more_than_a_folder_of_files(spark, tmpdir_path, monkeypatch):
    """Attempts roll over to further folders; a tree is walked entry by entry."""
    monkeypatch.setattr(trees, "FILES", 3)
    writer = trees.TreeWriter(tmpdir_path, "job", False)
    rows = [(f"{'ab'[i // 5]}/{i}.c", "" if i % 2 else str(i)) for i in range(10)]
    told = writer.write(iter(rows))
    staging = os.path.join(tmpdir_path, "_tree-job")
    assert (told.files, told.folders) == (10, 4) and sorted(os.listdir(staging)) == sorted(told.all_folders())
    assert max(sum(len(f) for _, _, f in os.walk(os.path.join(staging, x))) for x in told.all_folders()) == 3
    writer.commit([told])
    assert trees.recover_tree(spark, tmpdir_path) == 1 and _files(tmpdir_path) == dict(rows)
    os.makedirs(f"{tmpdir_path}/a/_hidden/x")
    open(f"{tmpdir_path}/a/_hidden/x/0.c", "w").close()
    places = pd.DataFrame({"place": [f"{tmpdir_path}/a", f"{tmpdir_path}/b"], "folder": [True, True]})
    parts = list(trees._empty_below(tmpdir_path, "*.c")(iter([places])))
    assert [len(p) for p in parts] == [3, 2]
    assert {n for p in parts for n in p["file_name"]} == {"1.c", "3.c", "5.c", "7.c", "9.c"}


def test_headers_beside_sources(spark, tmpdir_path):
    trees.write_tree(spark.createDataFrame([("a/x.c", "int x;"), ("a/y.c", "int y;"), ("a.c/z.c", "int z;")],
                                           "path string, text string"), tmpdir_path)
    files = spark.createDataFrame([("a/x.c",), ("a/y.c",), ("a.c/z.c",)], "path string")
    sinks.write_sibling_headers(files, spark.createDataFrame([("a/x.c", "struct old;"), ("a/y.c", "struct y;")],
                                                             "path string, header string"), tmpdir_path)
    sinks.write_sibling_headers(files, spark.createDataFrame([("a/x.c", "struct s;"), ("none.c", "x")],
                                                             "path string, header string"), tmpdir_path)
    assert _files(tmpdir_path) == {"a/x.c": "int x;", "a/y.c": "int y;", "a.c/z.c": "int z;",
                                   "a/x.h": "struct s;", "a/y.h": "", "a.c/z.h": ""}


def test_prediction_names(spark, tmpdir_path):
    for name in ("7_O0_extra.c", "8_.cpp", "x_O1.c", "9.c", "10_O1.txt"):
        os.makedirs(f"{tmpdir_path}/m/O0", exist_ok=True)
        open(f"{tmpdir_path}/m/O0/{name}", "w").write("t")
    got = {(r["index"], r["opt"], r["language"]) for r in readers.read_prediction_tree(spark, tmpdir_path).collect()}
    assert got == {(7, "O0_extra", "c"), (8, "", "cpp")}


def test_rows_that_a_join_has_dealt_are_not_dealt_again(spark):
    left, right = (spark.range(50).select(F.col("id").alias("index"), F.concat(F.lit(c), F.col("id")).alias(c)) for c in "ab")
    rows = left.hint("merge").join(right, "index")
    for meet, exchanges in (("index", 2), (None, 3)):
        plan = trees.dealt_rows(rows, F.concat("a", F.lit(".c")), "b", meet)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == exchanges and plan.count("Sort [path") == 1


def test_two_indexes_that_give_one_name_are_an_error(spark, tmpdir_path):
    """The level of the first holds what reads as a folder and an index."""
    sinks.write_result_files(spark.createDataFrame([(7, "O0", "c", "a", "old")], RESULTS), tmpdir_path, ["decompiler", "opt"])
    rows = [(1, "x/2_y", "c", "a", "1"), (2, "y", "c", "a/1_x", "2")] + [(i, "O1", "c", "a", "") for i in range(3, 20)]
    df = spark.createDataFrame(rows, RESULTS)
    with pytest.raises(Exception, match="two rows for the file 'a/1_x/2_y.c'"):
        sinks.write_result_files(df, tmpdir_path, ["decompiler"])
    assert _files(tmpdir_path) == {"a/O0/7_O0.c": "old"}
    writer = trees.TreeWriter(tmpdir_path, "apart", True, met=False)  # two tasks, and one that had no rows
    writer.commit([writer.write(iter([(name, text, i)] if name else [])) for name, text, i in (
        ("a/1_x/2_y.c", "1", 1), (None, None, 0), ("a/1_x/2_y.c", "2", 2))])
    with pytest.raises(ValueError, match="two rows for the file 'a/1_x/2_y.c'"):
        trees.recover_tree(spark, tmpdir_path)
    assert _files(tmpdir_path) == {"a/O0/7_O0.c": "old"}
    sinks.write_result_files(df.where("index <> 2"), tmpdir_path, ["decompiler"])
    assert len(_files(tmpdir_path)) == 18


def test_packed_texts_are_written_whole(spark, tmpdir_path):
    texts = [None, "", "é\u2028 \r\n", "int x;\n" * 5000, "\x00\ud7ff😀"]
    df = spark.createDataFrame([(i, "O1", "c", "m", t) for i, t in enumerate(texts)], RESULTS)
    sinks.write_result_files(df.withColumn("prediction", trees.packed("prediction")), tmpdir_path, packed=True)
    for i, t in enumerate(texts):
        with open(f"{tmpdir_path}/O1/{i}_O1.c", "rb") as f:
            assert f.read() == (t or "").encode()


ODD_NAMES = ("a b.c", "é.c", "x%20y.c", "q?.c", "[z].c", "u|v.c", "p+q.c", "h#i.c", "t~'!().c", "s;=&,$@.c", "back\\s.c", 'q".c', "<l>.c",
             "nb\u00a0x.c", "em\u2003x.c", "c1\u0085x.c", "tab\tx.c", "_h.c", "_k=1.c", ".d.c", "x.h", "z.cpp", "_metadata.c")


def test_the_driver_lists_no_tree(spark, tmpdir_path, monkeypatch):
    """The rows of Spark's own reader and the empty files, without the list of
    files that it keeps in the driver."""
    for k, sub in enumerate(("", "m", "m/O 0", "m/O 0/deep/er", "_k=v", "_h", ".x", "_metadata_d")):
        os.makedirs(f"{tmpdir_path}/{sub}", exist_ok=True)
        for i, name in enumerate(ODD_NAMES):
            with open(f"{tmpdir_path}/{sub}/{name}", "wb") as f:
                f.write(b"" if (i + k) % 5 == 0 else b"\xff bad \xc3 " + name.encode() * (i + 1))
    os.makedirs(f"{tmpdir_path}/nothing/here")
    monkeypatch.setattr(trees, "FILES", 3)
    monkeypatch.setattr(trees, "BYTES", 100)

    def rows(glob, root, empty):
        df = readers.read_source_tree(spark, root, glob, empty)
        assert not (empty and df.inputFiles())
        found = [tuple(r) for r in df.select("name", F.hex(F.col("text").cast("binary"))).collect()]
        assert len(set(found)) == len(found)
        return set(found)
    for glob in ("*.c", "*.{c,h}", "[!x]*", "*"):
        for root in (tmpdir_path, f"file://{tmpdir_path}/"):
            got = rows(glob, root, True)
            assert {r for r in got if r[1]} == rows(glob, root, False)
    empty = {os.path.join(d, f)[len(tmpdir_path):] for d, _, fs in os.walk(tmpdir_path) for f in fs
             if os.path.getsize(os.path.join(d, f)) == 0 and "/_" not in os.path.join(d, f) and "/." not in os.path.join(d, f)}
    assert {unquote(r[0]).split(tmpdir_path)[1] for r in got if not r[1]} == empty and len(empty) > 10


def test_a_tree_that_is_not_there_and_packed_files(spark, tmpdir_path):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        readers.read_source_tree(spark, f"{tmpdir_path}/none")
    for end, pack in ((".gz", gzip.compress), (".bz2", bz2.compress), ("", bytes)):
        open(f"{tmpdir_path}/x.c{end}", "wb").write(pack(f"text {end}".encode()))
    got = {r["name"].rsplit("/", 1)[1]: r["text"] for r in readers.read_source_tree(spark, tmpdir_path, "*").collect()}
    assert got == {"x.c": "text ", "x.c.gz": "text .gz", "x.c.bz2": "text .bz2"}
    for end in ("lz4", "deflate", "snappy"):
        spark.range(3, numPartitions=1).select(F.concat(F.lit(end), F.col("id"))).write.option("compression", end).text(f"{tmpdir_path}/{end}")
    open(f"{tmpdir_path}/empty.lz4", "w").close()
    for glob in ("*", "*.{h,lz4}", "*.sna?py", "*.c"):
        got, own = ({tuple(r) for r in readers.read_source_tree(spark, tmpdir_path, glob, e).collect()} for e in (True, False))
        assert {r for r in got if r[1]} == own and len(own) == {"*": 6, "*.c": 1}.get(glob, 1)
    assert "lz40\nlz41\nlz42\n" in {r[0] for r in readers.read_source_tree(spark, tmpdir_path, "*").select("text").collect()}
    assert [trees.has_unread(spark, tmpdir_path, g) for g in ("*.{c,cpp}", "*.z4", "*", "*\\.lz4")] == [False, False, True, True]


# ------------------------------------------------------------------ S1, S7

DDL = "id long, text string, sub struct<a:array<struct<b:string>>, c:map<string,long>>"


def _records(n):
    rng = random.Random(n)
    out = [{"id": i, "text": "".join(rng.choices('ab{}[]",\\\n é:', k=rng.randrange(60))),
            "sub": {"a": [{"b": "}{" * rng.randrange(3)} for _ in range(rng.randrange(3))], "c": {"x": i}}} for i in range(n)]
    out.insert(n // 2, {"id": -1, "text": "spans many splits", "sub": {"a": [{"b": '"}'}] * 300, "c": {}}})
    return out


@pytest.fixture()
def split_bytes(spark):
    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
    yield use
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("size", ["128m", "3k", "500"])
@pytest.mark.parametrize("indent", [None, 2])
def test_array_file_read_by_several_tasks(spark, tmpdir_path, split_bytes, size, indent):
    records, schema = _records(150), StructType.fromDDL(DDL)
    path = f"{tmpdir_path}/a.json"
    with open(path, "w") as f:
        json.dump(records, f, indent=indent)
    split_bytes(size)
    if size != "128m":
        assert spark.read.text(path, lineSep="}").rdd.getNumPartitions() > 5
    want = sorted(repr(r.asDict(True)) for r in spark.createDataFrame(records, schema).collect())
    assert sorted(repr(r.asDict(True)) for r in readers.read_json_array(spark, path, schema).collect()) == want


def test_empty_arrays_and_several_files(spark, tmpdir_path):
    for name, text in (("a", "[]"), ("b", " [ \n]\n"), ("c", '[{"id": 1}]'), ("d", '\n[\n{"id": 2}\n,{"id": 3}\n]\n')):
        open(f"{tmpdir_path}/{name}.json", "w").write(text)
    got = readers.read_json_array(spark, tmpdir_path, StructType.fromDDL("id long")).collect()
    assert sorted(r["id"] for r in got) == [1, 2, 3]


@pytest.mark.parametrize("bad", ['{"id":1}', '[{"id":1},{"id":2', '[{"id":1}, {"id": tru}]', '[{"id":1}]]', '["x"]', "3",
                                 '[{"id":1} {"id":2}]', '[{"id":1}, 5]', '[{"id":1},{"id":2}', '[{"id":1}]\n{', '[{"id":"}]'])
def test_broken_arrays_are_errors(spark, tmpdir_path, bad):
    open(f"{tmpdir_path}/x.json", "w").write(bad)
    with pytest.raises(Exception):
        readers.read_json_array(spark, tmpdir_path, StructType.fromDDL("id long")).collect()


def test_piece_maps():
    assert json_arrays.piece_map('{"a": "x\\"}') == (True, 1, -1)
    assert json_arrays.piece_map(' tail", "b": [1, 2]}') == (True, 0, -1)


def test_registry_file(spark, tmpdir_path):
    root = tmpdir_path
    open(f"{root}/a.json", "w").write('[{"id": 1}, {"id": 2}]')
    open(f"{root}/b.jsonl", "w").write('{"id": 3}\n')
    spark.range(4).write.parquet(f"{root}/c.parquet")
    open(f"{root}/info.json", "w").write(json.dumps({
        "reg_a": {"file_name": "a.json"}, "reg_b": {"file_name": "b.jsonl"}, "reg_c": {"file_name": "c.parquet"}, "none": {}}))
    schemas = {"reg_a": StructType.fromDDL("id long"), "reg_b": StructType.fromDDL("id long")}
    names = readers.load_registry(spark, f"{root}/info.json", schemas, ["reg_a", "reg_b", "reg_c"])
    assert names == ["reg_a", "reg_b", "reg_c"]
    assert [spark.table(n).count() for n in names] == [2, 1, 4]
    for wanted in (["missing"], ["none"]):
        with pytest.raises(ValueError, match="no data set"):
            readers.load_registry(spark, f"{root}/info.json", schemas, wanted)
    with pytest.raises(ValueError, match="no schema"):
        readers.load_registry(spark, f"{root}/info.json", {}, ["reg_a"])


# ------------------------------------------------------------------ W5, J3

@pytest.mark.parametrize("size", ["128m", "200"])
def test_positions_follow_files_and_lines(spark, tmpdir_path, split_bytes, size):
    texts = {"a.txt": [f"a{i}" for i in range(100)], "b.txt": [], "c.txt": [f"c{i} " * (i % 7) for i in range(60)]}
    for name, lines in texts.items():
        open(f"{tmpdir_path}/{name}", "w").write("".join(x + "\n" for x in lines))
    split_bytes(size)
    rows = positions.with_input_position(spark.read.text(tmpdir_path)).collect()
    want = [x for name in sorted(texts) for x in texts[name]]
    assert {r["position"]: r["value"] for r in rows} == dict(enumerate(want)) and len(rows) == len(want)


def test_zip_takes_the_shorter_side(spark, tmpdir_path, split_bytes):
    open(f"{tmpdir_path}/l.txt", "w").write("".join(f"l{i}\n" for i in range(50)))
    open(f"{tmpdir_path}/r.txt", "w").write("".join(f"r{i}\n" for i in range(37)))
    split_bytes("64")
    got = positions.zip_inputs(spark.read.text(f"{tmpdir_path}/l.txt"), spark.read.text(f"{tmpdir_path}/r.txt"),
                               [F.col("value").alias("other")]).collect()
    assert {(r["position"], r["value"], r["other"]) for r in got} == {(i, f"l{i}", f"r{i}") for i in range(37)}


# ------------------------------------------------------------------ W3

@pytest.mark.parametrize("h", [hash_round, md5_round])
def test_permutation_for_any_n(spark, h):
    for n in [*range(1, 18), 97, 100, 1023, 5000]:
        df = spark.range(n).select("id", permuted(F.col("id"), n, 7, 2, h).alias("p"))
        rows = df.select("id", "p", unpermuted(F.col("p"), n, 7, 2, h).alias("back")).collect()
        assert sorted(r["p"] for r in rows) == list(range(n)) and all(r["back"] == r["id"] for r in rows)


def test_epochs_differ_and_neighbours_part(spark):
    n = 4000
    rows = spark.range(n).select(permuted(F.col("id"), n, 1, 0).alias("a"), permuted(F.col("id"), n, 1, 1).alias("b"),
                                 permuted(F.col("id"), n, 2, 0).alias("c")).collect()
    for x, y in (("a", "b"), ("a", "c")):
        assert sum(r[x] == r[y] for r in rows) < 12
    steps = [abs(rows[i + 1]["a"] - rows[i]["a"]) for i in range(n - 1)]
    assert 1100 < sum(steps) / len(steps) < 1560  # n / 3 for a random order
    fixed = sum(r["a"] == i for i, r in enumerate(rows))
    assert fixed < 12


def test_large_n(spark):
    n = 10 ** 13 + 7
    rows = spark.createDataFrame([(x,) for x in (0, 1, 2, n - 1, n // 2)], "i long").select(
        "i", permuted(F.col("i"), n, 3, 0).alias("p")).select("i", "p", unpermuted(F.col("p"), n, 3, 0).alias("back")).collect()
    assert all(0 <= r["p"] < n and r["back"] == r["i"] for r in rows) and len({r["p"] for r in rows}) == 5


@pytest.mark.parametrize("n", [0, 1, 2, 10, 11, 100])
@pytest.mark.parametrize("drop_last", [False, True])
def test_shards_and_resume(spark, n, drop_last):
    df = spark.range(n).withColumnRenamed("id", "i")
    for start in (0, 2):
        rows = ordering.arithmetic_order(df, "i", n, 3, seed=5, epoch=1, start_index=start, drop_last=drop_last).collect()
        per = n // 3 if drop_last else -(-n // 3)
        by_rank = {k: sorted((r["local_pos"], r["i"]) for r in rows if r["rank"] == k) for k in range(3)}
        for k in range(3):
            assert [p for p, _ in by_rank[k]] == list(range(max(0, per - start)))
            resumed = ordering.order_range(spark, n, 3, k, start, per, seed=5, epoch=1, drop_last=drop_last).collect()
            assert sorted((r["local_pos"] - start, r["row_index"]) for r in resumed) == by_rank[k]
        if start == 0 and not drop_last:
            assert {r["i"] for r in rows} == set(range(n))
        if drop_last:
            assert len({r["i"] for r in rows}) == len(rows)


def test_an_epoch_exchanges_nothing(spark):
    df = ordering.arithmetic_order(spark.range(100).withColumnRenamed("id", "i"), "i", 100, 4, start_index=3)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


# ------------------------------------------------------------------ T9 dealing

def test_tasks_get_equal_shares_of_a_skewed_cost(spark):
    rng = random.Random(2)
    rows = [(i, float(int(10 ** (rng.random() * 4)))) for i in range(3000)]
    costs = spark.createDataFrame(rows, "id long, cost double").repartition(3)
    dealt = dealt_by_cost(costs.select("id", F.col("cost").alias("c")), costs, "id", 16)
    assert dealt.rdd.getNumPartitions() == 16
    sums = sorted(r[1] for r in dealt.groupBy(F.spark_partition_id()).agg(F.sum("c")).collect())
    assert len(sums) == 16 and sums[-1] <= 1.5 * sums[8] and dealt.count() == 3000
    assert cost_shares(costs.where("id < 0"), "id", 4).count() == 0


# ------------------------------------------------------------------ K5, K7

def test_two_decimals_round_the_binary_value(spark):
    rng = random.Random(4)
    xs = [2.675, 0.125, 1.005, 0.375, 1.115, 12.345, 0.0, -0.0, -0.001, -2.675, 99.995, 33.333333, 100.0, 0.005, 0.015, 1e-300,
          2.5, 1234567.885, 8.5e12 + 0.125, 3e14, float("nan"), float("inf"), float("-inf")]
    xs += [rng.randrange(10 ** 6) / 8 / 100 for _ in range(500)] + [round(rng.random() * 100, 3) for _ in range(2000)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = {r["i"]: r["t"] for r in df.select("i", sinks.two_decimals(F.col("x")).alias("t")).collect()}
    assert {i: t for i, t in got.items() if t != "%.2f" % xs[i]} == {}


def test_log_counts_come_from_its_write(spark, tmpdir_path):
    computed = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def status(i):
        computed.add(1)
        return "accepted" if i % 2 else "rejected"
    df = spark.range(10).select("id", status("id").alias("status"), F.concat(F.lit("O"), (F.col("id") % 3)).alias("opt"))
    stats = sinks.write_run_log(df, f"{tmpdir_path}/log", ["id", "status"], "opt", ["O0", "O1", "O2", "O3"],
                                {"accepted": F.col("status") == "accepted"})
    assert stats == {"total": 10, "accepted": 5, "level O0": 4, "level O1": 3, "level O2": 3, "level O3": 0}
    assert computed.value == 10 and spark.read.json(f"{tmpdir_path}/log").count() == 10
    lines = [r[0] for r in spark.read.text(f"{tmpdir_path}/log/_stats").collect()]
    assert sorted(lines) == sorted(f"{k}: {v}" for k, v in stats.items())
