"""Sources and sinks (S1-S8, K1-K8) as round trips: given tables are written
under the shared checkpoint folder, read back by the matching reader, and the
rows compared with the tables themselves."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import permutation
from ..functions import text as T
from ..functions.permutation import md5_round
from ..operators import joins, metrics, ordering, select
from ..session import scratch_folder
from ..sources import positions, readers, sinks, trees
from ..sources.tables import table
from . import sqlparts as q
from . import standins as st


def _schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def json_arrays(spark: SparkSession, d: str) -> DataFrame:
    """K1 -> S1: documents as JSON arrays and back, whole texts."""
    docs, path = table(spark, d, "documents").select("doc_id", "lang", "text"), scratch_folder(spark, "arrays")
    sinks.write_json_array(docs, path, ["doc_id"])
    back = readers.read_json_array(spark, path, _schema("doc_id long, lang string, text string"))
    return back.select("doc_id", "lang", F.md5("text").alias("text_md5"))


JSON_ARRAYS_SQL = "SELECT doc_id, lang, md5(text) AS text_md5 FROM documents"


def appended_lines(spark: SparkSession, d: str) -> DataFrame:
    """K2 -> S2: labels appended in two runs and read as one."""
    labels, path = table(spark, d, "labels"), scratch_folder(spark, "lines")
    sinks.write_jsonl(labels.where("quality = 0"), path, "append")
    sinks.write_jsonl(labels.where("quality <> 0"), path, "append")
    return readers.read_jsonl(spark, path, _schema("doc_id long, quality int, toxic int"))


APPENDED_LINES_SQL = "SELECT doc_id, CAST(quality AS INTEGER) AS quality, CAST(toxic AS INTEGER) AS toxic FROM labels"


def line_folders(spark: SparkSession, d: str) -> DataFrame:
    """K1 (lines) -> S3: one folder per role, two of them read together."""
    turns, root = table(spark, d, "conversations"), scratch_folder(spark, "folders")
    for role in ("user", "assistant", "system"):
        sinks.write_jsonl(turns.where(F.col("role") == role), f"{root}/{role}")
    back = readers.read_jsonl_dirs(spark, f"{root}/user,{root}/assistant",
                                   _schema("conv_id long, turn int, role string, text string"), glob="*.json")
    return back.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


LINE_FOLDERS_SQL = """SELECT conv_id, CAST(turn AS INTEGER) AS turn, role, md5(text) AS text_md5 FROM conversations
WHERE role IN ('user', 'assistant')"""


def source_tree(spark: SparkSession, d: str) -> DataFrame:
    """One text file per nation, every file one row."""
    root = scratch_folder(spark, "tree")
    names = table(spark, d, "customer").select("c_nationkey", "c_name")
    names.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_name").write.partitionBy("c_nationkey").text(root)
    files = readers.read_source_tree(spark, root, "*.txt")
    return files.select(F.regexp_extract("name", r"c_nationkey=(\d+)", 1).cast("long").alias("nation"),
                        F.md5("text").alias("text_md5"))


SOURCE_TREE_SQL = """SELECT CAST(c_nationkey AS BIGINT) AS nation, md5(string_agg(c_name || chr(10), '' ORDER BY c_name)) AS text_md5
FROM customer GROUP BY c_nationkey"""


def tokenised_sets(spark: SparkSession, d: str) -> DataFrame:
    """K6 -> S6: columnar parts with a split column and a JSONL copy; the
    validation rows, an unsplit set beside them, and the copy's size."""
    root = scratch_folder(spark, "sets")
    k = F.col("doc_id") % 10
    docs = table(spark, d, "documents").select("doc_id", "n_chars", F.when(k == 0, "test").when(
        k == 1, "validation").otherwise("train").alias("split"))
    sinks.write_parts(docs, f"{root}/a", jsonl_path=f"{root}/lines")
    sinks.write_parts(select.drop_columns(docs.where(k == 2), ["split"]), f"{root}/b")
    dev = readers.load_tokenized(spark, [f"{root}/a", f"{root}/b"], "dev").select(
        "doc_id", F.coalesce("split", F.lit("none")).alias("split"))
    lines = readers.read_jsonl(spark, f"{root}/lines", _schema("doc_id long, n_chars long, split string"))
    return dev.unionByName(lines.groupBy("split").agg(F.count("doc_id").alias("doc_id")))


TOKENISED_SETS_SQL = """WITH s AS (SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END
  AS split FROM documents)
SELECT doc_id, split FROM s WHERE split = 'validation'
UNION ALL SELECT doc_id, 'none' FROM documents WHERE doc_id % 10 = 2
UNION ALL SELECT count(*), split FROM s GROUP BY split"""


def dataset_registry(spark: SparkSession, d: str) -> DataFrame:
    """A registry file names two data sets and their files; both are
    registered from it and queried by name."""
    root = scratch_folder(spark, "registry")
    orders, customers = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer").select("c_custkey")
    sinks.write_json_array(orders, f"{root}/data/orders.json")
    sinks.write_jsonl(customers, f"{root}/data/customers.jsonl")
    entries = {"registered_orders": {"file_name": "data/orders.json"}, "registered_customers": {"file_name": "data/customers.jsonl"}}
    spark.createDataFrame([(json.dumps(entries),)], "value string").coalesce(1).write.text(f"{root}/dataset_info.json")
    readers.load_registry(spark, f"{root}/dataset_info.json", {
        "registered_orders": orders.schema, "registered_customers": customers.schema})
    return spark.sql("SELECT c_custkey, count(o_orderkey) AS n FROM registered_customers LEFT JOIN registered_orders "
                     "ON o_custkey = c_custkey GROUP BY c_custkey")


DATASET_REGISTRY_SQL = """SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey
GROUP BY c_custkey"""


def keyword_lists(spark: SparkSession, d: str) -> DataFrame:
    """Comma-separated lines (one per order) -> distinct names."""
    path = scratch_folder(spark, "keywords")
    words = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.array_join(F.transform(F.collect_list("l_partkey"), lambda p: F.concat(F.lit(" part"), p.cast("string"))), " ,")
        .alias("value"))
    words.select("value").write.text(path)
    return readers.read_keyword_list(spark, path)


KEYWORD_LISTS_SQL = "SELECT DISTINCT 'part' || CAST(l_partkey AS VARCHAR) AS name FROM lineitem"


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Predictions as result files hold them: C or C++, named by their index.
    The join deals them packed."""
    p = st.predictions(spark, d).where("sample_id >= 0").select("sample_id", trees.packed("prediction").alias("prediction"), "decompiler")
    s = st.samples(spark, d).select("sample_id", "opt", "language")
    return s.join(p, "sample_id").select(F.col("sample_id").alias("index"), "opt", "decompiler", "prediction",
                                         F.when(F.col("language") == "en", "cpp").otherwise("c").alias("language"))


def result_files(spark: SparkSession, d: str) -> DataFrame:
    """K3 -> S5: one named file for each prediction, below decompiler and
    level; the tree is walked and parsed back."""
    path = scratch_folder(spark, "files")
    sinks.write_result_files(_results(spark, d), path, ["decompiler", "opt"], packed=True)
    back = readers.read_prediction_tree(spark, path)
    return back.select("index", "opt", "language", "decompiler", F.md5("prediction").alias("prediction_md5"))


RESULT_FILES_SQL = f"""WITH {q.SAMPLES}, {q.PREDICTIONS}
SELECT sample_id AS index, opt, CASE WHEN language = 'en' THEN 'cpp' ELSE 'c' END AS language, 'next4' AS decompiler,
       md5({q.strip_all('prediction')}) AS prediction_md5
FROM samples JOIN predictions USING (sample_id)"""


def result_tree(spark: SparkSession, d: str) -> DataFrame:
    """K3: predictions partitioned by level and language, read back."""
    path = scratch_folder(spark, "results")
    s = st.samples(spark, d).select("sample_id", "opt", "language")
    rows = s.join(st.predictions(spark, d).select("sample_id", "prediction"), "sample_id")
    sinks.write_result_tree(rows, path)
    back = spark.read.schema("sample_id long, prediction string, opt string, language string").json(path)
    return back.select("sample_id", "opt", "language", F.md5("prediction").alias("prediction_md5"))


RESULT_TREE_SQL = f"""WITH {q.SAMPLES}, {q.PREDICTIONS}
SELECT sample_id, opt, language, md5(prediction) AS prediction_md5 FROM samples JOIN predictions USING (sample_id)"""


def _rates(spark: SparkSession, d: str) -> DataFrame:
    s = st.samples(spark, d).select("sample_id", "opt", "language")
    return metrics.execute_rate(s.join(st.verdicts(spark, d), "sample_id"), ["language", "opt"])


RATES = f"""{q.SAMPLES}, {q.VERDICTS},
rates AS (SELECT language, opt, count(*) AS total, CAST(sum(flag_run) AS BIGINT) AS n_run,
                 round(sum(flag_run) * 100.0 / count(*), 6) AS exe_rate
          FROM samples JOIN verdicts USING (sample_id) GROUP BY language, opt)"""


def group_csv(spark: SparkSession, d: str) -> DataFrame:
    """K4: one CSV folder per language and level, read back with headers."""
    path = scratch_folder(spark, "csv")
    sinks.write_group_csv(_rates(spark, d), path)
    return spark.read.option("header", True).schema(
        "total long, n_run long, exe_rate double, language string, opt string").csv(path)


GROUP_CSV_SQL = f"WITH {RATES} SELECT total, n_run, exe_rate, language, opt FROM rates"


def result_lines(spark: SparkSession, d: str) -> DataFrame:
    """K5: ``group: rate`` lines appended twice; every line and how often."""
    path = scratch_folder(spark, "rates")
    rates = _rates(spark, d).withColumn("name", F.concat_ws("_", "language", "opt"))
    for _ in range(2):
        sinks.append_result_lines(rates, path, "name", "exe_rate")
    return spark.read.text(path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


RESULT_LINES_SQL = f"""WITH {RATES}
SELECT language || '_' || opt || ': ' || printf('%.2f', exe_rate) AS value, CAST(2 AS BIGINT) AS n FROM rates"""


def run_log(spark: SparkSession, d: str) -> DataFrame:
    """K7: one JSON record per judged sample with chosen fields; a missing
    optional field is left out of its record."""
    path = scratch_folder(spark, "log")
    s = st.samples(spark, d).select("sample_id", "opt").join(
        st.verdicts(spark, d).select("sample_id", "flag_run"), "sample_id", "left")
    sinks.write_run_log(s.withColumn("unused", F.lit("x")), path, ["sample_id", "opt", "flag_run"])
    return spark.read.text(path).select(F.get_json_object("value", "$.sample_id").cast("long").alias("sample_id"),
                                        F.col("value").contains("flag_run").alias("judged"),
                                        F.col("value").contains("unused").alias("unused"))


RUN_LOG_SQL = f"""WITH {q.SAMPLES}, {q.VERDICTS}
SELECT s.sample_id, v.sample_id IS NOT NULL AS judged, false AS unused FROM samples s LEFT JOIN verdicts v USING (sample_id)"""


def sibling_headers(spark: SparkSession, d: str) -> DataFrame:
    """K8: a tree of sources, a header file beside every one (empty where
    none was produced), all headers but those of the first run replaced by a
    second run; the tree is read back, sources too."""
    root = scratch_folder(spark, "headers")
    s = table(spark, d, "supplier").select(F.concat(F.lit("src/n"), F.col("s_nationkey").cast("string"), F.lit("/"),
                                                    F.col("s_suppkey").cast("string"), F.lit(".c")).alias("path"), "s_name", "s_acctbal")
    trees.write_tree(s, root, "path", "s_name")
    files = s.select("path")
    declared = s.where("s_acctbal > 0").select("path", F.concat(F.lit("int "), F.lower(F.translate("s_name", "#", "_")), F.lit(";"))
                                               .alias("header"))
    sinks.write_sibling_headers(files, declared.withColumn("header", F.upper("header")), root)
    sinks.write_sibling_headers(files, declared, root)
    back = readers.read_source_tree(spark, root, "*.{c,h}")
    return back.select(F.regexp_extract("name", r"(src/.*)$", 1).alias("path"), "text")


SIBLING_HEADERS_SQL = """WITH s AS (SELECT 'src/n' || s_nationkey || '/' || s_suppkey AS path, s_name, s_acctbal FROM supplier)
SELECT path || '.c' AS path, s_name AS text FROM s
UNION ALL SELECT path || '.h', CASE WHEN s_acctbal > 0 THEN 'int ' || lower(replace(s_name, '#', '_')) || ';' ELSE '' END FROM s"""


def positional_pairs(spark: SparkSession, d: str) -> DataFrame:
    """J3 + W5: two sets of line files without ids, samples and results, are
    paired i to i as they are read; the results are fewer."""
    root = scratch_folder(spark, "pairs")
    docs = table(spark, d, "documents")
    samples = docs.select("doc_id", F.col("text").alias("func"))
    outputs = docs.where("lang <> 'fr'").select("doc_id", F.upper(T.ascii_fold("text")).alias("output"))
    for df, name in ((samples, "samples"), (outputs, "outputs")):
        dealt = df.repartitionByRange(6, "doc_id").sortWithinPartitions("doc_id")
        sinks.write_jsonl(select.drop_columns(dealt, ["doc_id"]), f"{root}/{name}")
    left = spark.read.schema("func string").json(f"{root}/samples")
    right = spark.read.schema("output string").json(f"{root}/outputs")
    return positions.zip_inputs(left, right, ["output"]).select(
        "position", F.md5("func").alias("func_md5"), F.md5("output").alias("output_md5"))


POSITIONAL_PAIRS_SQL = f"""WITH a AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS position, md5(text) AS func_md5 FROM documents),
b AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS position, md5(upper({q.fold('text')})) AS output_md5 FROM documents
      WHERE lang <> 'fr')
SELECT position, func_md5, output_md5 FROM a JOIN b USING (position)"""


def resumable_order(spark: SparkSession, d: str) -> DataFrame:
    """W3 by arithmetic: rows numbered as they are read, their places in the
    second epoch of seed 42 over 3 replicas, resumed at position 5. No sort and
    no exchange of rows."""
    root = scratch_folder(spark, "epoch")
    ids = table(spark, d, "documents").select("doc_id")
    ids.repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id").write.json(root)
    rows = positions.with_input_position(spark.read.schema("doc_id long").json(root))
    n = spark.read.schema("doc_id long").json(root).count()
    return ordering.arithmetic_order(rows, "position", n, replicas=3, seed=42, epoch=1, start_index=5, h=md5_round).select(
        "doc_id", "rank", "local_pos")


def _feistel_sql() -> str:
    """Rounds of ``functions.permutation`` over columns x, a, b, n."""
    out = "SELECT i, n, a, b, x // b AS l, x % b AS r FROM walk WHERE NOT done"
    for k in range(permutation.ROUNDS):
        half = "r" if k % 2 == 0 else "l"
        h = f"CAST('0x' || substr(md5({half} || ':42:1:{k}'), 1, 15) AS BIGINT)"
        side = f"(l + {h} % a) % a AS l, r" if k % 2 == 0 else f"l, (r + {h} % b) % b AS r"
        out = f"SELECT i, n, a, b, {side} FROM ({out})"
    return f"SELECT i, n, a, b, l * b + r AS x, l * b + r < n AS done FROM ({out})"


RESUMABLE_ORDER_SQL = f"""WITH RECURSIVE size AS (SELECT count(*) AS n, CAST(floor(sqrt(count(*) - 1)) AS BIGINT) + 1 AS a FROM documents),
walk(i, n, a, b, x, done) AS (
  SELECT row_number() OVER (ORDER BY doc_id) - 1, n, a, (n + a - 1) // a, row_number() OVER (ORDER BY doc_id) - 1, false
  FROM documents, size
  UNION ALL {_feistel_sql()}),
placed AS (SELECT doc_id, x AS p, n FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)
           JOIN walk USING (i) WHERE done),
whole AS (SELECT doc_id, p FROM placed UNION ALL SELECT doc_id, p + n FROM placed WHERE p + n < CAST(ceil(n / 3.0) * 3 AS BIGINT))
SELECT doc_id, CAST(p % 3 AS INTEGER) AS rank, p // 3 - 5 AS local_pos FROM whole WHERE p // 3 - 5 >= 0"""


def chosen_columns(spark: SparkSession, d: str) -> DataFrame:
    """P3 + P2: the output column of each native decompiler, chosen by its
    name at run time, under one alias; the others dropped."""
    rows = st.native_outputs(spark, d).select("sample_id", "ida_pseudo", "ghidra_pseudo")
    per = [select.drop_columns(select.choose_column(rows, f"{x}_pseudo", "pseudo"), ["ida_pseudo", "ghidra_pseudo"])
           .withColumn("decompiler", F.lit(x)) for x in ("ida", "ghidra")]
    return joins.union_all(per).select("sample_id", "decompiler", F.md5("pseudo").alias("pseudo_md5"))


CHOSEN_COLUMNS_SQL = f"""WITH f AS (SELECT doc_id AS sample_id, {q.fold('text')} AS t FROM documents)
SELECT sample_id, 'ida' AS decompiler, md5(upper(t)) AS pseudo_md5 FROM f
UNION ALL SELECT sample_id, 'ghidra', md5(lower(t)) FROM f"""


QUERIES = {
    "s1_k1_json_arrays": json_arrays,
    "s2_k2_appended_lines": appended_lines,
    "s3_line_folders": line_folders,
    "s4_source_tree": source_tree,
    "s6_k6_tokenised_sets": tokenised_sets,
    "s7_dataset_registry": dataset_registry,
    "s8_keyword_lists": keyword_lists,
    "k3_result_tree": result_tree,
    "k4_group_csv": group_csv,
    "k5_result_lines": result_lines,
    "k7_run_log": run_log,
    "k8_sibling_headers": sibling_headers,
    "k3_s5_result_files": result_files,
    "j3_w5_positional_pairs": positional_pairs,
    "w3_resumable_order": resumable_order,
    "p3_chosen_columns": chosen_columns,
}

ORACLE = {
    "s1_k1_json_arrays": JSON_ARRAYS_SQL,
    "s2_k2_appended_lines": APPENDED_LINES_SQL,
    "s3_line_folders": LINE_FOLDERS_SQL,
    "s4_source_tree": SOURCE_TREE_SQL,
    "s6_k6_tokenised_sets": TOKENISED_SETS_SQL,
    "s7_dataset_registry": DATASET_REGISTRY_SQL,
    "s8_keyword_lists": KEYWORD_LISTS_SQL,
    "k3_result_tree": RESULT_TREE_SQL,
    "k4_group_csv": GROUP_CSV_SQL,
    "k5_result_lines": RESULT_LINES_SQL,
    "k7_run_log": RUN_LOG_SQL,
    "k8_sibling_headers": SIBLING_HEADERS_SQL,
    "k3_s5_result_files": RESULT_FILES_SQL,
    "j3_w5_positional_pairs": POSITIONAL_PAIRS_SQL,
    "w3_resumable_order": RESUMABLE_ORDER_SQL,
    "p3_chosen_columns": CHOSEN_COLUMNS_SQL,
}
