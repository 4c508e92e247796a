"""Physical-plan properties that matter at scale."""
import re

import pytest

from codecorpus.plans import registry

SF = "/root/testdata/sf0.001"
PYTHON_ALLOWED = {"eval_by_opt", "a1_edit_sim_by_dataset", "w2_a12_packing", "w2_packed_rows"}


def plan(spark, df):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_no_cross_products_and_python_only_where_needed(spark, name):
    text = plan(spark, registry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    has_python = bool(re.search(r"ArrowEvalPython|FlatMapGroupsInPandas|BatchEvalPython", text))
    assert has_python == (name in PYTHON_ALLOWED)


def test_filter_reaches_scan(spark):
    text = plan(spark, registry.queries()["p1_filtered_rate"](spark, SF))
    assert "EqualTo(lang,en)" in text
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in text


def test_flagship_shuffles_each_input_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(spark, registry.queries()["eval_by_opt"](spark, SF)).split("\n\n")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # four inputs (samples, predictions, verdicts, cost shares and their running sum and offsets), the dealt scoring, the final
    # aggregate; texts move twice, to the join and to the scoring task
    assert text.count("SortMergeJoin") == 3 and text.count("Exchange") <= 10


def test_text_work_appears_once(spark):
    """P7's cleaning is neither copied into a pushed-down filter nor into a
    guard of the generator."""
    df = registry.queries()["p7_j5_corpus_build"](spark, SF)
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Disassembly of section .text:\n") == 1


def test_failures_come_from_the_distinct_table(spark):
    text = plan(spark, registry.queries()["a9_a10_header_failures"](spark, SF)).split("\n\n")[0]
    assert "Expand" not in text and "Join" not in text


def test_zero_fill_uses_no_python_table(spark):
    text = plan(spark, registry.queries()["a8_count_by_opt"](spark, SF))
    assert "ExistingRDD" not in text
