"""Evaluation queries (pipeline D): samples JOIN predictions JOIN verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.similarity import with_edit_similarity
from ..operators import joins, metrics, ordering, select
from ..operators.partitioning import dealt_by_cost
from . import sqlparts as q
from . import standins as st
from .normalise import function_name_sql


def scored_samples(spark: SparkSession, d: str, with_verdicts: bool = False) -> DataFrame:
    """Per sample: edit similarity of its prediction ('' when missing, J2),
    optionally with its verdict flags. The joins are left to adaptive
    execution; the scoring, whose cost is the product of two lengths (and of
    the text rules, some 800 cells a character), reads rows dealt by that cost,
    pairs of like lengths together."""
    s = st.samples(spark, d).select("sample_id", "opt", "dataset", "language", "func")
    p = st.predictions(spark, d).select("sample_id", "prediction")
    sp = joins.tolerant_join(s, p, "sample_id", {"prediction": ""})
    keep = ["sample_id", "opt", "dataset", "language", F.col("_matched").alias("matched"), "edit_sim"]
    if with_verdicts:
        v = st.verdicts(spark, d).select("sample_id", "flag_compile", "flag_run")
        sp = sp.join(v, "sample_id", "left")
        keep += ["flag_compile", "flag_run"]
    sizes = s.select("sample_id", F.length("func").alias("a")).join(
        p.select("sample_id", F.length("prediction").alias("b")), "sample_id", "left")
    cells = sizes.select("sample_id", "a", F.coalesce("b", F.lit(0)).alias("b")).select(
        "sample_id", F.floor(F.log(1.2, F.greatest("a", "b") + 64)).alias("longer"), F.least("a", "b").alias("shorter"),
        (F.col("a").cast("double") * F.col("b") + 800.0 * (F.col("a") + F.col("b")) + 1).alias("cost"))
    dealt = dealt_by_cost(sp, cells, "sample_id", alike=["longer", "shorter"])
    folded = dealt.withColumns({c: T.ascii_fold(c) for c in ("func", "prediction")})
    scored = with_edit_similarity(folded, "func", "prediction", "edit_sim")
    return scored.select(*keep)


def eval_by_opt(spark: SparkSession, d: str) -> DataFrame:
    """M0 flagship: per opt level, mean edit similarity (A1) and compile /
    execute rates (A2) in one job."""
    j = scored_samples(spark, d, with_verdicts=True)
    judged = F.count("flag_run")
    return j.groupBy("opt").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.count_if("matched").alias("n_predicted"),
        F.round(F.avg("edit_sim"), 6).alias("mean_edit_sim"),
        judged.alias("n_judged"),
        F.sum("flag_compile").cast("long").alias("n_compile"),
        F.sum("flag_run").cast("long").alias("n_run"),
        F.round(F.when(judged > 0, F.sum("flag_run") * 100.0 / judged), 6).alias("exe_rate"))


EVAL_BY_OPT_SQL = f"""WITH {q.SAMPLES}, {q.PREDICTIONS}, {q.VERDICTS}, {q.SCORED}
SELECT opt, count(*) AS n_samples, count(*) FILTER (WHERE matched) AS n_predicted,
       round(avg(edit_sim), 6) AS mean_edit_sim, count(v.flag_run) AS n_judged,
       CAST(sum(v.flag_compile) AS BIGINT) AS n_compile, CAST(sum(v.flag_run) AS BIGINT) AS n_run,
       round(CASE WHEN count(v.flag_run) > 0 THEN sum(v.flag_run) * 100.0 / count(v.flag_run) END, 6) AS exe_rate
FROM similarity LEFT JOIN verdicts v USING (sample_id)
GROUP BY opt"""


def edit_sim_by_dataset(spark: SparkSession, d: str) -> DataFrame:
    """A1: mean edit similarity per dataset."""
    return metrics.mean_edit_similarity(scored_samples(spark, d), ["dataset"])


EDIT_SIM_BY_DATASET_SQL = f"""WITH {q.SAMPLES}, {q.PREDICTIONS}, {q.SCORED}
SELECT dataset, count(*) AS n, round(avg(edit_sim), 6) AS mean_edit_sim
FROM similarity GROUP BY dataset"""


def exec_rate_by_opt(spark: SparkSession, d: str) -> DataFrame:
    """A2: execute rate per opt over judged samples (samples JOIN verdicts)."""
    s = st.samples(spark, d).select("sample_id", "opt")
    return metrics.execute_rate(s.join(st.verdicts(spark, d), "sample_id"), ["opt"])


EXEC_RATE_BY_OPT_SQL = f"""WITH {q.SAMPLES}, {q.VERDICTS}
SELECT opt, count(*) AS total, CAST(sum(flag_run) AS BIGINT) AS n_run,
       round(sum(flag_run) * 100.0 / count(*), 6) AS exe_rate
FROM samples JOIN verdicts USING (sample_id) GROUP BY opt"""


#: Reported levels; nothing was compiled at the last one.
LEVELS = [*st.OPTS, "Os"]


def repeat_rates_by_opt(spark: SparkSession, d: str) -> DataFrame:
    """A3: compile / run rate per opt averaged over repeats (lineitem scale)."""
    return metrics.repeat_rates(st.repeat_verdicts(spark, d), LEVELS)


REPEAT_RATES_SQL = f"""WITH {q.REPEAT_VERDICTS},
per AS (SELECT repeat_no, opt, sum(flag_compile) AS c, sum(flag_run) AS r, count(*) AS t
        FROM repeat_verdicts GROUP BY repeat_no, opt),
nr AS (SELECT count(DISTINCT repeat_no) AS n_rep FROM per),
agg AS (SELECT opt, sum(c) / any_value(n_rep) AS avg_compile, sum(r) / any_value(n_rep) AS avg_run,
               sum(t) / any_value(n_rep) AS avg_total FROM per, nr GROUP BY opt)
SELECT opt, round(avg_compile, 6) AS avg_compile, round(avg_run, 6) AS avg_run, round(avg_total, 6) AS avg_total,
       round(CASE WHEN avg_total > 0 THEN avg_compile / avg_total ELSE 0.0 END, 6) AS compile_rate,
       round(CASE WHEN avg_total > 0 THEN avg_run / avg_total ELSE 0.0 END, 6) AS run_rate
FROM (SELECT opt, coalesce(avg_compile, 0.0) AS avg_compile, coalesce(avg_run, 0.0) AS avg_run,
             coalesce(avg_total, 0.0) AS avg_total
      FROM (SELECT unnest(['O0', 'O1', 'O2', 'O3', 'Os']) AS opt) LEFT JOIN agg USING (opt))"""


def fixed_rate_by_opt(spark: SparkSession, d: str) -> DataFrame:
    """A4: run count per opt over a fixed denominator floor(N / 4)."""
    s = st.samples(spark, d).select("sample_id", "opt")
    return metrics.fixed_denominator_rate(s.join(st.verdicts(spark, d), "sample_id", "left"))


FIXED_RATE_SQL = f"""WITH {q.SAMPLES}, {q.VERDICTS},
per AS (SELECT opt, coalesce(sum(flag_compile), 0) AS c, coalesce(sum(flag_run), 0) AS r, count(*) AS n
        FROM samples LEFT JOIN verdicts USING (sample_id) GROUP BY opt),
t AS (SELECT floor(sum(n) / 4) AS denom FROM per)
SELECT opt, CAST(c AS BIGINT) AS n_compile, CAST(r AS BIGINT) AS n_run,
       round(c * 100.0 / denom, 6) AS fixed_compile_rate, round(r * 100.0 / denom, 6) AS fixed_run_rate
FROM per, t"""


def totals_rollup(spark: SparkSession, d: str) -> DataFrame:
    """A5: totals per opt and overall in one grouping-sets pass (lineitem scale)."""
    return metrics.totals_with_overall(st.repeat_verdicts(spark, d))


TOTALS_ROLLUP_SQL = f"""WITH {q.REPEAT_VERDICTS}
SELECT opt, count(*) AS total, CAST(sum(flag_compile) AS BIGINT) AS n_compile,
       CAST(sum(flag_run) AS BIGINT) AS n_run, round(sum(flag_run) / count(*), 6) AS run_ratio
FROM repeat_verdicts GROUP BY ROLLUP (opt)"""


def count_by_opt(spark: SparkSession, d: str) -> DataFrame:
    """Judged samples per opt, all four levels reported (zero-filled)."""
    s = st.samples(spark, d).select("sample_id", "opt")
    judged = s.join(st.verdicts(spark, d).where(F.col("flag_run") == 1), "sample_id")
    return metrics.count_per_opt(spark, judged, LEVELS)


COUNT_BY_OPT_SQL = f"""WITH {q.SAMPLES}, {q.VERDICTS},
c AS (SELECT opt, count(*) AS n FROM samples JOIN verdicts USING (sample_id) WHERE flag_run = 1 GROUP BY opt),
levels AS (SELECT unnest(['O0', 'O1', 'O2', 'O3', 'Os']) AS opt)
SELECT opt, CAST(coalesce(n, 0) AS BIGINT) AS n FROM levels LEFT JOIN c USING (opt)"""


def strict_verdict_join(spark: SparkSession, d: str) -> DataFrame:
    """Every verdict must find its sample (fails otherwise); run counts
    per language."""
    s = st.samples(spark, d).select("sample_id", "language")
    j = joins.strict_join(st.verdicts(spark, d), s, "sample_id")
    return j.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.sum("flag_run").cast("long").alias("n_run"))


STRICT_VERDICT_JOIN_SQL = f"""WITH {q.SAMPLES}, {q.VERDICTS}
SELECT language, count(*) AS n, CAST(sum(flag_run) AS BIGINT) AS n_run
FROM verdicts JOIN samples USING (sample_id) GROUP BY language"""


def _all_predictions(spark: SparkSession, d: str) -> DataFrame:
    """A13 input: native decompilers from columns (unpivot), the model from
    files, one long table (sample_id, decompiler, prediction)."""
    nat = st.native_outputs(spark, d).select(
        "sample_id", F.col("ida_pseudo").alias("ida"), F.col("ghidra_pseudo").alias("ghidra"))
    native = nat.unpivot("sample_id", ["ida", "ghidra"], "decompiler", "prediction")
    return joins.union_all([native, st.predictions(spark, d)])


def _prediction_flags(spark: SparkSession, d: str) -> DataFrame:
    """(sample_id, decompiler, has_pred): the rate needs only whether a
    non-empty prediction exists, so that flag is computed before the join
    and no prediction text crosses the shuffle."""
    return _all_predictions(spark, d).select("sample_id", "decompiler", (F.col("prediction") != "").alias("has_pred"))


def two_source_rates(spark: SparkSession, d: str) -> DataFrame:
    """A13 + J4 + J2: samples x decompilers (explode of the decompiler list),
    tolerant join to predictions from both sources, the same run rate for
    all: a sample runs if its verdict says so and a prediction exists."""
    decs = ["ida", "ghidra", "next4"]
    s = joins.expand_values(st.samples(spark, d).select("sample_id", "opt", "language"), "decompiler", decs, least=2)
    j = joins.tolerant_join(s, _prediction_flags(spark, d), ["sample_id", "decompiler"], {"has_pred": False})
    v = st.verdicts(spark, d).select("sample_id", "flag_run")
    j = j.join(v, "sample_id").withColumn("ok", ((F.col("flag_run") == 1) & F.col("has_pred")).cast("int"))
    return j.groupBy("decompiler", "opt").agg(
        F.count(F.lit(1)).alias("total"), F.sum("ok").cast("long").alias("n_run"),
        F.round(F.sum("ok") * 100.0 / F.count(F.lit(1)), 6).alias("exe_rate"))


ALL_PREDICTIONS = f"""{q.NATIVE}, {q.PREDICTIONS},
allpred AS (SELECT sample_id, 'ida' AS decompiler, ida_pseudo AS prediction FROM native
            UNION ALL SELECT sample_id, 'ghidra', ghidra_pseudo FROM native
            UNION ALL SELECT sample_id, decompiler, prediction FROM predictions),
expanded AS (SELECT s.sample_id, s.opt, s.language, dd.decompiler, coalesce(p.prediction, '') AS prediction
             FROM samples s CROSS JOIN (SELECT unnest(['ida', 'ghidra', 'next4']) AS decompiler) dd
             LEFT JOIN allpred p ON p.sample_id = s.sample_id AND p.decompiler = dd.decompiler),
judged AS (SELECT e.*, CAST(v.flag_run = 1 AND e.prediction <> '' AS INTEGER) AS ok
           FROM expanded e JOIN verdicts v USING (sample_id))"""

TWO_SOURCE_RATES_SQL = f"""WITH {q.SAMPLES}, {q.VERDICTS}, {ALL_PREDICTIONS}
SELECT decompiler, opt, count(*) AS total, CAST(sum(ok) AS BIGINT) AS n_run,
       round(sum(ok) * 100.0 / count(*), 6) AS exe_rate
FROM judged GROUP BY decompiler, opt"""


def aligned_outputs(spark: SparkSession, d: str) -> DataFrame:
    """A13 texts: the native decompilers' outputs are renamed twice (the raw
    token with its stars first, then the extracted name), the model's once."""
    native = st.native_outputs(spark, d)
    wrap = lambda c: F.concat(F.lit("int **"), F.lower("func_name"), F.lit("_0(int a) { "), F.col(c), F.lit(" }"))
    nat = native.select("sample_id", "func_name", wrap("ida_pseudo").alias("ida"), wrap("ghidra_pseudo").alias("ghidra"))
    nat = nat.unpivot(["sample_id", "func_name"], ["ida", "ghidra"], "decompiler", "text")
    nat = nat.withColumn("text", T.align_name(F.col("text"), T.raw_name_token("text"), F.col("func_name")))
    names = st.samples(spark, d).select("sample_id", "func_name")
    model = st.predictions(spark, d).join(names, "sample_id").select(
        "sample_id", "func_name", "decompiler", F.col("prediction").alias("text"))
    both = joins.union_all([nat, model])
    text = T.align_name(F.col("text"), T.function_name("text"), F.col("func_name"))
    return both.select("sample_id", "decompiler", text.alias("text")).select(
        "sample_id", "decompiler", F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"))


_RAW_TOKEN = "split_part(split_part(text, '(', 1), ' ', -1)"
ALIGNED_OUTPUTS_SQL = f"""WITH {q.SAMPLES}, {q.PREDICTIONS}, {q.NATIVE},
nat AS (
  SELECT sample_id, func_name, 'ida' AS decompiler, 'int **' || lower(func_name) || '_0(int a) {{ ' || ida_pseudo || ' }}' AS text
  FROM native UNION ALL
  SELECT sample_id, func_name, 'ghidra', 'int **' || lower(func_name) || '_0(int a) {{ ' || ghidra_pseudo || ' }}' FROM native),
once AS (SELECT sample_id, func_name, decompiler,
           CASE WHEN {_RAW_TOKEN} = '' THEN text ELSE replace(text, {_RAW_TOKEN}, func_name) END AS text FROM nat
         UNION ALL SELECT sample_id, func_name, decompiler, prediction FROM predictions JOIN samples USING (sample_id)),
named AS (SELECT *, {function_name_sql('text')} AS name FROM once),
twice AS (SELECT sample_id, decompiler, CASE WHEN name = '' THEN text ELSE replace(text, name, func_name) END AS text FROM named)
SELECT sample_id, decompiler, md5(text) AS text_md5, CAST(length(text) AS INTEGER) AS n_chars FROM twice"""


def rate_by_test(spark: SparkSession, d: str) -> DataFrame:
    """Execute rate of samples with and without a test (null and blank
    tests count as none)."""
    k = F.col("sample_id") % 5
    s = st.samples(spark, d).select("sample_id", "opt", T.has_test(
        F.when(k == 0, F.lit(" \n")).when(k == 1, F.lit(None).cast("string")).otherwise(F.col("func"))).alias("has_test"))
    return metrics.execute_rate(s.join(st.verdicts(spark, d), "sample_id"), ["opt", "has_test"])


RATE_BY_TEST_SQL = f"""WITH {q.SAMPLES}, {q.VERDICTS},
s AS (SELECT sample_id, opt, coalesce({q.strip("CASE sample_id % 5 WHEN 0 THEN ' ' || chr(10) WHEN 1 THEN NULL ELSE func END")}, '')
             <> '' AS has_test FROM samples)
SELECT opt, has_test, count(*) AS total, CAST(sum(flag_run) AS BIGINT) AS n_run,
       round(sum(flag_run) * 100.0 / count(*), 6) AS exe_rate
FROM s JOIN verdicts USING (sample_id) GROUP BY opt, has_test"""


def metric_table_by_group(spark: SparkSession, d: str) -> DataFrame:
    """One row per (language, opt, decompiler), one column per metric."""
    decs = ["ida", "ghidra", "next4"]
    s = joins.expand_values(st.samples(spark, d).select("sample_id", "opt", "language"), "decompiler", decs, least=2)
    j = joins.tolerant_join(s, _prediction_flags(spark, d), ["sample_id", "decompiler"], {"has_pred": False})
    j = j.join(st.verdicts(spark, d).select("sample_id", "flag_run"), "sample_id").withColumn(
        "ok", ((F.col("flag_run") == 1) & F.col("has_pred")).cast("int"))
    per = j.groupBy("language", "opt", "decompiler").agg(
        F.round(F.sum("ok") * 100.0 / F.count(F.lit(1)), 6).alias("exe_rate"),
        F.count(F.lit(1)).cast("double").alias("n"))
    long = per.unpivot(["language", "opt", "decompiler"], ["exe_rate", "n"], "metric", "value")
    return metrics.metric_table(long, ["exe_rate", "n"])


METRIC_TABLE_SQL = f"""WITH {q.SAMPLES}, {q.VERDICTS}, {ALL_PREDICTIONS},
per AS (SELECT language, opt, decompiler, round(sum(ok) * 100.0 / count(*), 6) AS exe_rate,
               CAST(count(*) AS DOUBLE) AS n FROM judged GROUP BY language, opt, decompiler)
SELECT language, opt, decompiler, exe_rate, n FROM per"""


def request_batches(spark: SparkSession, d: str) -> DataFrame:
    """J9 + W4: every sample requested twice, requests in (sample, request)
    order cut into consecutive batches of 50; size of each batch."""
    from ..operators.ordering import with_row_index
    reqs = joins.repeat_rows(st.samples(spark, d).select("sample_id"), 2)
    idx = with_row_index(reqs, ["sample_id", "request_no"], "pos")
    return idx.groupBy((F.col("pos") / 50).cast("long").alias("batch")).agg(
        F.count(F.lit(1)).alias("n"), F.min("sample_id").alias("first_sample"))


REQUEST_BATCHES_SQL = f"""WITH {q.SAMPLES},
reqs AS (SELECT sample_id, unnest(range(1, 3)) AS request_no FROM samples),
pos AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id, request_no) - 1 AS pos FROM reqs)
SELECT CAST(floor(pos / 50) AS BIGINT) AS batch, count(*) AS n, min(sample_id) AS first_sample
FROM pos GROUP BY 1"""


def gathered_requests(spark: SparkSession, d: str) -> DataFrame:
    """J9 and back: three requests per sample, their outputs (request number
    and prediction) gathered per sample in request order."""
    p = st.predictions(spark, d).select("sample_id", "prediction")
    reqs = joins.repeat_rows(st.samples(spark, d).select("sample_id"), 3).join(p, "sample_id")
    out = reqs.withColumn("output", F.concat_ws(":", "request_no", F.md5("prediction")))
    return joins.gather_requests(out, "sample_id", "output").select(
        "sample_id", F.array_join("outputs", ",").alias("outputs"))


GATHERED_REQUESTS_SQL = f"""WITH {q.SAMPLES}, {q.PREDICTIONS},
r AS (SELECT sample_id, md5(prediction) AS h FROM samples JOIN predictions USING (sample_id))
SELECT sample_id, '1:' || h || ',2:' || h || ',3:' || h AS outputs FROM r"""


def filtered_rate(spark: SparkSession, d: str) -> DataFrame:
    """Execute rate of one language and level; the language test is
    pushed into the Parquet scan (``PushedFilters: [EqualTo(lang,en)]``)."""
    s = select.equal_filter(st.samples(spark, d), language="en", opt="O1").select("sample_id", "opt", "language")
    return metrics.execute_rate(s.join(st.verdicts(spark, d), "sample_id"), ["opt", "language"])


FILTERED_RATE_SQL = f"""WITH {q.SAMPLES}, {q.VERDICTS}
SELECT opt, language, count(*) AS total, CAST(sum(flag_run) AS BIGINT) AS n_run,
       round(sum(flag_run) * 100.0 / count(*), 6) AS exe_rate
FROM samples JOIN verdicts USING (sample_id) WHERE language = 'en' AND opt = 'O1' GROUP BY opt, language"""


def peek_and_cap(spark: SparkSession, d: str) -> DataFrame:
    """P9 + P10: five seeded pseudo-random samples and the first five by id
    (a sampling operator and a row cap: the limit is the feature)."""
    s = st.samples(spark, d).select("sample_id", "dataset")
    key = F.md5(F.concat_ws(":", F.col("sample_id").cast("string"), F.lit("7")))
    peek = ordering.random_peek(s, "sample_id", 5, order_key=key).withColumn("pick", F.lit("random"))
    cap = ordering.capped(s, ["sample_id"], 5).withColumn("pick", F.lit("first"))
    return peek.unionByName(cap)


PEEK_AND_CAP_SQL = f"""WITH {q.SAMPLES}
(SELECT sample_id, dataset, 'random' AS pick FROM samples
 ORDER BY md5(CAST(sample_id AS VARCHAR) || ':7'), sample_id LIMIT 5)
UNION ALL
(SELECT sample_id, dataset, 'first' AS pick FROM samples ORDER BY sample_id LIMIT 5)"""


def strided_levels(spark: SparkSession, d: str) -> DataFrame:
    """File number j*4+i is level i of task j; files per level and tasks."""
    s = ordering.strided(st.samples(spark, d).select("sample_id"), "sample_id", 4)
    return s.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.max("task").alias("max_task"))


STRIDED_LEVELS_SQL = """SELECT CAST(doc_id % 4 AS BIGINT) AS level, count(*) AS n, max(doc_id // 4) AS max_task
FROM documents GROUP BY 1"""


def zipped_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Each sample paired with its first-run output by explicit id (a
    positional zip is an inner join on the position); output length."""
    s = st.samples(spark, d).select("sample_id", "opt")
    p = st.predictions(spark, d).select("sample_id", F.col("prediction").alias("output"))
    z = joins.zip_by_id(s, p, "sample_id")
    return z.groupBy("opt").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("output")).alias("output_chars"))


ZIPPED_OUTPUTS_SQL = f"""WITH {q.SAMPLES}, {q.PREDICTIONS}
SELECT opt, count(*) AS n, CAST(sum(length(prediction)) AS BIGINT) AS output_chars
FROM samples JOIN predictions USING (sample_id) GROUP BY opt"""


QUERIES = {
    "eval_by_opt": eval_by_opt,
    "a1_edit_sim_by_dataset": edit_sim_by_dataset,
    "a2_exec_rate_by_opt": exec_rate_by_opt,
    "a3_repeat_rates": repeat_rates_by_opt,
    "a4_fixed_denominator_rate": fixed_rate_by_opt,
    "a5_totals_rollup": totals_rollup,
    "a6_metric_table": metric_table_by_group,
    "a8_count_by_opt": count_by_opt,
    "a13_two_source_rates": two_source_rates,
    "a13_aligned_outputs": aligned_outputs,
    "a2_rate_by_test": rate_by_test,
    "j9_gathered_requests": gathered_requests,
    "j1_strict_verdict_join": strict_verdict_join,
    "j9_request_batches": request_batches,
    "p1_filtered_rate": filtered_rate,
    "p9_p10_peek_and_cap": peek_and_cap,
    "p11_strided_levels": strided_levels,
    "j3_zipped_outputs": zipped_outputs,
}

ORACLE = {
    "eval_by_opt": EVAL_BY_OPT_SQL,
    "a1_edit_sim_by_dataset": EDIT_SIM_BY_DATASET_SQL,
    "a2_exec_rate_by_opt": EXEC_RATE_BY_OPT_SQL,
    "a3_repeat_rates": REPEAT_RATES_SQL,
    "a4_fixed_denominator_rate": FIXED_RATE_SQL,
    "a5_totals_rollup": TOTALS_ROLLUP_SQL,
    "a6_metric_table": METRIC_TABLE_SQL,
    "a8_count_by_opt": COUNT_BY_OPT_SQL,
    "a13_two_source_rates": TWO_SOURCE_RATES_SQL,
    "a13_aligned_outputs": ALIGNED_OUTPUTS_SQL,
    "a2_rate_by_test": RATE_BY_TEST_SQL,
    "j9_gathered_requests": GATHERED_REQUESTS_SQL,
    "j1_strict_verdict_join": STRICT_VERDICT_JOIN_SQL,
    "j9_request_batches": REQUEST_BATCHES_SQL,
    "p1_filtered_rate": FILTERED_RATE_SQL,
    "p9_p10_peek_and_cap": PEEK_AND_CAP_SQL,
    "p11_strided_levels": STRIDED_LEVELS_SQL,
    "j3_zipped_outputs": ZIPPED_OUTPUTS_SQL,
}
