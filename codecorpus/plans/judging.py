"""Judge answers, chat transcripts, prompts and result records
(T22-T31, A7).

Stand-ins: judge answers come from ``events`` (score from ``props``, the
decompiler from ``event_type``; every tenth-digit class of ``event_id``
gets one answer shape: fenced, truncated, bad escape, garbage, missing
key, or plain); chat turns are ``conversations`` as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import joins, metrics
from ..sources.tables import table
from . import sqlparts as q
from . import standins as st
from .normalise import function_name_sql

# ------------------------------------------------------------------ judge answers


def judge_answers(spark: SparkSession, d: str) -> DataFrame:
    """(sample_id, decompiler, opt, answer): raw judge answer text."""
    ev = table(spark, d, "events")
    score = (F.get_json_object("props", "$.k").cast("int") % 5 + 1).cast("string")
    body = F.concat(F.lit('{"' + T.JUDGE_KEY + '": {"score": '), score, F.lit(', "rationale": "'),
                    F.col("event_type"), F.lit('"}}'))
    r = F.col("event_id") % 10
    answer = (F.when(r == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
              .when(r == 1, F.expr("substring(body, 1, length(body) - 1)"))
              .when(r == 2, F.concat(F.lit('{"' + T.JUDGE_KEY + '": {"score": '), score,
                                     F.lit(', "rationale": "uses \\q names"}}')))
              .when(r == 3, F.lit("I cannot rate this function."))
              .when(r == 4, F.concat(F.lit('{"Other": {"score": '), score, F.lit("}}")))
              .when(r == 5, F.concat(body, F.lit(" thanks")))
              .when(r == 6, F.concat(body, F.lit("}")))
              .when(r == 7, F.concat(F.lit('{"' + T.JUDGE_KEY + '": {"score": 1}, '), F.substr(body, F.lit(2))))
              .otherwise(body))
    return ev.withColumn("body", body).select(
        F.col("event_id").alias("sample_id"), F.col("event_type").alias("decompiler"),
        F.concat(F.lit("O"), (F.col("user_id") % 4).cast("string")).alias("opt"), answer.alias("answer"))


JUDGE_ANSWERS = f"""ans AS (
  SELECT event_id AS sample_id, event_type AS decompiler, 'O' || CAST(user_id % 4 AS VARCHAR) AS opt,
         CAST(CAST(json_extract(props, '$.k') AS INTEGER) % 5 + 1 AS VARCHAR) AS score,
         event_id % 10 AS r FROM events),
b AS (SELECT *, '{{"{T.JUDGE_KEY}": {{"score": ' || score || ', "rationale": "' || decompiler || '"}}}}' AS body FROM ans),
judge_answers AS (
  SELECT sample_id, decompiler, opt, CASE r
    WHEN 0 THEN '```json' || chr(10) || body || chr(10) || '```'
    WHEN 1 THEN substr(body, 1, length(body) - 1)
    WHEN 2 THEN '{{"{T.JUDGE_KEY}": {{"score": ' || score || ', "rationale": "uses \\q names"}}}}'
    WHEN 3 THEN 'I cannot rate this function.'
    WHEN 4 THEN '{{"Other": {{"score": ' || score || '}}}}'
    WHEN 5 THEN body || ' thanks'
    WHEN 6 THEN body || '}}'
    WHEN 7 THEN '{{"{T.JUDGE_KEY}": {{"score": 1}}, ' || substr(body, 2)
    ELSE body END AS answer
  FROM b)"""

_STRIPPED_SQL = q.strip("replace(replace(" + q.strip("answer") + ", '```json', ''), '```', '')")
_REPAIRED_SQL = f"""CASE WHEN json_valid(t) THEN t WHEN json_valid(t || '}}') THEN t || '}}'
  WHEN json_valid(replace(t, '\\', '')) THEN replace(t, '\\', '') END"""


def judge_scores(spark: SparkSession, d: str) -> DataFrame:
    """T25 + T26 + A7: repaired answers, per-criterion score (1 when
    missing or unreadable), mean per decompiler, opt and criterion."""
    a = judge_answers(spark, d)
    s = a.select("decompiler", "opt", F.lit(T.JUDGE_KEY).alias("criterion"),
                 F.inline(F.array(T.judge_verdict(F.col("answer")))))
    return metrics.mean_judge_score(s)


JUDGE_SCORES_SQL = f"""WITH {JUDGE_ANSWERS},
s AS (SELECT decompiler, opt, {_STRIPPED_SQL} AS t FROM judge_answers),
j AS (SELECT decompiler, opt, {_REPAIRED_SQL} AS js FROM s),
v AS (SELECT decompiler, opt, CASE WHEN contains(js, '"{T.JUDGE_KEY}"')
        THEN TRY_CAST(regexp_extract_all(js, '"score": ([0-9]+)', 1)[-1] AS INTEGER) END AS sc FROM j)
SELECT decompiler, opt, '{T.JUDGE_KEY}' AS criterion, count(*) AS n, round(avg(coalesce(sc, 1)), 6) AS mean_score,
       CAST(count(*) FILTER (WHERE sc IS NULL) AS BIGINT) AS n_defaulted
FROM v GROUP BY decompiler, opt"""


# ------------------------------------------------------------------ chat transcripts

ROLE_NAMES = {"system": "", "user": "Human", "assistant": "Assistant"}


def chat_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Per conversation, the history before its last user turn, that
    turn (stripped) and an open assistant turn, in the chat template."""
    c = table(spark, d, "conversations")
    last = (c.where(F.col("role") == "user").groupBy("conv_id").agg(F.max("turn").alias("last_user")))
    j = c.join(last, "conv_id")
    role = (F.when(F.col("role") == "system", F.lit("")).when(F.col("role") == "user", F.lit("Human"))
            .otherwise(F.lit("Assistant")))
    query = T.py_strip(F.col("text"))
    piece = (F.when(F.col("turn") < F.col("last_user"), T.chat_piece(role, F.col("text")))
             .when(F.col("turn") == F.col("last_user"), T.chat_piece(F.lit("Human"), query)))
    per = j.select("conv_id", "turn", piece.alias("piece")).where(F.col("piece").isNotNull())
    return per.groupBy("conv_id").agg(
        F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "piece"))),
                                          lambda x: x["piece"]), ""), F.lit("Assistant: <s>")).alias("prompt"))


CHAT_PROMPTS_SQL = f"""WITH last AS (SELECT conv_id, max(turn) AS last_user FROM conversations WHERE role = 'user' GROUP BY 1),
j AS (SELECT c.*, last_user,
        CASE role WHEN 'system' THEN '' WHEN 'user' THEN 'Human' ELSE 'Assistant' END AS rname
      FROM conversations c JOIN last USING (conv_id)),
p AS (SELECT conv_id, turn, CASE
        WHEN turn < last_user THEN CASE WHEN rname = '' THEN '<s>' || text || chr(10) || chr(10)
                                        WHEN text IS NULL OR text = '' THEN rname || ': <s>'
                                        ELSE rname || ': <s>' || text || '</s>' END
        WHEN turn = last_user THEN CASE WHEN {q.strip('text')} = '' THEN 'Human: <s>'
                                        ELSE 'Human: <s>' || {q.strip('text')} || '</s>' END END AS piece
      FROM j)
SELECT conv_id, string_agg(piece, '' ORDER BY turn) || 'Assistant: <s>' AS prompt
FROM p WHERE piece IS NOT NULL GROUP BY conv_id"""


# ------------------------------------------------------------------ prompts, templates, counts

TEMPLATE = ("Readability evaluation\n1. Original function\n```\n[SRC]\n```\n"
            "2. Decompiled function\n```\n[DSRC]\n```\n")
STOPS = ["</s>", ", "]


def prompts(spark: SparkSession, d: str) -> DataFrame:
    """T22 + T23 + T24: model prompts (plain, per-level head, normalised-code
    head, unstripped), judge prompt from the template, and the prediction
    with stop strings removed."""
    s = st.samples(spark, d).select("sample_id", "opt", "func")
    p = st.predictions(spark, d).select("sample_id", "prediction")
    j = s.join(p, "sample_id", "left").withColumn("prediction", F.coalesce("prediction", F.lit("")))
    return j.select(
        "sample_id",
        T.render_prompt(F.col("func")).alias("prompt"),
        T.render_prompt(F.col("func"), strip=False, opt=F.col("opt")).alias("prompt_opt"),
        T.render_prompt(F.col("prediction"), head=T.NORM_HEAD).alias("prompt_norm"),
        T.fill_template(F.lit(TEMPLATE), F.col("func"), F.col("prediction")).alias("judge_prompt"),
        T.remove_stop_sequences(F.col("prediction"), STOPS).alias("generated"))


def judge_prompts(spark: SparkSession, d: str) -> DataFrame:
    """J2 + T19 + T20 + T23 as the judge reads them: the source's function
    renamed to ``func0``, the prediction stripped, ``decompile error`` where
    none exists."""
    s = st.samples(spark, d).select("sample_id", "func_name", F.concat(
        F.lit("char *"), F.col("func_name"), F.lit("(int a) { "), F.col("func"), F.lit(" }")).alias("func"))
    p = st.predictions(spark, d).select("sample_id", T.py_strip(F.col("prediction")).alias("prediction"))
    j = joins.tolerant_join(s, p, "sample_id", {"prediction": "decompile error"})
    source = T.align_name(F.col("func"), T.function_name("func"), F.lit("func0"))
    return j.select("sample_id", "_matched", T.fill_template(F.lit(TEMPLATE), source, F.col("prediction"))
                    .alias("judge_prompt")).select(
        "sample_id", F.col("_matched").alias("matched"), F.md5("judge_prompt").alias("prompt_md5"),
        F.length("judge_prompt").alias("n_chars"))


_TEMPLATE_SQL = "'" + TEMPLATE.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
JUDGE_PROMPTS_SQL = f"""WITH {q.SAMPLES}, {q.PREDICTIONS},
s AS (SELECT sample_id, 'char *' || func_name || '(int a) {{ ' || func || ' }}' AS func FROM samples),
n AS (SELECT *, {function_name_sql('func')} AS name FROM s),
r AS (SELECT sample_id, CASE WHEN name = '' THEN func ELSE replace(func, name, 'func0') END AS source FROM n),
j AS (SELECT r.sample_id, p.sample_id IS NOT NULL AS matched,
        replace(replace({_TEMPLATE_SQL}, '[SRC]', source), '[DSRC]', coalesce({q.strip('p.prediction')}, 'decompile error')) AS t
      FROM r LEFT JOIN predictions p ON p.sample_id = r.sample_id)
SELECT sample_id, matched, md5(t) AS prompt_md5, CAST(length(t) AS INTEGER) AS n_chars FROM j"""


def _prompt_sql(x: str, strip: bool = True, head: str = "'# This is the assembly code:' || chr(10)") -> str:
    body = q.strip(x) if strip else x
    return f"{head} || {body} || chr(10) || '# What is the source code?' || chr(10)"


PROMPTS_SQL = f"""WITH {q.SAMPLES}, {q.PREDICTIONS},
j AS (SELECT s.sample_id, s.opt, s.func, coalesce(p.prediction, '') AS prediction
      FROM samples s LEFT JOIN predictions p USING (sample_id))
SELECT sample_id, {_prompt_sql('func')} AS prompt,
  {_prompt_sql('func', False, "'# This is the assembly code with ' || opt || ' optimization:' || chr(10)")} AS prompt_opt,
  {_prompt_sql('prediction', True, "'# This is the normalized code:' || chr(10)")} AS prompt_norm,
  replace(replace({"'" + TEMPLATE.replace(chr(10), "' || chr(10) || '") + "'"}, '[SRC]', func), '[DSRC]', prediction)
    AS judge_prompt,
  replace(replace(prediction, '</s>', ''), ', ', '') AS generated
FROM j"""


def human_counts(spark: SparkSession, d: str) -> DataFrame:
    """Character totals per language and per source, human-readable."""
    docs = table(spark, d, "documents")
    per = docs.groupBy("lang").agg(F.sum("n_chars").alias("numel"))
    return per.select("lang", F.col("numel").cast("long").alias("numel"), T.human_count(F.col("numel")).alias("human"))


HUMAN_COUNTS_SQL = """WITH per AS (SELECT lang, CAST(sum(n_chars) AS BIGINT) AS numel FROM documents GROUP BY lang)
SELECT lang, numel, CASE
  WHEN numel >= 1073741824 THEN printf('%.2f', numel / 1073741824) || ' B'
  WHEN numel >= 1048576 THEN printf('%.2f', numel / 1048576) || ' M'
  WHEN numel >= 1024 THEN printf('%.2f', numel / 1024) || ' K'
  ELSE CAST(numel AS VARCHAR) END AS human
FROM per"""


def scorer_records(spark: SparkSession, d: str) -> DataFrame:
    """T29 + T30 + T31 + W6: per (opt, sample) a running file number over the
    samples (O0..O3, then sample id), the result file name, and the
    scorer's nested record as JSON (header prepended when present)."""
    from ..operators.ordering import running_number
    from .normalise import header_of
    s = st.samples(spark, d).select("sample_id", "func_name", "opt", "language", "func")
    p = st.predictions(spark, d).select("sample_id", "decompiler", "prediction")
    numbered = running_number(s.select("sample_id", "opt"), ["opt", "sample_id"], "file_no")
    j = (s.join(p, "sample_id", "left").join(numbered.select("sample_id", "file_no"), "sample_id")
         .withColumn("prediction", F.coalesce("prediction", F.lit("")))
         .withColumn("decompiler", F.coalesce("decompiler", F.lit("next4"))))
    code = T.prepend_header(header_of(F.col("prediction")), F.col("prediction"))
    rec = T.scorer_record(F.col("decompiler"), F.col("func_name"), code)
    return j.select("sample_id", "file_no",
                    T.result_file_name(F.col("sample_id"), F.col("opt"), F.col("language")).alias("file_name"),
                    F.to_json(rec).alias("record"))


SCORER_RECORDS_SQL = f"""WITH {q.SAMPLES}, {q.PREDICTIONS},
n AS (SELECT sample_id, row_number() OVER (ORDER BY opt, sample_id) - 1 AS file_no FROM samples),
j AS (SELECT s.*, coalesce(p.prediction, '') AS prediction, coalesce(p.decompiler, 'next4') AS decompiler, n.file_no
      FROM samples s LEFT JOIN predictions p USING (sample_id) JOIN n USING (sample_id))
SELECT sample_id, file_no, CAST(sample_id AS VARCHAR) || '_' || opt || '.' || language AS file_name,
  CAST(to_json(struct_pack(isStripped := true, decompilerName := decompiler, compilerName := 'gcc', optLevel := '-O',
    funcInfo := [struct_pack(funcName := func_name, decompiledFuncCode :=
      coalesce(CASE WHEN position(chr(10) IN prediction) = 0 THEN NULL
               ELSE 'struct s_' || substr(md5(prediction), 1, 12) || ';' END, '') || prediction)])) AS VARCHAR) AS record
FROM j"""


QUERIES = {
    "t20_judge_prompts": judge_prompts,
    "a7_judge_scores": judge_scores,
    "t27_chat_prompts": chat_prompts,
    "t22_t24_prompts": prompts,
    "t28_human_counts": human_counts,
    "t29_t31_scorer_records": scorer_records,
}

ORACLE = {
    "t20_judge_prompts": JUDGE_PROMPTS_SQL,
    "a7_judge_scores": JUDGE_SCORES_SQL,
    "t27_chat_prompts": CHAT_PROMPTS_SQL,
    "t22_t24_prompts": PROMPTS_SQL,
    "t28_human_counts": HUMAN_COUNTS_SQL,
    "t29_t31_scorer_records": SCORER_RECORDS_SQL,
}
