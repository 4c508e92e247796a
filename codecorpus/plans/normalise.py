"""Normalisation and filtering queries (pipeline B) and distinct-keyed
enrichment (J6-J8, A9-A11).

Stand-in input: one C-like function per ``part`` row, built from its key,
name and size (``8 * p_size`` body lines, so the line-count filter P4 is hit
on both bounds). Every Spark plan here is one narrow stage over the scan;
only the per-distinct enrichment shuffles (on the key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import joins, metrics
from ..operators.memo import Memo
from ..operators.partitioning import spread
from ..operators.select import select_where
from ..session import scratch_folder
from ..sources import sinks
from ..sources.tables import table
from . import sqlparts as q

# ------------------------------------------------------------------ stand-in

_RET = ["_DWORD", "__int64 *", "size_t **", "char"]
#: A literal wider than any machine integer, and its value.
WIDE_HEX = "0x" + "9a" * 20
_ARG = ["_BYTE", "wchar_t", "_QWORD", "DIR"]


def _body_line(i: Column, k: Column) -> Column:
    si = i.cast("string")
    r = i % 8
    return (F.when(r == 0, F.concat(F.lit("  v"), si, F.lit(" = 0x"), F.hex(k * i), F.lit("u; // set "), si))
            .when(r == 1, F.concat(F.lit('  s = "path // '), si, F.lit(' /* x */";')))
            .when(r == 2, F.concat(F.lit("  /* block "), si, F.lit(" */")))
            .when(r == 3, F.concat(F.lit("  __int32 t"), si, F.lit(" = (__int64)a + 0x"), F.lower(F.hex(i)),
                                   F.lit(";")))
            .when(r == 4, F.lit("  c = '\\''; /* multi"))
            .when(r == 5, F.concat(F.lit("     line "), si, F.lit(f" */ y = 0xFFFFFFFFFFFFFFFFull; z = {WIDE_HEX}u;")))
            .when(r == 6, F.concat(F.lit("  __fastcall helper"), si, F.lit("(size_t n); __cdecl")))
            .otherwise(F.concat(F.lit("  if (x > "), si, F.lit(") { return __noreturn noreturn; }"))))


def c_functions(spark: SparkSession, d: str) -> DataFrame:
    """(func_id, func_name, code): one function per part row."""
    k = F.col("p_partkey")
    ret = F.element_at(F.array(*[F.lit(x) for x in _RET]), (k % 4 + 1).cast("int"))
    arg = F.element_at(F.array(*[F.lit(x) for x in _ARG]), (F.col("p_size") % 4 + 1).cast("int"))
    body = F.array_join(F.transform(F.sequence(F.lit(1), F.col("p_size") * 8), lambda i: _body_line(i, k)), "\n")
    code = F.concat(F.lit("/* part: "), F.col("p_name"), F.lit(" */\n"), ret, F.lit(" func"), k.cast("string"),
                    F.lit("("), arg, F.lit(" a, char *s)\n{\n"), body, F.lit("\n}\n"))
    part = spread(table(spark, d, "part").select("p_partkey", "p_name", "p_size"), "p_partkey")
    return part.select(
        k.alias("func_id"), F.concat(F.lit("part_"), k.cast("string")).alias("func_name"), code.alias("code"))


C_FUNCTIONS = """c_functions AS (
  SELECT p_partkey AS func_id, 'part_' || CAST(p_partkey AS VARCHAR) AS func_name,
    '/* part: ' || p_name || ' */' || chr(10)
    || list_extract(['_DWORD', '__int64 *', 'size_t **', 'char'], CAST(p_partkey % 4 + 1 AS INTEGER))
    || ' func' || CAST(p_partkey AS VARCHAR) || '('
    || list_extract(['_BYTE', 'wchar_t', '_QWORD', 'DIR'], CAST(p_size % 4 + 1 AS INTEGER))
    || ' a, char *s)' || chr(10) || '{' || chr(10)
    || array_to_string(list_transform(range(1, p_size * 8 + 1), lambda i: CASE i % 8
         WHEN 0 THEN '  v' || i || ' = 0x' || hex(p_partkey * i) || 'u; // set ' || i
         WHEN 1 THEN '  s = "path // ' || i || ' /* x */";'
         WHEN 2 THEN '  /* block ' || i || ' */'
         WHEN 3 THEN '  __int32 t' || i || ' = (__int64)a + 0x' || lower(hex(i)) || ';'
         WHEN 4 THEN $$  c = '\\''; /* multi$$
         WHEN 5 THEN '     line ' || i || ' */ y = 0xFFFFFFFFFFFFFFFFull; z = """ + WIDE_HEX + """u;'
         WHEN 6 THEN '  __fastcall helper' || i || '(size_t n); __cdecl'
         ELSE '  if (x > ' || i || ') { return __noreturn noreturn; }' END), chr(10))
    || chr(10) || '}' || chr(10) AS code
  FROM part)"""

# ------------------------------------------------------------------ SQL twins of the text rules

# The same patterns as ``functions/text`` in RE2 syntax.
_COMMENT_OR_LITERAL_RE2 = "(?sm)//.*?$|/\\*.*?\\*/|'(?:\\\\.|[^\\\\'])*'|\"(?:\\\\.|[^\\\\\"])*\""
_HEX_RE2 = "\\b(0x[0-9a-fA-F]+)([uUlL]{1,3})?\\b"


def _sub_with_sql(x: str, pattern: str, fn) -> str:
    """Callback substitution in DuckDB: pieces and matches zipped pairwise."""
    pieces = f"string_split_regex({x}, '{pattern}')"
    toks = f"regexp_extract_all({x}, '{pattern}', 0)"
    return (f"array_to_string(list_transform(list_zip({pieces}, {toks}), "
            f"lambda z: z[1] || coalesce({fn('z[2]')}, '')), '')")


def remove_comments_sql(x: str) -> str:
    return _sub_with_sql(x, _COMMENT_OR_LITERAL_RE2.replace("'", "''"),
                         lambda t: f"CASE WHEN {t} IS NULL THEN NULL WHEN starts_with({t}, '/') THEN ' ' ELSE {t} END")


def remove_comments_naive_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '(?s)/\\*.*?\\*/', '', 'g'), '(?m)//.*?$', '', 'g')"


def hex_to_dec_sql(x: str) -> str:
    return _sub_with_sql(x, _HEX_RE2, lambda t: (
        f"CASE WHEN starts_with({t}, '{WIDE_HEX}') THEN '{int(WIDE_HEX, 16)}' ELSE "
        f"CAST(TRY_CAST('0x' || regexp_extract({t}, '^0x([0-9a-fA-F]+)', 1) AS UBIGINT) AS VARCHAR) END"
        f" || regexp_extract({t}, '([uUlL]*)$', 1)"))


# The keywords as in ``functions/text``.
def remove_keywords_sql(x: str) -> str:
    return (f"regexp_replace({x}, '\\b__fastcall\\b|\\b__cdecl\\b|\\b__ptr32\\b|\\b__noreturn\\s+noreturn\\b',"
            f" '', 'g')")


def replace_aliases_sql(x: str) -> str:
    """The original ordered loop: one whole-word replace per alias."""
    out = x
    for alias, base in T.TYPE_ALIASES:
        out = f"regexp_replace({out}, '\\b{alias}\\b', '{base}', 'g')"
    return out


def good_func_sql(x: str) -> str:
    body = f"CASE WHEN position('{{' IN {x}) > 0 THEN substr({x}, position('{{' IN {x}) + 1) ELSE '' END"
    n = f"len(list_filter(string_split({body}, chr(10)), lambda l: length({q.strip('l')}) >= 3))"
    return f"({n} > 3 AND {n} < 300)"


def normalise_sql(x: str) -> str:
    r = replace_aliases_sql(remove_keywords_sql(hex_to_dec_sql(remove_comments_naive_sql(x))))
    return f"CASE WHEN NOT regexp_matches({r}, '[^\\t\\n\\x0b\\x0c\\r\\x1c-\\x1f ]') THEN '' ELSE {q.strip_empty(r)} END"


# ------------------------------------------------------------------ queries

def comment_removal(spark: SparkSession, d: str) -> DataFrame:
    """String-aware comment removal (comments -> one space)."""
    return c_functions(spark, d).select("func_id", T.remove_comments("code").alias("code_nc"))


COMMENT_REMOVAL_SQL = f"""WITH {C_FUNCTIONS}
SELECT func_id, {remove_comments_sql('code')} AS code_nc FROM c_functions"""


def naive_comment_removal(spark: SparkSession, d: str) -> DataFrame:
    """Naive comment removal (also inside string literals)."""
    return c_functions(spark, d).select("func_id", T.remove_comments_naive("code").alias("code_nc"))


NAIVE_COMMENT_REMOVAL_SQL = f"""WITH {C_FUNCTIONS}
SELECT func_id, {remove_comments_naive_sql('code')} AS code_nc FROM c_functions"""


def hex_literals(spark: SparkSession, d: str) -> DataFrame:
    """T4: hex literals to decimal, suffix kept."""
    return c_functions(spark, d).select("func_id", T.hex_to_dec("code").alias("code_dec"))


HEX_LITERALS_SQL = f"""WITH {C_FUNCTIONS}
SELECT func_id, {hex_to_dec_sql('code')} AS code_dec FROM c_functions"""


def keywords_and_aliases(spark: SparkSession, d: str) -> DataFrame:
    """T5 + T6: calling-convention keywords removed, type aliases rewritten."""
    return c_functions(spark, d).select(
        "func_id", T.remove_keywords_and_aliases("code").alias("code_types"))


KEYWORDS_AND_ALIASES_SQL = f"""WITH {C_FUNCTIONS}
SELECT func_id, {replace_aliases_sql(remove_keywords_sql('code'))} AS code_types FROM c_functions"""


def normalise_accept(spark: SparkSession, d: str) -> DataFrame:
    """T7 + P6 (remove=1): normalised text of the rows that pass P4."""
    return select_where(c_functions(spark, d), ["func_id"], {"code_norm": T.normalise_pseudo("code")},
                        lambda r: T.accept_status(r["code_norm"]) == "accepted")


NORMALISE_ACCEPT_SQL = f"""WITH {C_FUNCTIONS},
n AS (SELECT func_id, {normalise_sql('code')} AS code_norm FROM c_functions)
SELECT func_id, code_norm FROM n WHERE code_norm <> '' AND {good_func_sql('code_norm')}"""


def format_records(spark: SparkSession, d: str) -> DataFrame:
    """format stage: T1 -> layout -> T3, keep rows passing P4 (P5)."""
    return select_where(c_functions(spark, d), ["func_id"],
                        {"code_format": T.strip_empty(T.remove_comments("code"))},
                        lambda r: T.good_func(r["code_format"]))


FORMAT_RECORDS_SQL = f"""WITH {C_FUNCTIONS},
f AS (SELECT func_id, {q.strip_empty(remove_comments_sql('code'))} AS code_format FROM c_functions)
SELECT func_id, code_format FROM f WHERE {good_func_sql('code_format')}"""


def _layout(code: Column) -> Column:
    """Stand-in for the external formatter: double spaces closed up, NULL (a
    failure) for every seventh text length."""
    return F.when(F.length(code) % 7 != 0, F.replace(code, F.lit("  "), F.lit(" ")))


_PROCESSED_SQL = replace_aliases_sql(remove_keywords_sql(hex_to_dec_sql(remove_comments_naive_sql("code"))))
FORMATTED = f"""{C_FUNCTIONS},
processed AS (SELECT func_id, code, {_PROCESSED_SQL} AS plain FROM c_functions),
laid AS (SELECT *, CASE WHEN length(plain) % 7 <> 0 THEN replace(plain, '  ', ' ') END AS laid_out FROM processed),
normed AS (SELECT func_id, code, CASE WHEN NOT regexp_matches(plain, '[^\t\n\x0b\x0c\r\x1c-\x1f ]') THEN ''
    WHEN laid_out IS NOT NULL THEN {q.strip_empty('laid_out')} END AS code_norm FROM laid)"""


def accept_counts(spark: SparkSession, d: str) -> DataFrame:
    """P6 + A11: rows per accept status after normalisation with a formatter
    that fails for some rows, and the totals, which are sums of the four."""
    norm = c_functions(spark, d).select(T.accept_status(T.normalise_pseudo("code", _layout)).alias("status"))
    return metrics.accepted_rollup(norm)


ACCEPT_COUNTS_SQL = f"""WITH {FORMATTED},
s AS (SELECT CASE WHEN code_norm IS NULL THEN 'format_failed' WHEN code_norm = '' THEN 'empty'
             WHEN {good_func_sql('code_norm')} THEN 'accepted' ELSE 'rejected' END AS status FROM normed)
SELECT status, count(*) AS n FROM s GROUP BY 1
UNION ALL SELECT 'all rows', count(*) FROM s
UNION ALL SELECT 'kept rows', count(*) FILTER (WHERE status = 'accepted') FROM s"""


def kept_records(spark: SparkSession, d: str) -> DataFrame:
    """P6 with ``remove=0``: accepted rows with the normalised text, rows
    whose formatting failed with the raw one."""
    norm = T.normalise_pseudo("code", _layout)
    rows = select_where(c_functions(spark, d), ["func_id", "code"], {"norm": norm}, lambda r: F.when(
        r["norm"].isNull(), True).otherwise(T.accept_status(r["norm"]) == "accepted"))
    return rows.select("func_id", T.keep_failed(F.col("norm"), F.col("code")).alias("code_norm"))


KEPT_RECORDS_SQL = f"""WITH {FORMATTED}
SELECT func_id, coalesce(code_norm, code) AS code_norm FROM normed
WHERE code_norm IS NULL OR (code_norm <> '' AND {good_func_sql('code_norm')})"""


def observed_log(spark: SparkSession, d: str) -> DataFrame:
    """A11 + K7: the normalised functions written as a log; the totals, the
    accepted rows and the rows of each level come from that one write."""
    path = scratch_folder(spark, "observed")
    rows = c_functions(spark, d).select("func_id", F.concat(F.lit("O"), (F.col("func_id") % 3).cast("string")).alias("opt"),
                                        T.normalise_pseudo("code", _layout).alias("code_norm"))
    log = rows.withColumn("status", T.accept_status("code_norm"))
    sinks.write_run_log(log, path, ["func_id", "opt", "status", "code_norm"], "opt", ["O0", "O1", "O2", "O3"],
                        {"accepted": F.col("status") == "accepted"})
    line = F.split("value", ": ")
    return spark.read.text(f"{path}/_stats").select(line[0].alias("name"), line[1].cast("long").alias("n"))


OBSERVED_LOG_SQL = f"""WITH {FORMATTED}
SELECT 'total' AS name, count(*) AS n FROM normed
UNION ALL SELECT 'accepted', count(*) FILTER (WHERE code_norm <> '' AND {good_func_sql('code_norm')}) FROM normed
UNION ALL SELECT 'level O' || i, (SELECT count(*) FROM normed WHERE func_id % 3 = i) FROM range(0, 4) t(i)"""


def name_alignment(spark: SparkSession, d: str) -> DataFrame:
    """T19 + T20 + T21: extracted name (stars dropped), raw token, and the
    code with that name replaced by the reference name."""
    c = c_functions(spark, d)
    code = T.strip_fastcall("code")
    name = T.function_name(code)
    return c.select("func_id", T.raw_name_token(code).alias("raw_token"), name.alias("name"),
                    T.align_name(code, name, F.col("func_name")).alias("aligned"))


def function_name_sql(x: str) -> str:
    tok = f"{q.strip(f'split_part(split_part({x}, \'(\', 1), \' \', -1)')}"
    return (f"CASE WHEN starts_with({tok}, '**') THEN substr({tok}, 3) "
            f"WHEN starts_with({tok}, '*') THEN substr({tok}, 2) ELSE {tok} END")


NAME_ALIGNMENT_SQL = f"""WITH {C_FUNCTIONS},
c AS (SELECT func_id, func_name, replace(code, '__fastcall', '') AS code FROM c_functions),
n AS (SELECT func_id, func_name, code, split_part(split_part(code, '(', 1), ' ', -1) AS raw_token,
             {function_name_sql('code')} AS name FROM c)
SELECT func_id, raw_token, name,
       CASE WHEN name = '' THEN code ELSE replace(code, name, func_name) END AS aligned FROM n"""

# ------------------------------------------------------------------ distinct-keyed enrichment


def header_of(code: Column) -> Column:
    """Stand-in for the external per-code header generator: NULL (failure)
    for single-line texts, else a declaration named after the text's MD5."""
    return F.when(F.instr(code, "\n") == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("struct s_"), F.substring(F.md5(code), 1, 12), F.lit(";")))


HEADER_SQL = ("CASE WHEN position(chr(10) IN {x}) = 0 THEN NULL "
              "ELSE 'struct s_' || substr(md5({x}), 1, 12) || ';' END")


def header_per_distinct(spark: SparkSession, d: str) -> DataFrame:
    """J7 + U2: header computed once per distinct text, fanned back to rows."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return joins.per_distinct(docs, "text", header_of, "header").select("doc_id", "header")


HEADER_PER_DISTINCT_SQL = f"""WITH k AS (SELECT DISTINCT text FROM documents),
h AS (SELECT text, {HEADER_SQL.format(x='text')} AS header FROM k)
SELECT doc_id, header FROM documents LEFT JOIN h USING (text)"""


def header_failures(spark: SparkSession, d: str) -> DataFrame:
    """A9 + A10: failures once per distinct text vs row count; good / bad."""
    docs = table(spark, d, "documents").select("text")
    return metrics.distinct_failures(joins.distinct_values(docs, "text", header_of, "header"), "header")


HEADER_FAILURES_SQL = f"""WITH h AS (SELECT text, {HEADER_SQL.format(x='text')} AS header FROM documents)
SELECT count(*) AS n_rows, count(DISTINCT text) AS n_distinct,
       count(DISTINCT CASE WHEN header IS NULL THEN text END) AS n_failed_distinct,
       count(*) FILTER (WHERE header IS NOT NULL AND header <> '') AS good,
       count(*) FILTER (WHERE header IS NULL OR header = '') AS bad
FROM h"""


def enrich_or_drop(spark: SparkSession, d: str) -> DataFrame:
    """Samples get ``func_dep`` = header; samples without one are dropped."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    texts = table(spark, d, "documents").select("doc_id", "text")
    h = joins.per_distinct(texts, "text", header_of, "header").select("doc_id", "header")
    return joins.enrich_or_drop(docs, h, "doc_id", "header", "func_dep")


ENRICH_OR_DROP_SQL = f"""WITH h AS (SELECT doc_id, lang, {HEADER_SQL.format(x='text')} AS header FROM documents)
SELECT doc_id, lang, header AS func_dep FROM h WHERE header IS NOT NULL AND header <> ''"""


def cached_headers(spark: SparkSession, d: str) -> DataFrame:
    """J6 + T30: stored header when present (labelled documents), else the
    computed one; prepended to the text when non-empty. Output: length of
    the prepended text and the header used."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    cached = table(spark, d, "labels").select(
        "doc_id", F.concat(F.lit("/* cached */ struct c_"), F.col("doc_id").cast("string"), F.lit(";"))
        .alias("header"))
    j = joins.with_fallback(docs, cached, ["doc_id"], "header", header_of(F.col("text")))
    return j.select("doc_id", "header", F.length(T.prepend_header(F.col("header"), F.col("text"))).alias("n_chars"))


CACHED_HEADERS_SQL = f"""WITH c AS (SELECT doc_id, '/* cached */ struct c_' || CAST(doc_id AS VARCHAR) || ';' AS header FROM labels),
k AS (SELECT doc_id, text, {HEADER_SQL.format(x='text')} AS header FROM documents)
SELECT k.doc_id, coalesce(c.header, k.header) AS header,
       CAST(length(coalesce(coalesce(c.header, k.header), '') || k.text) AS INTEGER) AS n_chars
FROM k LEFT JOIN c USING (doc_id)"""


def memo_runs(spark: SparkSession, d: str) -> DataFrame:
    """J6 + J7 between runs: a first run memoises the headers of the labelled
    documents, a second one of all; every document's header, and the run that
    computed it (the second computes only texts that are new)."""
    memo = Memo(spark, scratch_folder(spark, "memo"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    labelled = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    runs = [memo.extend(rows, "text", header_of).select("key", F.lit(n).alias("run")) for n, rows in ((1, labelled), (2, docs))]
    known = joins.union_all(runs).join(memo.table().select("key"), "key")
    keyed = memo.results(docs, "text", "header").withColumn("key", joins.text_key(F.col("text")))
    counted = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(known, "key")
    return joins.hot_cold_join(keyed, counted, "key", "n").select("doc_id", "header", "run")


MEMO_RUNS_SQL = f"""WITH h AS (SELECT doc_id, text, {HEADER_SQL.format(x='text')} AS header FROM documents),
first AS (SELECT DISTINCT text FROM h JOIN labels USING (doc_id))
SELECT doc_id, header, CASE WHEN first.text IS NULL THEN 2 ELSE 1 END AS run FROM h LEFT JOIN first USING (text)"""


QUERIES = {
    "t1_comment_removal": comment_removal,
    "t2_naive_comment_removal": naive_comment_removal,
    "t4_hex_literals": hex_literals,
    "t5_t6_keywords_aliases": keywords_and_aliases,
    "t7_normalise_accept": normalise_accept,
    "t3_p4_format_records": format_records,
    "p6_accept_counts": accept_counts,
    "p6_kept_records": kept_records,
    "a11_k7_observed_log": observed_log,
    "t19_t20_name_alignment": name_alignment,
    "j7_header_per_distinct": header_per_distinct,
    "a9_a10_header_failures": header_failures,
    "j8_enrich_or_drop": enrich_or_drop,
    "j6_cached_headers": cached_headers,
    "j6_j7_memo_runs": memo_runs,
}

ORACLE = {
    "t1_comment_removal": COMMENT_REMOVAL_SQL,
    "t2_naive_comment_removal": NAIVE_COMMENT_REMOVAL_SQL,
    "t4_hex_literals": HEX_LITERALS_SQL,
    "t5_t6_keywords_aliases": KEYWORDS_AND_ALIASES_SQL,
    "t7_normalise_accept": NORMALISE_ACCEPT_SQL,
    "t3_p4_format_records": FORMAT_RECORDS_SQL,
    "p6_accept_counts": ACCEPT_COUNTS_SQL,
    "p6_kept_records": KEPT_RECORDS_SQL,
    "a11_k7_observed_log": OBSERVED_LOG_SQL,
    "t19_t20_name_alignment": NAME_ALIGNMENT_SQL,
    "j7_header_per_distinct": HEADER_PER_DISTINCT_SQL,
    "a9_a10_header_failures": HEADER_FAILURES_SQL,
    "j8_enrich_or_drop": ENRICH_OR_DROP_SQL,
    "j6_cached_headers": CACHED_HEADERS_SQL,
    "j6_j7_memo_runs": MEMO_RUNS_SQL,
}
