"""Corpus construction queries (pipeline A): listings and sources.

Stand-in listings: one disassembly per order, one instruction line per
lineitem row (objdump layout: address, bytes, instruction, ``#`` note;
continuation lines hold bytes only). The per-order text is built with one
``groupBy(l_orderkey)``; an order's lines are one output text, so the group
is the row being produced. Every later step is narrow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.select import select_where
from ..sources.tables import table
from . import sqlparts as q
from .normalise import C_FUNCTIONS, c_functions

LEVELS = [0, 1, 2, 3]


def _insn_lines(li: DataFrame) -> DataFrame:
    """One or two listing lines per lineitem row."""
    n = F.col("l_linenumber")
    addr = F.concat(F.lit("  "), F.lower(F.hex(n * 16)), F.lit(":"))
    insn = (F.when(F.col("l_returnflag") == "A", F.lit("mov    %rsp,%rbp"))
            .when(F.col("l_returnflag") == "R",
                  F.concat(F.lit("add    $0x"), F.lower(F.hex("l_suppkey")), F.lit(",%rax")))
            .otherwise(F.concat(F.lit("call   "), F.lower(F.hex("l_partkey")), F.lit(" <func"),
                                F.col("l_partkey").cast("string"), F.lit(">"))))
    note = F.when(F.col("l_linestatus") == "O",
                  F.concat(F.lit("\t# "), F.lower(F.hex("l_orderkey")))).otherwise(F.lit(""))
    byte = F.lpad(F.lower(F.hex(F.col("l_partkey") % 256)), 2, "0")
    main = F.concat(addr, F.lit("\t"), byte, F.lit(" 00 e5 "), F.lit("\t"), insn, note)
    cont = F.concat(F.lit("  "), F.lower(F.hex(n * 16 + 8)), F.lit(":\t00 00 00"))
    line = F.when(F.col("l_quantity") > 25, F.concat(main, F.lit("\n"), cont)).otherwise(main)
    return li.select("l_orderkey", "l_partkey", n.alias("n"), line.alias("line"))


def order_lines(spark: SparkSession, d: str) -> DataFrame:
    """(order, lines: array<struct<n, line>> sorted by line number, callee)."""
    li = _insn_lines(table(spark, d, "lineitem"))
    return li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("lines"),
                                        F.min("l_partkey").alias("callee"))


def _listing(order: Column, lines: Column) -> Column:
    body = F.array_join(F.transform(lines, lambda x: x["line"]), "\n")
    return F.concat(F.lit("\nx.o:     file format elf64-x86-64\n\n\nDisassembly of section .text:\n\n"
                          "0000000000000000 <helper>:\n   0:\t55\tpush   %rbp\n\n"
                          "0000000000000010 <func"), order.cast("string"), F.lit(">:\n"), body,
                    F.lit("\n\n0000000000000100 <tail>:\n 100:\tc3\tret    \n"))


def listings(spark: SparkSession, d: str) -> DataFrame:
    """(order, func_name, callee, listing)."""
    o = order_lines(spark, d)
    return o.select(F.col("l_orderkey").alias("order_id"), "callee",
                    F.concat(F.lit("func"), F.col("l_orderkey").cast("string")).alias("func_name"),
                    _listing(F.col("l_orderkey"), F.col("lines")).alias("listing"))


_LINE_SQL = """'  ' || lower(hex(l_linenumber * 16)) || ':' || chr(9) || lpad(lower(hex(l_partkey % 256)), 2, '0')
      || ' 00 e5 ' || chr(9)
      || CASE WHEN l_returnflag = 'A' THEN 'mov    %rsp,%rbp'
              WHEN l_returnflag = 'R' THEN 'add    $0x' || lower(hex(l_suppkey)) || ',%rax'
              ELSE 'call   ' || lower(hex(l_partkey)) || ' <func' || CAST(l_partkey AS VARCHAR) || '>' END
      || CASE WHEN l_linestatus = 'O' THEN chr(9) || '# ' || lower(hex(l_orderkey)) ELSE '' END
      || CASE WHEN l_quantity > 25 THEN chr(10) || '  ' || lower(hex(l_linenumber * 16 + 8)) || ':' || chr(9)
              || '00 00 00' ELSE '' END"""

_HEAD_SQL = ("chr(10) || 'x.o:     file format elf64-x86-64' || chr(10) || chr(10) || chr(10) "
             "|| 'Disassembly of section .text:' || chr(10) || chr(10) "
             "|| '0000000000000000 <helper>:' || chr(10) || '   0:' || chr(9) || '55' || chr(9) || 'push   %rbp' "
             "|| chr(10) || chr(10) || '0000000000000010 <func'")
_TAIL_SQL = ("chr(10) || chr(10) || '0000000000000100 <tail>:' || chr(10) || ' 100:' || chr(9) || 'c3' "
             "|| chr(9) || 'ret    ' || chr(10)")

LISTINGS = f"""li AS (SELECT l_orderkey, l_linenumber AS n, {_LINE_SQL} AS line FROM lineitem),
listings AS (
  SELECT l_orderkey AS order_id, 'func' || CAST(l_orderkey AS VARCHAR) AS func_name,
         {_HEAD_SQL} || CAST(l_orderkey AS VARCHAR) || '>:' || chr(10)
         || string_agg(line, chr(10) ORDER BY n, line) || {_TAIL_SQL} AS listing,
         list(struct_pack(n := n, line := line) ORDER BY n, line) AS lines
  FROM li GROUP BY l_orderkey)"""


# ------------------------------------------------------------------ T10 + T11

def function_listing(spark: SparkSession, d: str) -> DataFrame:
    """T10 + T11: the named function's block, cleaned in the tab form, as
    the prompt input of the original README."""
    ls = listings(spark, d)
    block = T.function_from_listing(F.col("listing"), F.col("func_name"))
    return ls.select("order_id", T.clean_listing_tab_form(block).alias("input_asm"))


def _strip_sql(x: str) -> str:
    return q.strip(x)


_TAB_CLEAN_SQL = """array_to_string(list_transform(
      list_filter(string_split(block, chr(10)), lambda l: NOT (len(string_split(l, chr(9))) < 3 AND contains(l, '00'))),
      lambda l: {strip_inner} || chr(10)), '')"""

def bare_function_listing(spark: SparkSession, d: str) -> DataFrame:
    """T10 with bare labels (``name:``), as compiler output writes them."""
    ls = listings(spark, d).withColumn("listing", F.replace(F.replace("listing", F.lit("<"), F.lit("")), F.lit(">"), F.lit("")))
    block = T.function_from_listing(F.col("listing"), F.col("func_name"), bare=True)
    return ls.select("order_id", block.alias("block"))


BARE_FUNCTION_LISTING_SQL = f"""WITH {LISTINGS},
l AS (SELECT order_id, func_name, replace(replace(listing, '<', ''), '>', '') AS listing FROM listings)
SELECT order_id, func_name || ':' || string_split(string_split(listing, func_name || ':')[-1], chr(10) || chr(10))[1] AS block
FROM l"""

FUNCTION_LISTING_SQL = f"""WITH {LISTINGS},
b AS (SELECT order_id, '<' || func_name || '>:' || string_split(
        string_split(listing, '<' || func_name || '>:')[-1], chr(10) || chr(10))[1] AS block FROM listings)
SELECT order_id, {_strip_sql(_TAB_CLEAN_SQL.format(strip_inner=_strip_sql(
    "split_part(array_to_string(string_split(l, chr(9))[least(len(string_split(l, chr(9))) - 1, 2) + 1:], chr(9)), '#', 1)")))}
    AS input_asm
FROM b"""


# ------------------------------------------------------------------ T12-T14, P7, J5

def _section_clean(lines: Column, level: Column) -> Column:
    """Listing of one level (lines numbered > level), cleaned (T12). The
    function starts at address 0 on even levels, at 16 on odd ones."""
    kept = F.filter(lines, lambda x: x["n"] > level)
    head = F.when(level % 2 == 0, F.lit("0000000000000000 <main>:\n")).otherwise(F.lit("0000000000000010 <main>:\n"))
    text = F.concat(F.lit("Disassembly of section .text:\n"), head, F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))
    return T.clean_listing_section_form(text)


def corpus_build(spark: SparkSession, d: str) -> DataFrame:
    """J5 + T12-T14 + P7: every order (source file) at levels O0..O3 (level j
    keeps the lines numbered above j); a level whose cleaned listing has
    fewer than 4 pieces rejects the whole file. Output: long form
    (file, opt, asm) for kept files."""
    o = order_lines(spark, d)
    lv = F.array(*[F.lit(j) for j in LEVELS])
    per = o.select(
        F.concat(F.lit("file"), F.col("l_orderkey").cast("string"), F.lit(".c")).alias("name"),
        F.transform(lv, lambda j: F.struct(
            F.concat(F.lit("O"), j.cast("string")).alias("opt"),
            _section_clean(F.col("lines"), j).alias("raw"))).alias("levels"))
    # P7 on the raw cleaned listing; one failing level drops the whole file
    kept = select_where(per.select("name", "levels"), ["name"], {"levels": F.col("levels")}, lambda r: F.forall(
        r["levels"], lambda x: T.listing_piece_count(x["raw"]) >= 4))
    return kept.select("name", F.inline("levels")).select(
        "name", "opt", T.remove_attribute(T.strip_leading_zeros(F.col("raw"))).alias("asm"))


_SECTION_CLEAN_SQL = """array_to_string(list_transform(string_split({x}, chr(10)),
      lambda l: {strip_l} || chr(10)), '')"""


def _level_asm_sql(j: int) -> str:
    text = (f"'Disassembly of section .text:' || chr(10) || '00000000000000{j % 2}0 <main>:' || chr(10) || coalesce(array_to_string(list_transform("
            f"list_filter(lines, lambda x: x.n > {j}), lambda x: x.line), chr(10)), '')")
    after = q.strip(f"string_split({text}, 'Disassembly of section .text:')[-1]")
    cleaned = _SECTION_CLEAN_SQL.format(x=after, strip_l=q.strip(
        "split_part(string_split(l, chr(9))[-1], '#', 1)"))
    return cleaned


def _finish_sql(x: str) -> str:
    zeros = f"regexp_replace({x}, '^0+[\\t\\n\\x0b\\x0c\\r\\x1c-\\x1f ]', '')"
    return f"replace({zeros}, '__attribute__((used)) ', '')"


CORPUS_BUILD_SQL = f"""WITH {LISTINGS},
lv AS (SELECT 'file' || CAST(order_id AS VARCHAR) || '.c' AS name,
  {_level_asm_sql(0)} AS a0, {_level_asm_sql(1)} AS a1, {_level_asm_sql(2)} AS a2, {_level_asm_sql(3)} AS a3
  FROM listings),
kept AS (SELECT * FROM lv WHERE len(string_split(a0, chr(10))) >= 4 AND len(string_split(a1, chr(10))) >= 4
                          AND len(string_split(a2, chr(10))) >= 4 AND len(string_split(a3, chr(10))) >= 4)
SELECT name, 'O0' AS opt, {_finish_sql('a0')} AS asm FROM kept UNION ALL SELECT name, 'O1', {_finish_sql('a1')} FROM kept
UNION ALL SELECT name, 'O2', {_finish_sql('a2')} FROM kept UNION ALL SELECT name, 'O3', {_finish_sql('a3')} FROM kept"""


def label_presence(spark: SparkSession, d: str) -> DataFrame:
    """Listings that contain the label of a called function vs not
    (the original raises on a missing label; here the rejects are a count)."""
    ls = listings(spark, d)
    label = F.concat(F.lit("<func"), F.col("callee").cast("string"), F.lit(">"))
    return ls.groupBy(F.col("listing").contains(label).alias("present")).agg(F.count(F.lit(1)).alias("n"))


LABEL_PRESENCE_SQL = f"""WITH {LISTINGS},
c AS (SELECT l_orderkey AS order_id, min(l_partkey) AS callee FROM lineitem GROUP BY 1)
SELECT contains(listing, '<func' || CAST(callee AS VARCHAR) || '>') AS present, count(*) AS n
FROM listings JOIN c USING (order_id) GROUP BY 1"""


# ------------------------------------------------------------------ T16

def decompiler_output(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in decompiler listing per order: one ``// Function:`` section
    per line item."""
    li = table(spark, d, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").alias("n"),
        F.concat(F.lit("// Function: fn"), F.col("l_linenumber").cast("string"), F.lit("\n/* WARNING: stack */\n"),
                 F.lit("void fn"), F.col("l_linenumber").cast("string"), F.lit("(long p)\n{\n  return "),
                 F.col("l_partkey").cast("string"), F.lit(";\n}\n\n")).alias("sec"))
    return li.groupBy("l_orderkey").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "sec"))), lambda x: x["sec"]), "")
        .alias("text"))


def decompiler_sections(spark: SparkSession, d: str) -> DataFrame:
    """One row per function section of each listing."""
    out = decompiler_output(spark, d)
    return out.select(F.col("l_orderkey").alias("order_id"),
                      F.inline(T.decompiler_sections(F.col("text"))))


DECOMPILER_SECTIONS_SQL = f"""WITH li AS (
  SELECT l_orderkey, l_linenumber AS n,
         '// Function: fn' || CAST(l_linenumber AS VARCHAR) || chr(10) || '/* WARNING: stack */' || chr(10)
         || 'void fn' || CAST(l_linenumber AS VARCHAR) || '(long p)' || chr(10) || '{{' || chr(10) || '  return '
         || CAST(l_partkey AS VARCHAR) || ';' || chr(10) || '}}' || chr(10) || chr(10) AS sec
  FROM lineitem),
t AS (SELECT l_orderkey AS order_id, string_agg(sec, '' ORDER BY n, sec) AS text FROM li GROUP BY 1),
s AS (SELECT order_id, unnest(string_split(text, '// Function: ')[2:]) AS sec FROM t),
l AS (SELECT order_id, string_split(sec, chr(10)) AS lines FROM s),
nm AS (SELECT order_id, lines, {q.strip('lines[1]')} AS name FROM l),
f AS (SELECT order_id, lines, name,
        coalesce(list_filter(range(2, len(lines) + 1), lambda i: contains(lines[i], name))[1], len(lines)) AS first
      FROM nm)
SELECT order_id, name, {q.strip("array_to_string(lines[first:], chr(10))")} AS body FROM f"""


# ------------------------------------------------------------------ T15, T17, T18

def source_files(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in source files: declarations, the marker, globals, then the
    function (with the attribute the corpus builder deletes)."""
    c = c_functions(spark, d)
    src = F.concat(F.lit("#include <stdio.h>\ntypedef int t_"), F.col("func_id").cast("string"),
                   F.lit(";\n/* Variables and functions */\nint g_"), F.col("func_id").cast("string"),
                   F.lit(";\nstatic int h;\n\n__attribute__((used)) "), F.col("code"))
    return c.select("func_id", "func_name", "code", src.alias("source"))


SOURCE_FILES = f"""{C_FUNCTIONS},
source_files AS (
  SELECT func_id, func_name, code,
         '#include <stdio.h>' || chr(10) || 'typedef int t_' || CAST(func_id AS VARCHAR) || ';' || chr(10)
         || '/* Variables and functions */' || chr(10) || 'int g_' || CAST(func_id AS VARCHAR) || ';' || chr(10)
         || 'static int h;' || chr(10) || chr(10) || '__attribute__((used)) ' || code AS source
  FROM c_functions)"""


def source_bodies(spark: SparkSession, d: str) -> DataFrame:
    """T15 (+T14): text after the marker minus its first blank-line block."""
    return source_files(spark, d).select("func_id", T.source_body(F.col("source")).alias("input"))


SOURCE_BODIES_SQL = f"""WITH {SOURCE_FILES},
a AS (SELECT func_id, source, string_split(string_split(source, '/* Variables and functions */')[-1],
        chr(10) || chr(10)) AS blocks FROM source_files)
SELECT func_id, CASE WHEN contains(source, '/* Variables and functions */')
  THEN replace(array_to_string(blocks[2:], chr(10) || chr(10)), '__attribute__((used)) ', '')
  ELSE source END AS input
FROM a"""


def program_texts(spark: SparkSession, d: str) -> DataFrame:
    """T17 + T18: include lines hoisted from source and test, then the
    program (includes, prediction, test) and the compile-only form. The
    prediction is the function with its name aligned (T20)."""
    src = source_files(spark, d)
    test = F.concat(F.lit("#include <assert.h>\nint main() {\n  assert("), F.col("func_name"),
                    F.lit("(0, 0) == 0);\n  return 0;\n}\n"))
    pred = T.align_name(F.col("code"), T.function_name(F.col("code")), F.col("func_name"))
    h = src.select("func_id", T.hoist_includes(F.col("source"), test).alias("h"), pred.alias("pred"))
    return h.select("func_id",
                    T.assemble_program(F.col("h.includes"), F.col("pred"), F.col("h.test")).alias("program"),
                    T.assemble_program(F.col("h.includes"), F.col("pred")).alias("compile_only"))


PROGRAM_TEXTS_SQL = f"""WITH {SOURCE_FILES},
t AS (SELECT func_id, func_name, source, code,
        '#include <assert.h>' || chr(10) || 'int main() {{' || chr(10) || '  assert(' || func_name
        || '(0, 0) == 0);' || chr(10) || '  return 0;' || chr(10) || '}}' || chr(10) AS test,
        {q.strip("split_part(split_part(code, '(', 1), ' ', -1)")} AS tok FROM source_files),
n AS (SELECT *, CASE WHEN starts_with(tok, '**') THEN substr(tok, 3) WHEN starts_with(tok, '*') THEN substr(tok, 2)
                     ELSE tok END AS name FROM t),
p AS (SELECT *, CASE WHEN name = '' THEN code ELSE replace(code, name, func_name) END AS pred,
        list_filter(string_split(source, chr(10)), lambda l: contains(l, '#include')) AS fi,
        list_filter(string_split(test, chr(10)), lambda l: contains(l, '#include')) AS ti FROM n),
h AS (SELECT func_id, pred, coalesce(array_to_string(list_transform(fi || ti, lambda l: l || chr(10)), ''), '') AS inc,
        list_reduce(list_prepend(test, ti), lambda acc, l: replace(acc, l, '')) AS test2 FROM p)
SELECT func_id, inc || chr(10) || pred || chr(10) || test2 AS program, inc || chr(10) || pred AS compile_only FROM h"""


QUERIES = {
    "t10_bare_listing": bare_function_listing,
    "t10_t11_function_listing": function_listing,
    "p7_j5_corpus_build": corpus_build,
    "p8_label_presence": label_presence,
    "t16_decompiler_sections": decompiler_sections,
    "t15_source_bodies": source_bodies,
    "t17_t18_program_texts": program_texts,
}

ORACLE = {
    "t10_bare_listing": BARE_FUNCTION_LISTING_SQL,
    "t10_t11_function_listing": FUNCTION_LISTING_SQL,
    "p7_j5_corpus_build": CORPUS_BUILD_SQL,
    "p8_label_presence": LABEL_PRESENCE_SQL,
    "t16_decompiler_sections": DECOMPILER_SECTIONS_SQL,
    "t15_source_bodies": SOURCE_BODIES_SQL,
    "t17_t18_program_texts": PROGRAM_TEXTS_SQL,
}
