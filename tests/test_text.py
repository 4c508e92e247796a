"""Text functions against literal input / expected pairs."""
import random
import re

import pytest
from pyspark.sql import functions as F

from codecorpus.functions import regex as R
from codecorpus.functions import text as T
from conftest import col_values

COMMENTS = [
    ("int a; // c \"x\"\nb", "int a;  \nb"),
    ('s = "a // b /* c */"; /* blk\n two */ x', 's = "a // b /* c */";   x'),
    ('"never closed // x', '"never closed  '),
    ("'\\'' // q", "'\\''  "),
    ("/* open", "/* open"),
    ("/**/x/***/y", " x y"),
    ("a\\", "a\\"),
    ("trailing // c\\", "trailing  "),
    ('"esc \\" // still" // gone', '"esc \\" // still"  '),
    ("line1\r\nline2 // c\rline3", "line1\r\nline2  "),
    ("", ""),
]

NAIVE = [
    ("int a; // c\nb", "int a; \nb"),
    ('s = "a // b"; x', 's = "a '),
    ("a /* 1\n2 */ b /**/ c", "a  b  c"),
    ("/* // */ x", " x"),
    ("/* open // y", "/* open "),
]

HEX = [
    ("x = 0x1F;", "x = 31;"),
    ("0xFFFFFFFFFFFFFFFFull + 0x0001u", "18446744073709551615ull + 1u"),
    ("0xABCDEF0123456789ABCDul", "811323473191050827901901ul"),
    ("0xG 0X1F 0x1fLLL 0x12uuuu", "0xG 0X1F 31LLL 0x12uuuu"),
    ("a0x10 _0x10 0x0", "a0x10 _0x10 0"),
    ("0xffffffffffffffffffffffffffffffffffffffffu", "1461501637330902918203684832716283019655932542975u"),
    ("0x" + "1" * 40, "97433442488726861213578988847752201310395502865"),
    ("0x100000000000000000000000000000000", "340282366920938463463374607431768211456"),
    ("0x0000000000000000000000000000000000000000000000000000000a;", "10;"),
]

KEYWORDS = [
    ("__noreturn  noreturn f(); __fastcall g(); int __cdecl h(void * __ptr32 p)", " f();  g(); int  h(void *  p)"),
    ("__noreturn f(); __fastcalls x__cdecl", "__noreturn f(); __fastcalls x__cdecl"),
]

ALIASES = [
    ("_DWORD x; __int64 y;", "uint32_t x; long long y;"),
    ("size_tt z; my_DWORD w; _DWORDs v;", "size_tt z; my_DWORD w; _DWORDs v;"),
]

BLANK_LINES = [
    ("a\n\n  \nb\n", "a\nb"),
    ("line1\r\n\r\nline2\rline3", "line1\nline2\nline3"),
    (" \t\x0b lead\x1c\n\n  \x85 mid \n", " lead\n mid "),
    ("", ""),
]


@pytest.mark.parametrize("fn,pairs", [
    (T.remove_comments, COMMENTS), (T.remove_comments_naive, NAIVE), (T.hex_to_dec, HEX), (T.remove_keywords, KEYWORDS),
    (T.replace_type_aliases, ALIASES), (T.strip_empty, BLANK_LINES),
    (T.remove_keywords_and_aliases, [("__fastcall f(_DWORD a)", " f(uint32_t a)")]),
])
def test_text_rules(spark, fn, pairs):
    got = col_values(spark, [given for given, _ in pairs], fn)
    bad = [(given, g, want) for (given, want), g in zip(pairs, got) if g != want]
    assert not bad, bad[:3]


def test_good_func(spark):
    long_body = "f() {\n" + "\n".join("  xyz;" for _ in range(299)) + "\n}"
    longest = "f() {\n" + "\n".join("  xyz;" for _ in range(298)) + "\n}"
    assert col_values(spark, [long_body, longest, "f() {\n a;\n b;\n c;\n}", "f() {\n abc;\n abc;\n abc;\n abc;\n}",
                              "no brace\nabc\nabc\nabc\nabc", "f() { abc;\n abc;\n abc;\n abc; }"],
                      T.good_func) == [True, True, False, True, False, True]


def test_strip_and_splitlines(spark):
    vals = [" a ", "\t\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 x　 ", "", "\n", "a\r\nb\rc\x0bd\x0ce\x1cf g\n"]
    assert col_values(spark, vals, R.py_strip) == ["a", "x", "", "", "a\r\nb\rc\x0bd\x0ce\x1cf\u2028g"]
    assert col_values(spark, vals, R.py_splitlines) == [
        [" a "], ["\t", "", "", "", "", "\x1f", "\xa0\u2000x\u3000 "], [], [""],
        ["a", "b", "c", "d", "e", "f", "g"]]


def test_canonical_lines(spark):
    vals = ["  a  \n\n b\r\n  ", "", "x"]
    assert col_values(spark, vals, T.canonical_lines) == ["a\nb", "", "x"]


def test_normalise_and_status(spark):
    code = "int f() {\n  /* c */ _DWORD a = 0x10;\n  __cdecl b;\n  cc_t c;\n  d = 1;\n  e = 2;\n}\n"
    df = spark.createDataFrame([(code,), ("// only\n",), ("f(){\n}",)], "c string")
    rows = df.select(T.normalise_pseudo("c").alias("n")).select("n", T.accept_status("n").alias("s")).collect()
    assert rows[0]["n"] == "int f() {\n   uint32_t a = 16;\n   b;\n  int c;\n  d = 1;\n  e = 2;\n}"
    assert rows[0]["s"] == "accepted"
    assert rows[1]["n"] == "" and rows[1]["s"] == "empty"
    assert rows[2]["s"] == "rejected"
    failed = df.select(T.normalise_pseudo("c", lambda r: F.lit(None).cast("string")).alias("n"))
    assert [r[0] for r in failed.select(T.accept_status("n")).collect()] == ["format_failed", "empty", "format_failed"]


def test_formatter_sees_the_processed_text(spark):
    code = "int f() { /* c */ _DWORD a = 0x10; }\n\n// gone\n__cdecl b;\n"
    df = spark.createDataFrame([(code,)], "c string")
    shown = df.select(T.normalise_pseudo("c", lambda r: F.concat(F.lit("<"), F.replace(r, F.lit("  "), F.lit(" ")), F.lit(">"))))
    assert shown.first()[0] == "<int f() { uint32_t a = 16; }\n b;\n>"


@pytest.mark.parametrize("c", [
    "0x1/* c */2 _DW/**/ORD __fast/*\n*/call;", "/ /* x */ / y", "a/**//b\nc", "0x/* */1F", "size_t/**/ size/* */_t _t",
    "__noreturn /* k */ noreturn", "éDIR DIRé _DWORD\u0301 DIR.DIR-DIR 0x1Fé é0x1F 0x10u0x10", "__int64__int64 __int64 __int64",
    "0x1F_DWORD 0x1FuLL;0xFFFFFFFFFFFFFFFFFFFFul", ""])
def test_one_token_pass_equals_the_passes(spark, c):
    """Also where a removed comment joins two tokens."""
    df = spark.createDataFrame([(c,)], "c string")
    plain = T.remove_comments_naive("c")
    row = df.select(T.rewrite_tokens(plain).alias("one"), T.replace_type_aliases(T.remove_keywords(T.hex_to_dec(plain))).alias("many"),
                    T.normalise_pseudo("c").alias("norm")).first()
    assert row["one"] == row["many"]
    text = re.sub(r"(?m)//.*?$", "", re.sub(r"(?s)/\*.*?\*/", "", c))
    text = re.sub(r"\b(0x[0-9a-fA-F]+)([uUlL]{1,3})?\b", lambda m: str(int(m[1], 16)) + (m[2] or ""), text)
    text = re.sub(r"\b__fastcall\b|\b__cdecl\b|\b__ptr32\b|\b__noreturn\s+noreturn\b", "", text)
    for alias, base in T.TYPE_ALIASES:
        text = re.sub(rf"\b{re.escape(alias)}\b", base, text)
    if "\u0301" not in c:  # Python takes a combining mark for no part of a word
        assert row["one"] == text


def test_hex_of_any_width(spark):
    rng = random.Random(9)
    words = ["%x" % rng.getrandbits(b) for b in (1, 60, 63, 64, 65, 119, 120, 121, 128, 180, 240, 241, 900, 4000) for _ in range(6)]
    words += ["f" * k for k in range(14, 62)] + ["1" + "0" * k for k in range(14, 62)]
    assert col_values(spark, words, T.hex_digits_to_decimal) == [str(int(w, 16)) for w in words]


LISTING = ("junk\nDisassembly of section .text:\n\n0000 <f>:\n   0:\t55\tpush %rbp # c\n   1:\t00 00\n"
           "   4:\t48 89 e5\tmov %rsp,%rbp\n\n0010 <g>:\n  10:\tc3\tret\n")


def test_listings(spark):
    df = spark.createDataFrame([(LISTING, "f")], "a string, n string")
    r = df.select(T.function_from_listing("a", "n").alias("b")).select(
        "b", T.clean_listing_tab_form("b").alias("t")).first()
    assert r["b"] == "<f>:\n   0:\t55\tpush %rbp # c\n   1:\t00 00\n   4:\t48 89 e5\tmov %rsp,%rbp"
    assert r["t"] == "<f>:\npush %rbp\nmov %rsp,%rbp"
    s = df.select(T.clean_listing_section_form("a")).first()[0]
    assert s == "0000 <f>:\npush %rbp\n00 00\nmov %rsp,%rbp\n\n0010 <g>:\nret\n"
    z = col_values(spark, ["000 x\n00 y", "0x 000"], T.strip_leading_zeros)
    assert z == ["x\n00 y", "0x 000"]


def test_source_body(spark):
    src = "typedef int t;\n/* Variables and functions */\nint g;\n\n__attribute__((used)) int f() {}\n\nint h;"
    assert col_values(spark, [src, "no marker"], T.source_body) == ["int f() {}\n\nint h;", "no marker"]


def test_decompiler_sections(spark):
    text = ("// Function: f\n/* warn */\nint f(void)\n{\n  return 1;\n}\n"
            "// Function: g\nvoid g(void) {}\n// Function: zz\nnothing here\nlast")
    rows = spark.createDataFrame([(text,)], "t string").select(F.inline(T.decompiler_sections("t"))).collect()
    assert [(r["name"], r["body"]) for r in rows] == [
        ("f", "int f(void)\n{\n  return 1;\n}"), ("g", "void g(void) {}"), ("zz", "last")]


def test_includes_and_program(spark):
    func = "#include <a.h>\nint f() {}\n#include <b.h>"
    test = "#include <t.h>\nint main() { f(); }"
    r = spark.createDataFrame([(func, test)], "f string, t string").select(
        T.hoist_includes("f", "t").alias("h")).first()["h"]
    assert r["includes"] == "#include <a.h>\n#include <b.h>\n#include <t.h>\n"
    assert r["func"] == "\nint f() {}\n" and r["test"] == "\nint main() { f(); }"


@pytest.mark.parametrize("text,name", [
    ("int func0(int a)", "func0"), ("char **pp(int)", "pp"), ("int *p(void)", "p"), ("x", "x"),
    ("int  (weird)", ""), ("void ***t(x)", "*t"),
])
def test_function_name(spark, text, name):
    assert col_values(spark, [text], T.function_name) == [name]


def test_align_name(spark):
    df = spark.createDataFrame([("int f(x) { f(1); }", "f", "g"), ("abc", "", "zz")], "t string, o string, n string")
    assert [r[0] for r in df.select(T.align_name("t", "o", "n")).collect()] == ["int g(x) { g(1); }", "abc"]


def test_align_name_whole_word(spark):
    df = spark.createDataFrame([("int f(x) { foo(f); f_2(); }", "f", "g$1"), ("a.b(a.b)", "a.b", "z")],
                               "t string, o string, n string")
    got = [r[0] for r in df.select(T.align_name("t", "o", "n", whole_word=True)).collect()]
    assert got == ["int g$1(x) { foo(g$1); f_2(); }", "z(z)"]


def test_prompts_and_templates(spark):
    df = spark.createDataFrame([(" asm \n", "O2", "a[DSRC]", "b")], "a string, o string, s string, d string")
    r = df.select(T.render_prompt("a").alias("p"), T.render_prompt("a", strip=False, opt=F.col("o")).alias("q"),
                  T.fill_template(F.lit("[SRC]|[DSRC]"), F.col("s"), F.col("d")).alias("t"),
                  T.remove_stop_sequences(F.lit("x</s>y<|EOT|>"), ["</s>", "<|EOT|>"]).alias("u")).first()
    assert r["p"] == "# This is the assembly code:\nasm\n# What is the source code?\n"
    assert r["q"] == "# This is the assembly code with O2 optimization:\n asm \n\n# What is the source code?\n"
    assert r["t"] == "ab|b" and r["u"] == "xy"


@pytest.mark.parametrize("answer,score", [
    ('```json\n{"Code Readability Assessment": {"score": 4, "rationale": "x"}}\n```', 4),
    ('{"Code Readability Assessment": {"score": 3, "rationale": "x"}', 3),
    ('{"Code Readability Assessment": {"score": 5, "rationale": "a \\q b"}}', 5),
    ("no json here", 1), ('{"Other": {"score": 2}}', 1), ("", 1), ("{}", 1), ("5", 1),
    ('{"Code Readability Assessment": {"score": 4}} thanks', 1),
    ('{"Code Readability Assessment": {"score": 4}}}', 1),
    ('{"Code Readability Assessment": {"score": 1}, "Code Readability Assessment": {"score": 5}}', 5),
    ('{"Code Readability Assessment": {"score": 2, "rationale": "a } b {{"}}', 2),
    ('{"Code Readability Assessment": {"score": "3"}} \n', 3), ('{"Code Readability Assessment": 4}', 1),
])
def test_judge_score(spark, answer, score):
    assert col_values(spark, [answer], T.judge_score) == [score]


def test_human_count(spark):
    vals = [0, 1023, 1024, 1152, 1536 * 1024, 5 * 1024 ** 3 + 7, 123456789]
    assert col_values(spark, vals, T.human_count, "long") == [
        "0", "1023", "1.00 K", "1.12 K", "1.50 M", "5.00 B", "117.74 M"]


def test_chat_piece(spark):
    df = spark.createDataFrame([("", "sys"), ("Human", "hi"), ("Assistant", "")], "r string, t string")
    assert [x[0] for x in df.select(T.chat_piece("r", "t")).collect()] == \
        ["<s>sys\n\n", "Human: <s>hi</s>", "Assistant: <s>"]


def test_result_file_names(spark):
    df = spark.createDataFrame([(12, "O3", "cpp")], "i long, o string, l string")
    name = df.select(T.result_file_name("i", "o", "l")).first()[0]
    assert name == "12_O3.cpp"
    p = spark.createDataFrame([(name,), ("x.c",)], "n string").select(T.parse_result_file_name("n").alias("p")).collect()
    assert (p[0]["p"]["index"], p[0]["p"]["opt"], p[0]["p"]["language"]) == (12, "O3", "cpp")
    assert p[1]["p"]["index"] is None
