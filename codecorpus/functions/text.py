"""Scalar text functions over C code, listings and prompts.

Every function maps Columns to a Column built only from Spark built-ins, so
whole stages stay in JVM code (no Python per row). Semantics follow the
original scripts: Python ``str.strip``/``splitlines``/``re`` behaviour is
reproduced with the helpers in ``regex.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import PY_LINE_BREAK, PY_SPACE_CLASS, let, py_splitlines, py_strip, sub_with

_NOT_SPACE = "[^" + PY_SPACE_CLASS[1:]
_LINE_BREAK = PY_LINE_BREAK[PY_LINE_BREAK.index("["):]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ascii_fold(c) -> Column:
    """Replace every non-ASCII code point by ``?``."""
    return F.regexp_replace(_c(c), r"[^\x00-\x7F]", "?")


def is_blank(c) -> Column:
    return ~_c(c).rlike(_NOT_SPACE)


# ---------------------------------------------------------------- T3, T8, T9

def strip_empty(c) -> Column:
    """Drop lines that are blank after strip, join with newline."""
    # from one line break to the last of the same white space: blank lines only
    joined = F.regexp_replace(_c(c), f"{_LINE_BREAK}(?:{PY_SPACE_CLASS}*{_LINE_BREAK})?", "\n")
    return F.regexp_replace(joined, rf"\A{PY_SPACE_CLASS}*(?:\n|\z)|\n{PY_SPACE_CLASS}*\z", "")


def canonical_lines(c) -> Column:
    """Strip each line, drop empty ones, join with newline."""
    return F.array_join(F.filter(F.transform(py_splitlines(_c(c)), py_strip), lambda ln: ln != ""), "\n")


def edit_similarity_jvm(a, b, canonical: bool = True) -> Column:
    """T9 with Spark's built-in cell-by-cell ``levenshtein`` (reference
    implementation for tests; ``similarity.edit_similarity`` is the fast one)."""
    x = canonical_lines(a) if canonical else _c(a)
    y = canonical_lines(b) if canonical else _c(b)

    def score(x: Column, y: Column) -> Column:
        longest = F.greatest(F.length(x), F.length(y))
        return F.when(longest == 0, F.lit(1.0)).otherwise(
            F.lit(1.0) - F.levenshtein(x, y).cast("double") / longest.cast("double"))
    return let(x, lambda x: let(y, lambda y: score(x, y)))


# ---------------------------------------------------------------- P4

def good_func(c) -> Column:
    """After the first ``{``, count lines whose strip has >= 3 chars; keep 4..299."""
    def count(c: Column) -> Column:
        pos = F.instr(c, "{")
        body = F.when(pos > 0, F.substring(c, pos + 1, 2147483647)).otherwise(F.lit(""))
        # from a line's first character that is no space to its last one, if a third lies between: one match for each such line
        return F.regexp_count(body, F.lit(_NOT_SPACE + r"[^\n]+" + _NOT_SPACE))
    return let(_c(c), lambda c: let(count(c), lambda n: (n > 3) & (n < 300)))


# ---------------------------------------------------------------- T1, T2

# Comment and literal patterns. The quoted-literal branches are
# the unrolled possessive form of ``"(?:\\.|[^\\"])*"``: same matches, but no
# recursion in java.util.regex (the plain form overflows the stack on long
# literals). The lookahead spares most positions the four branches.
COMMENT_OR_LITERAL = (r"""(?smd)(?=[/'"])(?://.*?$|/\*.*?\*/"""
                      r"|'[^\\']*+(?:\\.[^\\']*+)*+'"
                      r"|" + r'"[^\\"]*+(?:\\.[^\\"]*+)*+")')
# Fixed value.
BLOCK_COMMENT = r"(?s)/\*.*?\*/"
LINE_COMMENT = r"(?md)//.*?$"


def remove_comments(c) -> Column:
    """Comments become one space; string and char literals are kept."""
    return sub_with(_c(c), COMMENT_OR_LITERAL,
                    lambda tok: F.when(tok.startswith("/"), F.lit(" ")).otherwise(tok))


def remove_comments_naive(c) -> Column:
    """``/*..*/`` then ``//..`` removed, also inside literals."""
    return F.regexp_replace(F.regexp_replace(_c(c), BLOCK_COMMENT, ""), LINE_COMMENT, "")


# ---------------------------------------------------------------- T4, T5, T6

# Fixed value.
# (the literal prefix comes before its word boundary: the cheap test first)
HEX_LITERAL = r"0x(?<=\b0x)[0-9a-fA-F]+(?:[uUlL]{1,3})?\b"


def hex_digits_to_decimal(h) -> Column:
    """Unsigned value of a hex digit string of any width, as decimal text.

    Up to 16 significant digits ``conv`` is exact. Wider values are folded 15
    hex digits at a time into limbs of 18 decimal digits, lowest first: every
    limb is multiplied by 16^15 and takes its lower neighbour's carry, which
    stays within 38 digits.
    """
    base, radix = F.lit(10 ** 18).cast("decimal(19,0)"), F.lit(16 ** 15).cast("decimal(19,0)")
    wide_type = "decimal(38,0)"

    def push(limbs: Column, chunk: Column) -> Column:
        start = F.struct(F.array().cast("array<bigint>").alias("out"), F.conv(chunk, 16, 10).cast("long").alias("carry"))

        def step(acc: Column, limb: Column) -> Column:
            return let((limb.cast("decimal(18,0)") * radix + acc.carry).cast(wide_type), lambda x: F.struct(
                F.concat(acc.out, F.array((x % base).cast("long"))).alias("out"),
                F.call_function("div", x, base).alias("carry")))
        # a carry can itself fill a limb and more
        return F.aggregate(limbs, start, step, lambda r: F.concat(r.out, F.when(
            r.carry >= 10 ** 18, F.array(r.carry % 10 ** 18, F.lit(1).cast("long"))).when(
            r.carry > 0, F.array(r.carry)).otherwise(F.array().cast("array<bigint>"))))

    def wide(sig: Column) -> Column:
        padded = F.lpad(sig, F.ceil(F.length(sig) / 15).cast("int") * 15, "0")
        limbs = F.aggregate(F.regexp_extract_all(padded, F.lit(".{15}"), 0), F.array().cast("array<bigint>"), push)
        return F.ltrim(F.array_join(F.transform(F.reverse(limbs), lambda x: F.lpad(x.cast("string"), 18, "0")), ""),
                       F.lit("0"))

    return let(F.ltrim(_c(h), F.lit("0")), lambda sig: F.when(sig == "", F.lit("0")).when(
        F.length(sig) <= 16, F.conv(sig, 16, 10)).otherwise(wide(sig)))


def _hex_token(tok: Column) -> Column:
    """A hex literal as a decimal one, its suffix kept."""
    return let(F.rtrim(tok, F.lit("uUlL")), lambda plain: F.concat(
        hex_digits_to_decimal(F.substring(plain, 3, 2147483647)), F.substring(tok, F.length(plain) + 1, 3)))


def hex_to_dec(c) -> Column:
    """T4: hex literals (suffix kept) become decimal literals."""
    return sub_with(_c(c), HEX_LITERAL, _hex_token)


# Calling-convention keywords deleted by the normaliser.
# (the shared \b is factored out of the alternatives: same matches)
KEYWORDS = (r"\b(?:__fastcall|__cdecl|__ptr32|__noreturn" + PY_SPACE_CLASS + r"+noreturn)\b")


def remove_keywords(c) -> Column:
    """T5."""
    return F.regexp_replace(_c(c), KEYWORDS, "")


# Decompiler type alias -> C type, in the original order.
TYPE_ALIASES = [
    ("cpu_set_t", "int"), ("nl_item", "int"), ("__time_t", "int"),
    ("__mode_t", "unsigned short"), ("__off64_t", "long long"), ("__blksize_t", "long"),
    ("__ino_t", "unsigned long"), ("__blkcnt_t", "unsigned long long"),
    ("__syscall_slong_t", "long"), ("__ssize_t", "long int"),
    ("wchar_t", "unsigned short int"), ("wctype_t", "unsigned short int"),
    ("__int64", "long long"), ("__int32", "int"), ("__int16", "short"), ("__int8", "char"),
    ("_QWORD", "uint64_t"), ("_OWORD", "long double"), ("_DWORD", "uint32_t"),
    ("size_t", "unsigned int"), ("_BYTE", "uint8_t"), ("_TBYTE", "uint16_t"),
    ("_BOOL8", "uint8_t"), ("gcc_va_list", "va_list"), ("_WORD", "unsigned short"),
    ("_BOOL4", "int"), ("__va_list_tag", "va_list"), ("_IO_FILE", "FILE"), ("DIR", "int"),
    ("__fsword_t", "long"), ("__kernel_ulong_t", "int"), ("cc_t", "int"), ("speed_t", "int"),
    ("fd_set", "int"), ("__suseconds_t", "int"), ("_UNKNOWN", "void"),
    ("__sighandler_t", "void (*)(int)"),
    ("__compar_fn_t", "int (*)(const void *, const void *)"),
]
def _grouped_alternation(words: list[str]) -> str:
    """``w1|w2|..`` grouped by first character (``c(?:pu_set_t|c_t)|..``):
    java.util.regex tries alternatives one by one, so grouping cuts the
    work at every position; each alternative still has to match a whole
    word, so the matches are the same."""
    groups: dict[str, list[str]] = {}
    for w in words:
        groups.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in groups.items())


ALIAS_PATTERN = r"\b(?:" + _grouped_alternation([a for a, _ in TYPE_ALIASES]) + r")\b"


def alias_map() -> Column:
    return F.create_map(*[F.lit(x) for pair in TYPE_ALIASES for x in pair])


def replace_type_aliases(c) -> Column:
    """Whole-word alias -> base type. No replacement is itself an alias,
    so one pass over the alternation equals the original ordered passes."""
    m = alias_map()
    return sub_with(_c(c), ALIAS_PATTERN, lambda tok: F.element_at(m, tok))


_ANY_WORD = ("__fastcall|__cdecl|__ptr32|__noreturn" + PY_SPACE_CLASS + "+noreturn|"
             + _grouped_alternation([a for a, _ in TYPE_ALIASES]))
_FIRST = "".join(sorted({a[0] for a, _ in TYPE_ALIASES} | {"_"}))
# (the lookahead spares most positions the boundary and the branches)
KEYWORDS_OR_ALIASES = rf"(?=[{_FIRST}])\b(?:{_ANY_WORD})\b"


def remove_keywords_and_aliases(c) -> Column:
    """T5 then T6 in one pass. A keyword removal needs non-word characters
    on both sides, so it never creates or breaks an alias match, and no
    replacement is a keyword or an alias: one callback over the joint
    alternation (keyword -> '', alias -> base type) equals the two passes."""
    m = alias_map()
    return sub_with(_c(c), KEYWORDS_OR_ALIASES, lambda tok: F.coalesce(F.element_at(m, tok), F.lit("")))


TOKENS = rf"(?=[0{_FIRST}])\b(?:0x[0-9a-fA-F]+(?:[uUlL]{{1,3}})?|{_ANY_WORD})\b"


def rewrite_tokens(c) -> Column:
    """T4, T5 and T6 in one pass over one alternation: hex literal, keyword,
    alias; everything else is the rest between them. All are whole words, a
    word is at most one of them and stays a word, and no replacement is one of
    them, so the order of the single passes does not matter."""
    m = alias_map()
    return sub_with(_c(c), TOKENS, lambda tok: F.when(tok.startswith("0"), _hex_token(tok)).otherwise(
        F.coalesce(F.element_at(m, tok), F.lit(""))))


# ---------------------------------------------------------------- T7, P6

def normalise_pseudo(c, formatter: Callable[[Column], Column] | None = None) -> Column:
    """T2 -> T4 -> T5 -> T6, layout, then T3.

    Comments go first, as a removed comment may join two words to a token; one
    pass then rewrites all tokens. The layout step is an external formatter in
    the original; ``formatter`` maps the processed text to its layout, NULL
    when it fails. Without one the layout is left as is. Returns ``''`` for
    blank results and NULL when the formatter failed.
    """
    def finish(r: Column) -> Column:
        laid_out = r if formatter is None else formatter(r)
        return F.when(is_blank(r), F.lit("")).otherwise(let(laid_out, strip_empty))
    return let(rewrite_tokens(remove_comments_naive(_c(c))), finish)


def keep_failed(norm, raw) -> Column:
    """P6 with ``remove=0``: the raw text where the formatter failed."""
    return F.coalesce(_c(norm), _c(raw))


def has_test(test) -> Column:
    """True if a sample brings a test: null and blank texts are none."""
    return py_strip(F.coalesce(_c(test), F.lit(""))) != ""


def accept_status(norm) -> Column:
    """P6 status: accepted / rejected (P4 fails) / empty / format_failed."""
    return let(_c(norm), lambda norm: (
        F.when(norm.isNull(), F.lit("format_failed"))
        .when(norm == "", F.lit("empty"))
        .when(good_func(norm), F.lit("accepted"))
        .otherwise(F.lit("rejected"))))


# ---------------------------------------------------------------- listings T10-T16

def function_from_listing(asm, name, bare: bool = False) -> Column:
    """``<name>:`` (``bare``: ``name:``) + text after its last occurrence
    up to the first blank line."""
    def cut(label: Column) -> Column:
        after = F.call_function("substring_index", _c(asm), label, F.lit(-1))
        return F.concat(label, F.split(after, "\n\n", -1).getItem(0))
    return let(F.concat(_c(name), F.lit(":")) if bare else F.concat(F.lit("<"), _c(name), F.lit(">:")), cut)


def clean_listing_tab_form(asm) -> Column:
    """Drop short lines containing ``00``, keep fields from min(n-1, 2),
    cut at ``#``, strip; the whole result is stripped."""
    lines = F.split(_c(asm), "\n", -1)
    kept = F.filter(lines, lambda ln: ~((F.size(F.split(ln, "\t", -1)) < 3) & ln.contains("00")))

    def clean(ln: Column) -> Column:
        def keep(fields: Column) -> Column:
            n = F.size(fields)
            tail = F.array_join(F.slice(fields, F.least(n - 1, F.lit(2)) + 1, n), "\t")
            return py_strip(F.substring_index(tail, "#", 1))
        return let(F.split(ln, "\t", -1), keep)
    return py_strip(F.array_join(F.transform(kept, lambda ln: F.concat(clean(ln), F.lit("\n"))), ""))


# Fixed value.
SECTION_MARKER = "Disassembly of section .text:"


def clean_listing_section_form(asm) -> Column:
    """After the last ``.text`` section header, last tab field of each
    line, cut at ``#``, strip; every line ends with a newline."""
    after = py_strip(F.substring_index(_c(asm), SECTION_MARKER, -1))
    lines = F.split(after, "\n", -1)
    cleaned = F.transform(lines, lambda ln: F.concat(
        py_strip(F.substring_index(F.element_at(F.split(ln, "\t", -1), -1), "#", 1)), F.lit("\n")))
    return F.array_join(cleaned, "")


def listing_piece_count(clean) -> Column:
    """P7 input: number of pieces of the cleaned listing split on newline."""
    return F.size(F.split(_c(clean), "\n", -1))


def strip_leading_zeros(c) -> Column:
    """``^0+\\s`` once, at the very start of the text only."""
    return F.regexp_replace(_c(c), r"\A0+" + PY_SPACE_CLASS, "")


# Fixed value.
ATTRIBUTE_USED = "__attribute__((used)) "


def remove_attribute(c) -> Column:
    """T14."""
    return F.replace(_c(c), F.lit(ATTRIBUTE_USED), F.lit(""))


# Fixed value.
BODY_MARKER = "/* Variables and functions */"


def source_body(c) -> Column:
    """Text after the last marker minus its first blank-line block, with
    the attribute removed; unchanged when the marker is absent."""
    def cut(c: Column) -> Column:
        blocks = F.split(F.substring_index(c, BODY_MARKER, -1), "\n\n", -1)
        body = let(blocks, lambda b: remove_attribute(
            F.array_join(F.slice(b, 2, F.greatest(F.size(b) - 1, F.lit(0))), "\n\n")))
        return F.when(c.contains(BODY_MARKER), body).otherwise(c)
    return let(_c(c), cut)


def decompiler_sections(text) -> Column:
    """T16 split: ``array<struct<name, body>>`` of one listing, one element per
    ``// Function: <name>`` section. ``body`` starts at the first line after
    the header that mentions the name (the last line if none does) and is
    stripped."""
    def one(lines: Column) -> Column:
        def with_name(name: Column) -> Column:
            hits = F.filter(F.transform(lines, lambda ln, i: F.when((i >= 1) & ln.contains(name), i)),
                            lambda i: i.isNotNull())
            first = F.coalesce(F.array_min(hits), F.size(lines) - 1)
            body = F.array_join(F.slice(lines, first + 1, F.size(lines)), "\n")
            return F.struct(name.alias("name"), py_strip(body).alias("body"))
        return let(py_strip(lines.getItem(0)), with_name)
    return let(F.split(_c(text), "// Function: ", -1), lambda secs: F.transform(
        F.slice(secs, 2, F.greatest(F.size(secs) - 1, F.lit(0))), lambda sec: let(F.split(sec, "\n", -1), one)))


# ---------------------------------------------------------------- T17, T18

def hoist_includes(func, test) -> Column:
    """``struct<includes, func, test>``: ``#include`` lines of func then
    test (each with a newline, duplicates kept) and both texts with every
    such line's text removed (line breaks stay)."""
    def build(func: Column, test: Column) -> Column:
        def with_inc(f_inc: Column, t_inc: Column) -> Column:
            inc = F.array_join(F.transform(F.concat(f_inc, t_inc), lambda ln: F.concat(ln, F.lit("\n"))), "")
            f2 = F.aggregate(f_inc, func, lambda acc, ln: F.replace(acc, ln, F.lit("")))
            t2 = F.aggregate(t_inc, test, lambda acc, ln: F.replace(acc, ln, F.lit("")))
            return F.struct(inc.alias("includes"), f2.alias("func"), t2.alias("test"))
        return let(F.filter(F.split(func, "\n", -1), lambda ln: ln.contains("#include")), lambda fi: let(
            F.filter(F.split(test, "\n", -1), lambda ln: ln.contains("#include")), lambda ti: with_inc(fi, ti)))
    return let(_c(func), lambda f: let(_c(test), lambda t: build(f, t)))


def assemble_program(includes, prediction, test=None) -> Column:
    """``includes \\n prediction \\n test``; compile-only form without test."""
    if test is None:
        return F.concat(_c(includes), F.lit("\n"), _c(prediction))
    return F.concat(_c(includes), F.lit("\n"), _c(prediction), F.lit("\n"), _c(test))


# ---------------------------------------------------------------- T19-T21

def raw_name_token(c) -> Column:
    """Last space token before the first ``(`` (no strip, stars kept)."""
    return F.substring_index(F.substring_index(_c(c), "(", 1), " ", -1)


def function_name(c) -> Column:
    """Stripped name token without a leading ``**`` or one ``*``."""
    return let(py_strip(raw_name_token(c)), lambda n: (
        F.when(n.startswith("**"), F.substring(n, 3, 2147483647))
        .when(n.startswith("*"), F.substring(n, 2, 2147483647))
        .otherwise(n)))


def align_name(text, old, new, whole_word: bool = False) -> Column:
    """Replace every occurrence of ``old`` by ``new``. An empty ``old``
    leaves the text unchanged (Python would insert ``new`` between chars).

    The original replaces substrings, so ``f`` also hits ``foo``; that
    defines the metric and is the default. ``whole_word=True`` replaces only
    whole identifiers (``old`` quoted, ``new`` taken literally)."""
    if not whole_word:
        return let(_c(old), lambda o: let(_c(text), lambda t: F.when(
            (o == "") | o.isNull(), t).otherwise(F.replace(t, o, _c(new)))))

    def word(t: Column, o: Column) -> Column:
        pattern = F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), F.replace(o, F.lit(r"\E"), F.lit(r"\E\\E\Q")),
                           F.lit(r"\E(?![A-Za-z0-9_])"))
        literal = F.replace(F.replace(_c(new), F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
        return F.when((o == "") | o.isNull(), t).otherwise(F.regexp_replace(t, pattern, literal))
    return let(_c(old), lambda o: let(_c(text), lambda t: word(t, o)))


def strip_fastcall(c) -> Column:
    """T21."""
    return F.replace(_c(c), F.lit("__fastcall"), F.lit(""))


# ---------------------------------------------------------------- prompts T22-T24

# Prompt texts.
ASM_HEAD = "# This is the assembly code:\n"
NORM_HEAD = "# This is the normalized code:\n"
PROMPT_TAIL = "\n# What is the source code?\n"
OPT_HEAD = "# This is the assembly code with {opt} optimization:\n"


def render_prompt(c, strip: bool = True, head: str = ASM_HEAD, opt=None) -> Column:
    """Head + text (stripped unless ``strip=False``) + tail. With ``opt``
    the head names the optimisation level."""
    body = py_strip(_c(c)) if strip else _c(c)
    if opt is not None:
        h = F.concat(F.lit("# This is the assembly code with "), _c(opt), F.lit(" optimization:\n"))
    else:
        h = F.lit(head)
    return F.concat(h, body, F.lit(PROMPT_TAIL))


def fill_template(template, src, dsrc) -> Column:
    """``[SRC]`` first, then ``[DSRC]`` (also inside the filled source)."""
    return F.replace(F.replace(_c(template), F.lit("[SRC]"), _c(src)), F.lit("[DSRC]"), _c(dsrc))


def remove_stop_sequences(c, stops: list[str]) -> Column:
    """Delete every stop string, in list order."""
    arr = F.array(*[F.lit(s) for s in stops]) if stops else F.array().cast("array<string>")
    return F.aggregate(arr, _c(c), lambda acc, s: F.replace(acc, s, F.lit("")))


# ---------------------------------------------------------------- T25, T26

# Fixed value.
JUDGE_KEY = "Code Readability Assessment"


def strip_fences(c) -> Column:
    return py_strip(F.replace(F.replace(py_strip(_c(c)), F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))


def is_one_object(t: Column) -> Column:
    """True if the text is one brace-balanced object with nothing after its
    closing brace (braces inside string literals do not count)."""
    braces = F.regexp_replace(F.regexp_replace(t, r'"(?:[^"\\]|\\.)*"', ""), "[^{}]", "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("closed"))
    walked = F.aggregate(F.filter(F.split(braces, ""), lambda b: b != ""), start, lambda acc, b: let(
        acc.depth + F.when(b == "{", 1).otherwise(-1),
        lambda d: F.struct(d.alias("depth"), (acc.closed + (d <= 0).cast("int")).alias("closed"))))
    return t.startswith("{") & t.endswith("}") & let(walked, lambda w: (w.depth == 0) & (w.closed == 1))


def judge_verdict(c, criterion: str = JUDGE_KEY) -> Column:
    """T25 + T26: ``struct<score, defaulted>``.

    The first of {text, text + '}', text without backslashes} (after fence
    removal) that is one valid JSON object is read; of a repeated key the
    last value counts. Score 1, marked as defaulted, when no candidate is
    valid, the criterion is missing, or its score is no number."""
    schema = f"`{criterion}` struct<score: string>, _corrupt string"

    def read(t: Column) -> Column:
        return F.when(is_one_object(t), let(
            F.from_json(t, schema, {"columnNameOfCorruptRecord": "_corrupt"}),
            lambda r: F.when(r["_corrupt"].isNull(), F.struct(r[criterion]["score"].alias("score")))))

    def pick(t: Column) -> Column:
        found = F.coalesce(read(t), read(F.concat(t, F.lit("}"))), read(F.replace(t, F.lit("\\"), F.lit(""))))
        return let(found.score.try_cast("double").cast("int"),
                   lambda n: F.struct(F.coalesce(n, F.lit(1)).alias("score"), n.isNull().alias("defaulted")))
    return let(strip_fences(c), pick)


def judge_score(c, criterion: str = JUDGE_KEY) -> Column:
    """The score alone."""
    return judge_verdict(c, criterion).score


# ---------------------------------------------------------------- T27-T31

def chat_piece(role, text, roles=("", "Human", "Assistant")) -> Column:
    """T27 per turn: role ``''`` gives ``<s>msg\\n\\n``; others ``Role: <s>msg</s>``
    or the open ``Role: <s>`` when the message is empty."""
    role, text = _c(role), _c(text)
    return (F.when(role == roles[0], F.concat(F.lit("<s>"), F.coalesce(text, F.lit("None")), F.lit("\n\n")))
            .when(text.isNull() | (text == ""), F.concat(role, F.lit(": <s>")))
            .otherwise(F.concat(role, F.lit(": <s>"), text, F.lit("</s>"))))


def human_count(n) -> Column:
    """``x.xx B`` / ``M`` / ``K`` (binary units) or the integer."""
    b, m, k = 1024 ** 3, 1024 ** 2, 1024

    def build(n: Column) -> Column:
        def fmt(unit: int, tag: str) -> Column:
            return F.concat(F.format_string("%.2f", F.bround(n.cast("double") / unit, 2)), F.lit(" " + tag))
        return (F.when(n >= b, fmt(b, "B")).when(n >= m, fmt(m, "M")).when(n >= k, fmt(k, "K"))
                .otherwise(n.cast("string")))
    return let(_c(n), build)


def result_file_name(index, opt, language) -> Column:
    """T29 build: ``{index}_{opt}.{language}``."""
    return F.concat(_c(index).cast("string"), F.lit("_"), _c(opt), F.lit("."), _c(language))


# Fixed value: any ``<int>_<label>.<language>`` file name.
RESULT_FILE = r"^(\d+)_([^.]*)\.(\w+)$"


def parse_result_file_name(name) -> Column:
    """T29 parse: ``struct<index, opt, language>``; NULL index when not a result file."""
    name = _c(name)
    return F.struct(
        F.when(name.rlike(RESULT_FILE), F.regexp_extract(name, RESULT_FILE, 1).cast("long")).alias("index"),
        F.regexp_extract(name, RESULT_FILE, 2).alias("opt"),
        F.regexp_extract(name, RESULT_FILE, 3).alias("language"))


def prepend_header(header, prediction) -> Column:
    """Header + prediction when the header is non-empty."""
    return F.concat(F.coalesce(_c(header), F.lit("")), _c(prediction))


def scorer_record(decompiler, func_name, code, stripped: bool = True,
                  compiler: str = "gcc", opt_level: str = "-O") -> Column:
    """The scorer's nested input record as a struct."""
    return F.struct(
        F.lit(stripped).alias("isStripped"), _c(decompiler).alias("decompilerName"),
        F.lit(compiler).alias("compilerName"), F.lit(opt_level).alias("optLevel"),
        F.array(F.struct(_c(func_name).alias("funcName"), _c(code).alias("decompiledFuncCode"))).alias("funcInfo"))
