"""DuckDB SQL fragments for the oracle queries.

They restate the stand-ins and text rules independently in plain SQL (RE2
regexes, list lambdas) so the Spark plans are checked against a second
engine. Only the edit-similarity pair is ASCII-folded (DuckDB counts bytes
there); the other texts are compared as they are.
"""

FOLD = "regexp_replace({x}, '[^\\x00-\\x7F]', '?', 'g')"
WS = "[\\t\\n\\x0b\\x0c\\r\\x1c-\\x1f ]"
LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e]"


def fold(x: str) -> str:
    return FOLD.format(x=x)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def strip_all(x: str) -> str:
    """``strip`` with all of Python's white space, also beyond ASCII."""
    ws = "[\\t\\n\\x0b\\x0c\\r\\x1c-\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
    return f"regexp_replace({x}, '^{ws}+|{ws}+$', '', 'g')"


def splitlines(x: str) -> str:
    """Python splitlines; a trailing empty piece is dropped."""
    parts = f"string_split_regex({x}, '{LINE_BREAK}')"
    return (f"(CASE WHEN {parts}[-1] = '' THEN {parts}[1:len({parts}) - 1] ELSE {parts} END)")


def join_lines(lst: str) -> str:
    return f"coalesce(array_to_string({lst}, chr(10)), '')"


def canonical(x: str) -> str:
    """T8."""
    return join_lines(f"list_filter(list_transform({splitlines(x)}, lambda l: {strip('l')}), lambda l: l <> '')")


def strip_empty(x: str) -> str:
    """T3."""
    return join_lines(f"list_filter({splitlines(x)}, lambda l: regexp_matches(l, '[^\\t\\n\\x0b\\x0c\\r\\x1c-\\x1f ]'))")


def edit_sim(a: str, b: str) -> str:
    """T9 over already canonical texts."""
    return (f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 "
            f"ELSE 1.0 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END")


SAMPLES = f"""samples AS (
  SELECT doc_id AS sample_id, 'func' || CAST(doc_id AS VARCHAR) AS func_name,
         text AS func, 'O' || CAST(doc_id % 4 AS VARCHAR) AS opt,
         lang AS language, source AS dataset
  FROM documents)"""

PREDICTIONS = f"""predictions AS (
  SELECT doc_id - 4 AS sample_id, 'next4' AS decompiler, text AS prediction
  FROM documents)"""

VERDICTS = """verdicts AS (
  SELECT doc_id AS sample_id, 0 AS repeat_no, quality AS flag_compile,
         quality * (1 - toxic) AS flag_run
  FROM labels)"""

REPEAT_VERDICTS = """repeat_verdicts AS (
  SELECT l_orderkey AS sample_id, 'O' || CAST(l_orderkey % 4 AS VARCHAR) AS opt,
         l_linenumber AS repeat_no, CAST(l_returnflag <> 'R' AS INTEGER) AS flag_compile,
         CAST(l_returnflag = 'A' AS INTEGER) AS flag_run
  FROM lineitem)"""

SCORED = f"""scored AS (
  SELECT s.sample_id, s.opt, s.dataset, s.language, p.sample_id IS NOT NULL AS matched,
         {canonical(fold('s.func'))} AS a, {canonical(fold("coalesce(p.prediction, '')"))} AS b
  FROM samples s LEFT JOIN predictions p ON s.sample_id = p.sample_id),
similarity AS (
  SELECT sample_id, opt, dataset, language, matched, {edit_sim('a', 'b')} AS edit_sim FROM scored)"""

NATIVE = """native AS (
  SELECT sample_id, func_name, func, opt, language, dataset,
         upper({fold}) AS ida_pseudo, lower({fold}) AS ghidra_pseudo
  FROM samples)""".format(fold=fold("func"))
