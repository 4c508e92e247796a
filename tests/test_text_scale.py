"""Text rules that run over every character: one regex pass, same results."""
from codecorpus.functions import text as T
from codecorpus.functions.regex import PY_SPACE_CLASS
from conftest import col_values

ODD = ["", " ", "\n", "\r\n", " \n ", "a", "  a", "a\n", "\n\n  a \n \t\r\n\x1c b\x85  　\n", "a\r\n\r\nb",
       " \n\x0bx\x0c\x1d y \x1e\x1f\n ", "​\n﻿\n᠎", None]


def _strip_empty(t):
    return None if t is None else "\n".join(ln for ln in t.splitlines() if ln.strip())


def _good(t):
    body = t.partition("{")[2]
    return 3 < sum(len(ln.strip()) >= 3 for ln in body.split("\n")) < 300


def test_space_class_is_pythons(spark):
    points = [chr(i) for i in range(1, 0x10000) if not 0xD800 <= i <= 0xDFFF]
    got = col_values(spark, points, lambda c: c.rlike(f"^{PY_SPACE_CLASS}$"), "string")
    assert [p for p, g in zip(points, got) if g] == [p for p in points if p.isspace()]
    assert r"\u" not in PY_SPACE_CLASS  # listed characters beyond Latin-1 are tested one by one


def test_blank_lines_go_without_a_lambda_per_line(spark):
    df = spark.createDataFrame([(v,) for v in ODD], "c string").select(T.strip_empty("c").alias("x"))
    assert [r[0] for r in df.collect()] == [_strip_empty(v) for v in ODD]
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_counted_lines(spark):
    texts = ["{" + "\n".join(n * [ln]) for n in (3, 4, 299, 300)
             for ln in (" abc ", "ab", "a b", "a  ", "　 a\x1fb\x85", "\U0001f600x\U0001f600", "}")]
    assert col_values(spark, texts, T.good_func) == [_good(t) for t in texts]
