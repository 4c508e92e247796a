"""Regex helpers that keep Python ``re`` semantics on the JVM.

Spark has no function-valued ``regexp_replace``. ``sub_with`` rebuilds one
from built-ins: the text is split on the pattern and every match is
extracted, both by the same java.util.regex engine scanning left to right,
so piece ``i`` is followed by match ``i``. ``zip_with`` pairs them, the
caller's Column function rewrites each match, ``array_join`` glues the
result. Everything stays in JVM expressions (no Python per row).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's ``str.isspace`` accepts (what
# ``str.strip()`` removes) and the line boundaries ``str.splitlines`` uses.
# java.util.regex tests a list of characters beyond Latin-1 one by one, about
# a microsecond for each character of the text; the property is one lookup.
PY_SPACE_CLASS = r"[\x1c-\x1f\p{IsWhite_Space}]"
PY_LINE_BREAK = r"\r\n|[\x1c-\x1e\v]"


def _lit(p: str | Column) -> Column:
    return p if isinstance(p, Column) else F.lit(p)


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and pass it to ``fn`` as a lambda variable.

    Composite functions use an argument several times; without this, nested
    composites would copy (and re-evaluate) their argument expression trees
    at every level. ``transform`` over a one-element array binds the value.
    """
    return F.element_at(F.transform(F.array(value), fn), 1)


def sub_with(text: Column, pattern: str, fn: Callable[[Column], Column]) -> Column:
    """``re.sub(pattern, lambda m: fn(m.group(0)), text)`` as a Column.

    ``pattern`` must not match the empty string. ``fn`` receives the whole
    match as a string Column and returns the replacement Column.
    """
    def body(t: Column) -> Column:
        pieces = F.split(t, pattern, -1)
        tokens = F.regexp_extract_all(t, _lit(pattern), 0)
        joined = F.zip_with(
            pieces, tokens,
            lambda piece, tok: F.concat(piece, F.when(tok.isNull(), F.lit("")).otherwise(
                F.coalesce(fn(tok), F.lit("")))))
        return F.when(t.isNull(), F.lit(None).cast("string")).otherwise(F.array_join(joined, ""))
    return let(text, body)


# The same characters as a plain string, for ``btrim``.
PY_SPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
                  + "\u2028\u2029\u202f\u205f\u3000")


def py_strip(c: Column) -> Column:
    """Python ``str.strip()``: ``btrim`` with Python's whitespace set (plain
    ``trim`` removes spaces only; a regex would rescan every inner run)."""
    return F.call_function("btrim", c, F.lit(PY_SPACE_CHARS))


def py_splitlines(c: Column) -> Column:
    """Python ``str.splitlines()``: all its line breaks, no trailing empty piece."""
    return let(F.split(c, PY_LINE_BREAK, -1), lambda parts: F.when(
        F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))
