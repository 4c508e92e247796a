"""Token-array functions (R1, R3-R8) and the regex tokenizer of R2.

All are Column expressions over ``array<int>``; padding widths come from
columns (a batch maximum computed by a window over the batch key).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import let

IGNORE_INDEX = -100
PAD_ID = 0
EOS_ID = 1
FIRST_TOKEN_ID = 2
EOS_TOKEN = "<|EOT|>"

# Fixed value: tokens are the end marker, runs of word characters, or any
# other single non-space character.
TOKEN_PATTERN = r"<\|EOT\|>|[A-Za-z0-9_]+|[^A-Za-z0-9_\t\n\x0b\x0c\r ]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text) -> Column:
    """Regex tokens of a text, in order."""
    return F.regexp_extract_all(_c(text), F.lit(TOKEN_PATTERN), 0)


def with_end_marker(source, output) -> Column:
    """``source + output + "\\n" + eos``."""
    return F.concat(_c(source), _c(output), F.lit("\n" + EOS_TOKEN))


def truncate(ids, max_length: int) -> Column:
    """R5."""
    return F.slice(_c(ids), 1, max_length)


def non_pad_length(ids, pad: int = PAD_ID) -> Column:
    """Ids different from the pad id."""
    return F.size(F.filter(_c(ids), lambda x: x != pad))


def mask_prompt(ids, source_len) -> Column:
    """The first ``source_len`` labels become -100."""
    def build(ids: Column) -> Column:
        n = F.least(_c(source_len), F.size(ids))
        return F.concat(F.array_repeat(F.lit(IGNORE_INDEX), n),
                        F.slice(ids, n + 1, F.greatest(F.size(ids) - n, F.lit(0))))
    return let(_c(ids), build)


def pad_right(ids, width, value: int) -> Column:
    """R6/R7 right padding up to ``width``."""
    return let(_c(ids), lambda a: F.concat(a, F.array_repeat(F.lit(value), F.greatest(_c(width) - F.size(a), F.lit(0)))))


def pad_left(ids, width, value: int) -> Column:
    """R7 left padding up to ``width``."""
    return let(_c(ids), lambda a: F.concat(F.array_repeat(F.lit(value), F.greatest(_c(width) - F.size(a), F.lit(0))), a))


def attention_mask(ids, pad: int = PAD_ID) -> Column:
    """``ids != pad`` (also masks eos when pad == eos)."""
    return F.transform(_c(ids), lambda x: x != pad)
