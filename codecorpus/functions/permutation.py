"""A seeded permutation of 0..n-1 as arithmetic.

A Feistel network over pairs (left, right) with left in 0..a-1 and right in
0..b-1, where a * b is the smallest such product of about equal factors that
reaches n. Every round adds a hash of one half to the other, so it can be
undone. A value that lands at n or beyond is put through again (cycle
walking) until it falls below n; a * b exceeds n by less than a, so that is
rare. Neither direction sorts or exchanges anything.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import let

ROUNDS = 6
#: More walks than this have a probability below 1e-100 for any n.
MAX_WALKS = 64

#: (half, seed, epoch, round) -> non-negative long
RoundHash = Callable[[Column, int, int, int], Column]


def hash_round(half: Column, seed: int, epoch: int, k: int) -> Column:
    return F.xxhash64(half, F.lit(seed), F.lit(epoch), F.lit(k)).bitwiseAND(0x7FFFFFFFFFFFFFFF)


def md5_round(half: Column, seed: int, epoch: int, k: int) -> Column:
    """The same from MD5, for engines without xxhash64."""
    text = F.concat_ws(":", half.cast("string"), F.lit(f"{seed}:{epoch}:{k}"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def halves(n: int) -> tuple[int, int]:
    a = math.isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def _step(left: Column, right: Column, k: int, sign: int, n: int, seed: int, epoch: int, h: RoundHash) -> tuple[Column, Column]:
    a, b = halves(n)
    if k % 2 == 0:
        return F.pmod(left + sign * (h(right, seed, epoch, k) % a), F.lit(a)), right
    return left, F.pmod(right + sign * (h(left, seed, epoch, k) % b), F.lit(b))


def _once(x: Column, n: int, seed: int, epoch: int, h: RoundHash, back: bool) -> Column:
    _, b = halves(n)
    state = F.struct(F.call_function("div", x, F.lit(b)).alias("l"), (x % b).alias("r"))
    order = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)

    def through(s: Column, ks: list[int]) -> Column:
        if not ks:
            return s["l"] * b + s["r"]
        left, right = _step(s["l"], s["r"], ks[0], -1 if back else 1, n, seed, epoch, h)
        return let(F.struct(left.alias("l"), right.alias("r")), lambda t: through(t, ks[1:]))
    return let(state, lambda s: through(s, list(order)))


def _walk(x: Column, n: int, seed: int, epoch: int, h: RoundHash, back: bool) -> Column:
    x = x.cast("long")
    first = _once(x, n, seed, epoch, h, back)
    a, b = halves(n)
    if a * b <= n:
        return first
    again = F.aggregate(F.sequence(F.lit(1), F.lit(min(MAX_WALKS, a * b - n))), first, lambda y, _: F.when(
        y < n, y).otherwise(_once(y, n, seed, epoch, h, back)))
    lost = F.raise_error(F.lit("cycle walk did not end")).cast("long")
    return let(again, lambda y: F.when(y < n, y).otherwise(lost))


def permuted(index: Column, n: int, seed: int, epoch: int, h: RoundHash = hash_round) -> Column:
    """Place of row ``index`` (0..n-1) in the seeded order of this epoch."""
    return _walk(index, n, seed, epoch, h, False)


def unpermuted(place: Column, n: int, seed: int, epoch: int, h: RoundHash = hash_round) -> Column:
    """Row at a place of the order: undoes ``permuted``."""
    return _walk(place, n, seed, epoch, h, True)
