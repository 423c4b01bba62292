"""Keyed permutations of 0..n-1 that every row computes for itself."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

_ROUNDS = 6
#: Steps out of range after which a walk is given up; with ``n`` numbers one step stays out with a chance of 1 / sqrt(n) at most.
_WALK = 64


def shuffled(i: Column, n: int, key: Column) -> Column:
    """Where a permutation of 0..n-1 chosen by ``key`` sends ``i``.

    A Feistel network over pairs (left, right) with a x b >= n > (a - 1) x b pairs: every
    round adds a hash of one half to the other, which can be undone, so the network permutes
    the pairs. A number that lands at n or above goes through again until it is back in range.
    """
    b = max(1, math.isqrt(max(n - 1, 0)) + 1)
    a = max(1, -(-n // b))

    def network(x: Column) -> Column:
        half = F.struct(F.call_function("div", x, F.lit(b)).alias("l"), (x % b).cast("bigint").alias("r"))

        def turn(acc: Column, k: Column) -> Column:
            left = F.pmod(acc["l"] + F.pmod(F.xxhash64(key, k, acc["r"]), F.lit(a)), F.lit(a)).cast("bigint")
            right = F.pmod(acc["r"] + F.pmod(F.xxhash64(key, -k, left), F.lit(b)), F.lit(b)).cast("bigint")
            return F.struct(left.alias("l"), right.alias("r"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(_ROUNDS)), half, turn, lambda s: s["l"] * b + s["r"])

    over = a * b - n  # the pairs that stand for no number; a walk meets each at most once
    first = network(i.cast("bigint"))
    if over == 0:
        return first
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(min(over, _WALK))), first, lambda x, _: F.when(x < n, x).otherwise(network(x)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("a walk of the permutation did not come back")).cast("bigint"))
