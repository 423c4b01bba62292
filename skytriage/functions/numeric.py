"""Rounding, intervals and small combinatorics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from skytriage.constants import Z_95


def round_py(value: Column, digits: int) -> Column:
    """Round the exact binary value to ``digits`` decimals, true ties to even.

    Spark rounds the decimal text instead, which turns 2.675 into 2.68 although the
    number stored is below the tie. Here the value is split into two parts short enough
    that scaling each is exact, so a product that looks like a tie is decided by the sign
    of what rounding the product lost. Good for up to 5 digits. For a row of many values take
    :func:`round_all`.
    """
    return _rounded(value, F.lit(float(10**digits)))


def _rounded(value: Column, scale: Column) -> Column:
    head = value.cast("float").cast("double")
    product = value * scale
    lost = (head * scale - product) + (value - head) * scale
    nearest = F.rint(product)
    off = nearest - product
    # The number on the other side of a tie, if the exact product lies there.
    rounded = F.when((F.abs(off) == 0.5) & (off * lost < 0), 2 * product - nearest).otherwise(nearest) / scale
    # From 2**53 on the scaled value is a whole number already.
    return F.when(F.abs(product) < float(2**53), rounded).otherwise(value)


def round_all(values: list[tuple[Column, int]]) -> Column:
    """Array of the ``(value, digits)`` given, each rounded like :func:`round_py`.

    One function goes over all of them: written out for each, a row of measures makes a method
    too long for the JVM to compile, and it is interpreted for every row.
    """
    scales = F.array(*[F.lit(float(10**d)) for _, d in values])
    return F.zip_with(F.array(*[v.cast("double") for v, _ in values]), scales, _rounded)


def fixed(value: Column, digits: int) -> Column:
    """Decimal text with ``digits`` places, rounded like :func:`round_py`."""
    return F.format_string(f"%.{digits}f", round_py(value, digits))


def wilson(successes: Column, trials: Column, z: float = Z_95) -> Column:
    """Score interval for a proportion as ``struct(low, high)``; (0, 1) without trials.

    Counts that no trials can give (below 0, or more successes than trials) stop the job.
    """
    impossible = F.raise_error(F.concat(F.lit("successes must be within the trials: "), successes.cast("string"), F.lit(" of "), trials.cast("string"))).cast("double")
    n = trials.cast("double")
    p = successes.cast("double") / n
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    margin = (z / scale) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low = F.when(trials <= 0, 0.0).when((successes < 0) | (successes > trials), impossible).when(trials > 0, F.greatest(F.lit(0.0), centre - margin)).otherwise(0.0)
    high = F.when(trials > 0, F.least(F.lit(1.0), centre + margin)).otherwise(1.0)
    return F.struct(low.alias("low"), high.alias("high"))


def chance_separation(n_a: Column, n_b: Column) -> Column:
    """Probability that two samples of one distribution have disjoint ranges.

    2 / C(a+b, a), built as a running product of small quotients so that it never
    overflows; a class without members gives 1. The product runs over the smaller
    class. No factor is above 1/2, so after 1100 of them a double holds zero for good.
    """
    small = F.least(n_a, n_b)
    big = F.greatest(n_a, n_b)
    steps = F.sequence(F.lit(1), F.greatest(F.least(small, F.lit(1100)), F.lit(1)).cast("int"))
    product = F.aggregate(
        steps, F.lit(2.0),
        lambda acc, i: acc * i.cast("double") / (big.cast("double") + i.cast("double")))
    return F.when(small < 1, F.lit(1.0)).otherwise(product)


def _log_gamma(x: Column) -> Column:
    """Stirling series after shifting the argument above 10; good to about 1e-13."""
    shift = F.greatest(F.lit(0), F.ceil(F.lit(10.0) - x)).cast("int")
    lowered = F.when(shift > 0, F.aggregate(
        F.sequence(F.lit(0), F.greatest(shift - 1, F.lit(0))), F.lit(0.0),
        lambda acc, i: acc + F.log(x + i.cast("double")))).otherwise(0.0)
    y = x + shift.cast("double")
    inv = F.lit(1.0) / y
    series = inv / 12 - inv * inv * inv / 360 + F.pow(inv, F.lit(5)) / 1260 - F.pow(inv, F.lit(7)) / 1680
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - lowered


def _cube_root_quantile(shape: Column, prob: float) -> Column:
    z = Z_95 if prob > 0.5 else -Z_95
    return shape * F.pow(1 - 1 / (9 * shape) + z / (3 * F.sqrt(shape)), F.lit(3))


def _gamma_quantile(shape: Column, prob: float) -> Column:
    """x with P(shape, x) = prob: a cube-root start polished by Halley steps.

    P comes from its power series. The terms fall off once their index passes a few
    standard deviations, so their number follows the square root of the shape.
    """
    ln_norm = _log_gamma(shape)
    terms = F.sequence(F.lit(1), (60 + 14 * F.sqrt(shape)).cast("int"))

    def lower_tail(x: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            term = acc["term"] * x / (shape + i.cast("double"))
            return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

        first = F.struct((1 / shape).alias("term"), (1 / shape).alias("total"))
        return F.exp(-x + shape * F.log(x) - ln_norm) * F.aggregate(terms, first, add, lambda a: a["total"])

    def polish(x: Column, _i: Column) -> Column:
        density = F.exp((shape - 1) * F.log(x) - x - ln_norm)
        err = (lower_tail(x) - prob) / density
        step = err / (1 - F.least(F.lit(1.0), err * ((shape - 1) / x - 1)) / 2)
        return F.greatest(x - step, x / 2)

    return F.aggregate(F.sequence(F.lit(1), F.lit(4)), F.greatest(_cube_root_quantile(shape, prob), F.lit(1e-3)), polish)


def poisson_interval(count: Column) -> Column:
    """Exact 95% (Garwood) interval on a Poisson count as ``struct(low, high)``.

    The chi-square quantile with 2k degrees of freedom is twice the gamma quantile of
    shape k, so the bounds are gamma quantiles of shape n and n + 1. The work per count
    follows its square root.
    """
    n = count.cast("double")

    def bound(shape: Column, prob: float) -> Column:
        return _gamma_quantile(F.greatest(shape, F.lit(1.0)), prob)

    low = F.when(count == 0, F.lit(0.0)).otherwise(bound(n, 0.025))
    high = bound(n + 1, 0.975)
    return F.struct(low.alias("low"), high.alias("high"))
