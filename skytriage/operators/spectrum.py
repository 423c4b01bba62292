"""Spectrum of very long series, spread over many tasks.

A series of any length n becomes a convolution with a chirp (Bluestein), whose length is
padded to a product of two near-equal factors; each of the two steps of the resulting
transform works on short columns, grouped by (track, column). No task holds more than
one column, i.e. about the square root of the series.
"""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from skytriage.session import durable


def _columns_fft(df: DataFrame, keys: list[str], by: str, along: str, length: int, inverse: bool) -> DataFrame:
    """FFT of length ``length`` along ``along`` for every value of ``by``."""
    names = [*keys, by, along, "re", "im"]
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"`{n}` {types[n]}" for n in names)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.zeros(length, dtype=np.complex128)
        z[pdf[along].to_numpy()] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        z = np.fft.ifft(z) * length if inverse else np.fft.fft(z)
        out = {k: np.repeat(pdf[k].to_numpy()[:1], length) for k in (*keys, by)}
        return pd.DataFrame(out | {along: np.arange(length), "re": z.real, "im": z.imag})[names]

    return df.select(*names).groupBy(*keys, by).applyInPandas(run, schema)


def _fft(df: DataFrame, keys: list[str], a: int, b: int, inverse: bool) -> DataFrame:
    """Transform of length a*b of rows (keys, i, re, im), i in [0, a*b)."""
    sign = 1.0 if inverse else -1.0
    cols = df.withColumn("r", F.floor(F.col("i") / b)).withColumn("c", F.col("i") % b)
    first = _columns_fft(cols, keys, "c", "r", a, inverse)
    angle = sign * 2 * math.pi * ((F.col("r") * F.col("c")) % (a * b)).cast("double") / float(a * b)
    turned = first.select(
        *keys, "r", "c",
        (F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle)).alias("re"),
        (F.col("re") * F.sin(angle) + F.col("im") * F.cos(angle)).alias("im"))
    second = _columns_fft(turned, keys, "r", "c", b, inverse)
    return second.select(*keys, (F.col("c") * a + F.col("r")).alias("i"), "re", "im")


def distributed_spectrum(series: DataFrame, rates: DataFrame, keys: list[str]) -> DataFrame:
    """Per key ``_spectrum`` = struct(hz, power), from rows (keys, frame, cy).

    ``rates`` has one row per key with ``_fps``. The keys are processed one by one only in
    the sense that they are grouped by their padded length; each group is one set of jobs.
    """
    t0 = series.groupBy(*keys).agg(F.min("frame").alias("_lo"), F.count("*").alias("_n"))
    at = series.join(t0, keys).withColumn("t", F.col("frame") - F.col("_lo"))
    mean_t = (F.col("_n") - 1) / 2.0
    line = at.groupBy(*keys).agg(
        F.avg("cy").alias("_mean"),
        (F.sum((F.col("t") - mean_t) * F.col("cy")) / F.sum((F.col("t") - mean_t) * (F.col("t") - mean_t))).alias("_slope"))
    rest = at.join(line, keys).withColumn(
        "v", F.col("cy") - F.col("_mean") - F.col("_slope") * (F.col("t") - mean_t))
    hann = 0.5 - 0.5 * F.cos(2 * math.pi * F.col("t") / (F.col("_n") - 1))
    windowed = durable(rest.select(*keys, "t", "_n", "v", (F.col("v") * hann).alias("w")))
    flat = windowed.groupBy(*keys).agg((F.max(F.abs("v")) <= 1e-8).alias("_flat"))
    # Powers of four are the only padded lengths, so there are at most ~20 distinct ones.
    side = F.pow(F.lit(2.0), F.ceil(F.log2((2 * F.col("_n")).cast("double")) / 2)).cast("long")
    sized = windowed.withColumn("_side", side)
    parts = []
    for row in sized.select("_side").distinct().collect():
        parts.append(_group_spectrum(sized.where(F.col("_side") == row["_side"]), keys, int(row["_side"])))
    bins = parts[0]
    for p in parts[1:]:
        bins = bins.unionByName(p)
    best = bins.groupBy(*keys).agg(
        F.max(F.struct("power", (-F.col("k")).alias("nk"))).alias("m"), F.sum("power").alias("total"),
        F.max("_n").alias("_n"))
    hz = -F.col("m.nk") * F.col("_fps") / F.col("_n")
    zero = F.col("_flat") | (F.col("total") <= 0)
    return best.join(rates, keys).join(flat, keys).select(*keys, F.struct(
        F.when(F.col("_flat"), 0.0).otherwise(hz).alias("hz"),
        F.when(zero, 0.0).otherwise(F.col("m.power") / F.col("total")).alias("power")).alias("_spectrum"))


def _chirp(t, n, sign: float):
    # t*t mod 2n is taken on whole numbers, so the angle keeps its precision.
    angle = sign * math.pi * ((t * t) % (2 * n)).cast("double") / n
    return F.cos(angle), F.sin(angle)


def _group_spectrum(df: DataFrame, keys: list[str], side: int) -> DataFrame:
    size = side * side
    cos, sin = _chirp(F.col("t"), F.col("_n"), -1.0)
    x = df.select(*keys, F.col("t").alias("i"), (F.col("w") * cos).alias("re"), (F.col("w") * sin).alias("im"))
    kc, ks = _chirp(F.col("t"), F.col("_n"), 1.0)
    kernel = df.select(*keys, "t", kc.alias("re"), ks.alias("im"))
    kernel = kernel.select(*keys, F.col("t").alias("i"), "re", "im").unionByName(
        kernel.where("t > 0").select(*keys, (F.lit(size) - F.col("t")).alias("i"), "re", "im"))
    fx = durable(_fft(x, keys, side, side, inverse=False))
    fk = _fft(kernel, keys, side, side, inverse=False).withColumnsRenamed({"re": "kr", "im": "ki"})
    product = durable(fx.join(fk, [*keys, "i"]).select(
        *keys, "i", (F.col("re") * F.col("kr") - F.col("im") * F.col("ki")).alias("re"),
        (F.col("re") * F.col("ki") + F.col("im") * F.col("kr")).alias("im")))
    back = _fft(product, keys, side, side, inverse=True)
    lengths = df.groupBy(*keys).agg(F.max("_n").alias("_n"))
    scale = float(size) * float(size)
    return (
        back.join(lengths, keys).where((F.col("i") >= 1) & (F.col("i") <= F.floor(F.col("_n") / 2)))
        .select(*keys, F.col("i").alias("k"), "_n",
                ((F.col("re") * F.col("re") + F.col("im") * F.col("im")) / scale).alias("power")))
