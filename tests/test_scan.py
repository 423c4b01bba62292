"""Ordered scans, order statistics and size routing against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skytriage.operators.scan import medians, order_statistic, prefix_scan, ranked, split_by_size, suffix_max, with_blocks


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    # One key holds a third of all rows.
    data = [("hot" if i % 3 == 0 else f"k{i % 40}", i, rng.randint(0, 50), float(rng.randint(0, 30))) for i in range(900)]
    return data, spark.createDataFrame(data, "k string, i long, v long, x double").repartition(7)


def test_prefix_and_suffix(spark, rows):
    data, df = rows
    order = [F.desc("x"), F.col("i")]
    blocked = with_blocks(df, [F.col("k"), *order])
    assert blocked.select("_block").distinct().count() > 1
    got = prefix_scan(blocked, ["k"], order, sums={"s": F.col("v"), "n": F.lit(1)}, maxes={"m": F.col("v")})
    got = {r["i"]: r for r in suffix_max(got, ["k"], "n", "after", F.col("v")).collect()}
    for key in {d[0] for d in data}:
        mine = sorted((d for d in data if d[0] == key), key=lambda d: (-d[3], d[1]))
        for j, d in enumerate(mine):
            r = got[d[1]]
            assert r["s"] == sum(e[2] for e in mine[: j + 1]) and r["n"] == j + 1
            assert r["m"] == max(e[2] for e in mine[: j + 1]) and r["after"] == max(e[2] for e in mine[j:])


def test_global_rank(spark, rows):
    data, df = rows
    got = {r["i"]: r["position"] for r in ranked(df, [], [F.col("x"), F.col("i")]).collect()}
    for j, d in enumerate(sorted(data, key=lambda d: (d[3], d[1]))):
        assert got[d[1]] == j


def test_order_statistics_and_medians(spark, rows):
    data, df = rows
    upper = {r["k"]: r["m"] for r in order_statistic(df, ["k"], "x", {"m": F.floor(F.col("n") / 2)}).collect()}
    normal = {r["k"]: r["m"] for r in medians(df, ["k"], "x", "m").collect()}
    forced = {r["k"]: r["m"] for r in medians(df, ["k"], "x", "m", limit=20).collect()}
    for key in {d[0] for d in data}:
        xs = sorted(d[3] for d in data if d[0] == key)
        assert upper[key] == xs[len(xs) // 2]
        assert normal[key] == forced[key] == np.median(xs)


def test_split_by_size(spark, rows):
    data, df = rows
    small, large = split_by_size(df, ["k"], 100)
    assert {r["k"] for r in large.select("k").distinct().collect()} == {"hot"}
    assert small.count() + large.count() == len(data)
    assert split_by_size(df, ["k"], 1000)[1] is None
