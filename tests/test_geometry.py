"""Box arithmetic, buckets, rounding and small statistics."""

import math
import random

import pytest
from pyspark.sql import functions as F

from skytriage.functions import geometry as g
from skytriage.functions.numeric import chance_separation, poisson_interval, round_py, wilson
from skytriage.operators.association import best_pairs, pairwise_affinity


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def box(*v):
    return g.Box(*[F.lit(float(x)) for x in v])


def test_round_trips(spark):
    rng = random.Random(1)
    data = [(rng.uniform(0, 900), rng.uniform(0, 900), rng.uniform(1, 90), rng.uniform(1, 90)) for _ in range(50)]
    df = spark.createDataFrame([(x, y, x + w, y + h) for x, y, w, h in data], "x1 double, y1 double, x2 double, y2 double")
    b = g.corners()
    back = [g.xywh_to_xyxy(g.xyxy_to_xywh(b)), g.cxcywh_to_xyxy(g.xyxy_to_cxcywh(b)), g.denormalise(g.normalise(b, 1920, 1080), 1920, 1080),
            g.tile_to_frame(g.frame_to_tile(b, F.lit(7), F.lit(9)), F.lit(7), F.lit(9))]
    for r in df.select("*", *[F.array(*x).alias(f"t{i}") for i, x in enumerate(back)]).collect():
        for i in range(4):
            assert r[f"t{i}"] == pytest.approx([r.x1, r.y1, r.x2, r.y2])


@pytest.mark.parametrize("side,name", [(7.999, "<8px"), (8, "8-16px"), (15.99, "8-16px"), (16, "16-32px"), (32, ">32px"), (31.99, "16-32px")])
def test_bucket_edges(spark, side, name):
    assert one(spark, g.size_bucket(g.pixels_on_target(box(0, 0, side, side))).alias("b")).b == name


def test_iou_and_validity(spark):
    r = one(spark, g.iou(box(0, 0, 10, 10), box(5, 0, 15, 10)).alias("a"), g.iou(box(0, 0, 1, 1), box(2, 2, 3, 3)).alias("b"),
            g.is_valid(box(0, 0, 0, 5)).alias("flat"), g.is_valid(box(0, 0, math.inf, 5)).alias("inf"), g.is_valid(box(0, 0, 1, 1)).alias("ok"))
    assert r.a == pytest.approx(1 / 3) and r.b == 0 and not r.flat and not r.inf and r.ok
    with pytest.raises(Exception, match="invalid box"):
        one(spark, g.checked(box(3, 0, 1, 5)).a)
    with pytest.raises(Exception, match="must be positive"):
        one(spark, g.normalise(box(0, 0, 1, 1), 0, 5).a)


@pytest.mark.parametrize("side,limit", [(50, 26.9), (20, 10.8), (10, 5.4)])
def test_overlap_reaches_only_so_far(spark, side, limit):
    # Displacement at which IoU falls to 0.3: side * (1 - t) / (1 + t).
    near, far = limit - 0.06, limit + 0.06
    r = one(spark, g.iou(box(0, 0, side, side), box(near, 0, near + side, side)).alias("n"), g.iou(box(0, 0, side, side), box(far, 0, far + side, side)).alias("f"))
    assert r.n > 0.3 > r.f


def test_affinity_agrees_with_arrays(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    a, b = rng.uniform(0, 60, (20, 4)), rng.uniform(0, 60, (20, 4))
    a[:, 2:] = a[:, :2] + 4 + a[:, 2:] / 4
    b[:, 2:] = b[:, :2] + 4 + b[:, 2:] / 4
    want = pairwise_affinity(a, b, 0.3, 2.0)
    df = spark.createDataFrame([(*map(float, p), *map(float, q), float(w)) for i, p in enumerate(a) for q, w in zip(b, want[i])],
                               "a1 double,a2 double,a3 double,a4 double,b1 double,b2 double,b3 double,b4 double,w double")
    cols = [F.col(f"{s}{i}") for s in "ab" for i in range(1, 5)]
    got = g.affinity(g.Box(*cols[:4]), g.Box(*cols[4:]))
    assert df.where(F.abs(got - F.col("w")) > 1e-12).count() == 0


def test_best_pairs_is_optimal():
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(60):
        w = np.where(rng.random((rng.integers(1, 5), rng.integers(1, 5))) < 0.7, rng.random(), 0) * rng.random()
        w = np.where(w > 0, rng.random(w.shape), 0)
        n, m = w.shape
        best = max(sum(w[i, c] for i, c in enumerate(p) if c < m) for p in itertools.permutations(range(m + n), n))
        pairs = best_pairs(w)
        assert sum(w[i, j] for i, j in pairs) == pytest.approx(best)
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)


def test_round_matches_python(spark):
    rng = random.Random(9)
    values = [2.675, 0.3496, 1.996, 0.5, 1.5, 2.5, -2.675, -0.125, 0.125, 1e-9, 1.005] + [rng.uniform(-50, 50) for _ in range(300)] + [rng.randint(0, 9999) / 8 for _ in range(100)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for d in (0, 1, 2, 3, 4, 5):
        for r in df.select("v", round_py(F.col("v"), d).alias("r")).collect():
            assert r.r == round(r.v, d), (r.v, d)


def test_intervals(spark):
    df = spark.createDataFrame([(0,), (1,), (5,), (100,), (2500,)], "n long")
    got = {r.n: r.c for r in df.select("n", poisson_interval(F.col("n")).alias("c")).collect()}
    # Tabulated exact bounds.
    assert got[0].low == 0 and got[0].high == pytest.approx(3.688879, abs=1e-5)
    assert got[1].low == pytest.approx(0.025318, abs=1e-5) and got[1].high == pytest.approx(5.571643, abs=1e-5)
    assert got[5].low == pytest.approx(1.623486, abs=1e-5) and got[5].high == pytest.approx(11.668332, abs=1e-5)
    assert got[100].low == pytest.approx(81.3639, abs=1e-3) and got[100].high == pytest.approx(121.6272, abs=1e-3)
    assert 2400 < got[2500].low < 2403 and 2599 < got[2500].high < 2602
    w = one(spark, wilson(F.lit(0), F.lit(0)).alias("none"), wilson(F.lit(8), F.lit(10)).alias("some"))
    assert (w.none.low, w.none.high) == (0, 1) and w.some.low == pytest.approx(0.4901, abs=1e-3) and w.some.high == pytest.approx(0.9433, abs=1e-3)
    with pytest.raises(Exception, match="within the trials"):
        one(spark, wilson(F.lit(11), F.lit(10)).alias("w"))


def test_chance(spark):
    # Class sizes 3, 5 and 2 over nine features: 2.98 separations from noise alone.
    pairs = [(3, 5), (3, 2), (5, 2)]
    r = one(spark, *[chance_separation(F.lit(a), F.lit(b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)], chance_separation(F.lit(0), F.lit(4)).alias("none"))
    assert 9 * (r.p0 + r.p1 + r.p2) == pytest.approx(2.98, abs=0.005) and r.none == 1
