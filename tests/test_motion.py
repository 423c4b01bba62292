"""Features against NumPy, the long-track path against the usual one, known trajectories."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skytriage.operators.features import spectrum_of, track_features, track_summary

OBS = "track_id string, frame_index long, x1 double, y1 double, x2 double, y2 double"


def obs_of(spark, tracks):
    rows = [(t, f, cx - s / 2, cy - s / 2, cx + s / 2, cy + s / 2) for t, pts in tracks.items() for f, cx, cy, s in pts]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, OBS)


def walk(seed, n, gaps=True):
    rng = random.Random(seed)
    f, x, y, out = rng.randint(0, 9), 100.0, 100.0, []
    for _ in range(n):
        out.append((f, x, y, 10 + rng.random()))
        f += rng.choice([1, 1, 2, 5]) if gaps else 1
        x, y = x + rng.uniform(-1, 3), y + rng.uniform(-2, 2)
    return out


def reference(pts, fps):
    f = np.array([p[0] for p in pts], float)
    c = np.array([p[1:3] for p in pts])
    px = np.array([p[3] for p in pts])
    dt = np.diff(f)
    v = np.diff(c, axis=0) / dt[:, None]
    speed = np.hypot(*v.T)
    acc = np.diff(v, axis=0) / ((dt[:-1] + dt[1:]) / 2)[:, None]
    moving = speed > 1e-9
    h = np.histogram(np.arctan2(v[moving, 1], v[moving, 0]), bins=8, range=(-np.pi, np.pi))[0]
    p = h[h > 0] / h.sum() if moving.sum() >= 2 else np.array([1.0])
    grid = np.arange(f[0], f[-1] + 1)
    y = np.interp(grid, f, c[:, 1])
    y = (y - np.polyval(np.polyfit(grid, y, 1), grid)) * np.hanning(len(grid))
    s = np.abs(np.fft.rfft(y)) ** 2
    k = int(np.argmax(s[1:])) + 1
    flat = len(grid) < 8 or np.allclose(y, 0)
    return {
        "mean_speed": speed.mean(), "speed_variance": speed.var(), "acceleration_variance": np.hypot(*acc.T).var(),
        "vertical_oscillation_hz": 0 if flat else k * fps / len(grid), "vertical_oscillation_power": 0 if flat else s[k] / s[1:].sum(),
        "heading_entropy": abs(-(p * np.log2(p)).sum() / 3), "hover_fraction": (speed < 0.5).mean(),
        "trajectory_smoothness": np.hypot(*np.diff(c, axis=0).T).sum() / max(np.hypot(*(c[-1] - c[0])), 1e-6),
        "scale_change_rate": np.median(np.abs(px[1:] / px[:-1] - 1) / dt), "median_pixels_on_target": np.median(px)}


@pytest.mark.parametrize("limit", [500_000, 20])
def test_features_match_numpy(spark, limit):
    """With the low limit the longer tracks take the join and distributed-spectrum path."""
    tracks = {"a": walk(1, 60), "b": walk(2, 9), "c": walk(3, 33, gaps=False), "short": walk(4, 5)}
    feats, short = track_features(obs_of(spark, tracks), 25.0, track_limit=limit)
    got = {r.track_id: r.asDict() for r in feats.collect()}
    assert set(got) == {"a", "b", "c"} and [r.track_id for r in short.collect()] == ["short"]
    for t, row in got.items():
        for name, want in reference(tracks[t], 25.0).items():
            assert row[name] == pytest.approx(want, rel=1e-6, abs=1e-9), (t, name)
        assert row["duration_frames"] == tracks[t][-1][0] - tracks[t][0][0] + 1 and row["n_observations"] == len(tracks[t])


def test_known_trajectories(spark):
    tracks = {
        "straight": [(i, 4.0 * i, 50.0, 12.0) for i in range(60)],
        "flapping": [(i, 3.0 * i, 100 + 8 * math.sin(2 * math.pi * 5 * i / 30), 12.0) for i in range(120)],
        "still": [(i, 10.0, 10.0, 12.0) for i in range(60)],
    }
    got = {r.track_id: r for r in track_features(obs_of(spark, tracks), 30.0)[0].collect()}
    s, f, h = got["straight"], got["flapping"], got["still"]
    assert s.mean_speed == pytest.approx(4) and s.trajectory_smoothness == pytest.approx(1) and s.vertical_oscillation_power == 0 and s.heading_entropy == 0
    assert f.vertical_oscillation_hz == pytest.approx(5.0, abs=0.3) and f.vertical_oscillation_power > 0.35
    assert h.hover_fraction == 1 and h.heading_entropy == 0 and h.trajectory_smoothness == 0


def test_frame_rate_fallback_and_bad_frames(spark):
    tracks = {"a": walk(1, 20)}
    obs = obs_of(spark, tracks)
    a, b = (track_features(obs, fps)[0].first().vertical_oscillation_hz for fps in (0.0, 30.0))
    assert a == b
    with pytest.raises(Exception, match="strictly increasing"):
        track_features(obs.unionByName(obs.limit(1)), 30.0)[0].collect()
    row = track_summary(obs, 30.0).first()
    assert row.span == row.last_frame - row.first_frame + 1 and row.duration_seconds == pytest.approx(row.span / 30)


def test_spectrum_edge_cases():
    assert spectrum_of(np.array([0, 3]), np.array([1.0, 2.0]), 30.0) == (0.0, 0.0)
    assert spectrum_of(np.arange(20), np.full(20, 3.0), 30.0) == (0.0, 0.0)


def test_flat_track_of_any_span_takes_the_short_way(spark, monkeypatch):
    from skytriage.operators import features

    def never(*_):
        raise AssertionError("a track of constant height has no spectrum to spread")

    monkeypatch.setattr(features, "_long_features", never)
    row = track_features(obs_of(spark, {"flat": [(i * 10**7, 4.0 * i, 50.0, 12.0) for i in range(12)]}), 30.0)[0].first()
    assert (row.vertical_oscillation_hz, row.vertical_oscillation_power) == (0.0, 0.0) and row.duration_frames == 11 * 10**7 + 1


def test_headings_on_the_diagonals(spark):
    from skytriage.operators.features import _heading_bin

    steps = [(sx * v, sy * v * (1 + e)) for v in (7.0, 20 / 3, 35 / 3, 0.1, 1 / 7) for sx in (1, -1) for sy in (1, -1) for e in (-3e-16, 0.0, 3e-16)] + [(1.0, 0.0), (-1.0, 0.0), (0.0, -2.0)]
    df = spark.createDataFrame([(*s, math.hypot(*s)) for s in steps], "vx double, vy double, speed double")
    got = {(r.vx, r.vy): r.bin for r in df.withColumn("bin", _heading_bin()).collect()}
    assert got == {s: min(math.floor((math.atan2(s[1], s[0]) + math.pi) / (math.pi / 4)), 7) for s in steps}
