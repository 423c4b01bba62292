"""The tracking fold against a plain matrix filter and brute-force assignment; links; streams."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skytriage.operators.association import TrackerConfig, pairwise_affinity
from skytriage.operators.linking import link_candidates, link_detections
from skytriage.operators.tracking import frame_ordinals, track_videos

DET = "source_video string, frame_index long, det_index long, x1 double, y1 double, x2 double, y2 double, score double"


class Plain:
    """Six-state filter with full matrices."""

    def __init__(self, z):
        self.x, self.P = np.array([*z, 0, 0.0]), np.diag([10.0] * 4 + [1000.0] * 2)
        self.F = np.eye(6)
        self.F[0, 4] = self.F[1, 5] = 1
        self.Q, self.H = np.diag([1.0] * 4 + [10.0] * 2), np.eye(4, 6)

    def predict(self):
        self.x, self.P = self.F @ self.x, self.F @ self.P @ self.F.T + self.Q

    def update(self, z):
        K = self.P @ self.H.T @ np.linalg.inv(self.H @ self.P @ self.H.T + np.eye(4))
        self.x = self.x + K @ (z - self.H @ self.x)
        J = np.eye(6) - K @ self.H
        self.P = J @ self.P @ J.T + K @ K.T

    @property
    def box(self):
        c, s = self.x[:2], np.maximum(self.x[2:4], 1e-6) / 2
        return [*(c - s), *(c + s)]


def to_z(b):
    return np.array([(b[0] + b[2]) / 2, (b[1] + b[3]) / 2, b[2] - b[0], b[3] - b[1]])


def best(w):
    n, m = w.shape
    top, pick = -1.0, None
    for p in itertools.permutations(range(m + n), n):
        total = sum(w[i, c] for i, c in enumerate(p) if c < m)
        if total > top + 1e-12:
            top, pick = total, p
    return [(i, c) for i, c in enumerate(pick) if c < m and w[i, c] > 0]


def brute(frames, cfg, include_expired):
    """frames: list of (frame_index, [(box, score)])."""
    alive, ended, next_id = [], [], 1
    for number, dets in frames:
        for t in alive:
            t["kf"].predict()
            t["miss"] += 1
        free, high = list(alive), [d for d in dets if d[1] >= cfg.high_threshold]
        low = [d for d in dets if cfg.low_threshold <= d[1] < cfg.high_threshold]
        spare = list(range(len(high)))
        for k, pool in enumerate((high, low)):
            if not free or not pool:
                continue
            w = pairwise_affinity(np.array([t["kf"].box for t in free]), np.array([d[0] for d in pool]), cfg.iou_threshold, cfg.centre_distance_factor)
            pairs = best(w)
            for i, j in pairs:
                t = free[i]
                t["kf"].update(to_z(pool[j][0]))
                t["hits"], t["miss"] = t["hits"] + 1, 0
                t["obs"].append(number)
                t["ok"] |= t["hits"] >= cfg.min_hits
            used = {i for i, _ in pairs}
            free = [t for i, t in enumerate(free) if i not in used]
            if k == 0:
                spare = [j for j in spare if j not in {c for _, c in pairs}]
        for t in free:
            if not t["ok"] or t["miss"] > cfg.max_age:
                alive.remove(t)
                if t["ok"]:
                    ended.append(t)
        for j in spare:
            alive.append({"id": next_id, "kf": Plain(to_z(high[j][0])), "hits": 1, "miss": 0, "obs": [number], "ok": cfg.min_hits <= 1})
            next_id += 1
    out = [t for t in alive if t["ok"]] + (ended if include_expired else [])
    return {t["id"]: t["obs"] for t in out}


def scene(seed, n_frames=160):
    rng = random.Random(seed)
    targets = [(rng.uniform(50, 400), rng.uniform(50, 400), rng.uniform(-3, 3), rng.uniform(-3, 3), rng.uniform(8, 20)) for _ in range(3)]
    frames = []
    for f in range(n_frames):
        dets = []
        if not (40 <= f < 75 or 110 <= f < 120):  # one pause longer than max_age, one shorter
            for x, y, vx, vy, s in targets:
                if rng.random() < 0.85:
                    cx, cy = x + vx * f + rng.uniform(-1, 1), y + vy * f + rng.uniform(-1, 1)
                    dets.append(((cx - s / 2, cy - s / 2, cx + s / 2, cy + s / 2), rng.choice([0.9, 0.7, 0.3, 0.05])))
        frames.append((f, dets))
    return frames


@pytest.mark.parametrize("include_expired", [True, False])
def test_track_videos_matches_brute_force(spark, include_expired):
    cfg = TrackerConfig(max_age=20)
    scenes = {f"v{s}": scene(s) for s in (1, 2, 3)}
    rows = [(v, f, i, *map(float, b), s) for v, fr in scenes.items() for f, dets in fr for i, (b, s) in enumerate(dets)]
    det = spark.createDataFrame(rows, DET)
    frames = spark.createDataFrame([(v, f) for v, fr in scenes.items() for f, _ in fr], "source_video string, frame_index long")
    got = {}
    for r in track_videos(det, frames, cfg, include_expired).collect():
        got.setdefault(r.source_video, {}).setdefault(r.track_id, []).append(r.frame_index)
    for v, fr in scenes.items():
        want = brute(fr, cfg, include_expired)
        assert {k: sorted(o) for k, o in got.get(v, {}).items()} == want and (want or not include_expired)


def test_frame_ordinals_skip_missing_numbers(spark):
    numbers = [3, 4, 9, 5000, 5001, 12000]
    df = spark.createDataFrame([("v", n) for n in numbers], "source_video string, frame_index long")
    assert {r.frame_index: r.ordinal for r in frame_ordinals(df).collect()} == {n: i + 1 for i, n in enumerate(numbers)}


def small_bird(spark, factor):
    rows = []
    for i in range(150):
        cx, cy = 100 + 2.0 * i, 200 + 9 * math.sin(2 * math.pi * 5 * i / 30)
        rows.append(("v", i, 0, cx - 5.5, cy - 5.5, cx + 5.5, cy + 5.5, 0.9))
    det = spark.createDataFrame(rows, DET)
    out = track_videos(det, det.select("source_video", "frame_index"), TrackerConfig(centre_distance_factor=factor))
    return {r.track_id: r.n for r in out.groupBy("track_id").agg(F.count("*").alias("n")).collect()}


def test_fast_small_target_needs_centre_distance(spark):
    # An 11 px target flapping at 5 Hz: lost on overlap alone, whole with the fallback.
    assert small_bird(spark, 2.0) == {1: 150}
    assert max(small_bird(spark, 0.0).values(), default=0) < 150


def test_links_on_grid_equal_links_on_frames(spark):
    rng = random.Random(4)
    rows = []
    for f in range(6):
        for i in range(40):
            x, y, s = rng.uniform(0, 300), rng.uniform(0, 300), rng.choice([4.0, 12.0, 60.0, 150.0])
            rows.append(("v", f, i, x, y, x + s, y + s, 0.9))
    det = spark.createDataFrame(rows, DET)
    cols = ["a_frame", "a_det", "b_frame", "b_det"]
    plain = {tuple(r) for r in link_candidates(det, 2, 0.3, 2.0).select(*cols).collect()}
    grid = {tuple(r) for r in link_candidates(det, 2, 0.3, 2.0, crowd=5).select(*cols).collect()}
    assert plain == grid and plain
    out = link_detections(det, 1, crowd=5).collect()
    assert len(out) == len(rows)


def test_long_chain(spark):
    rows = [("v", f, 0, 10.0 + f, 10.0, 30.0 + f, 30.0, 0.9) for f in range(70)] + [("v", 200, 0, 0.0, 0.0, 5.0, 5.0, 0.9)]
    out = link_detections(spark.createDataFrame(rows, DET)).select("frame_index", "root_frame").collect()
    assert {r.root_frame for r in out if r.frame_index < 70} == {0} and [r.root_frame for r in out if r.frame_index == 200] == [200]


def test_stream_equals_batch(spark, tmp_path):
    from skytriage.streaming.flows import run_to_table
    from skytriage.streaming.tracker import stream_tracks

    cfg = TrackerConfig(max_age=20)
    rows = []
    for v, fr in {"a": scene(5, 90), "b": scene(6, 90)}.items():
        for f, dets in fr:
            rows += [(v, f, i, *map(float, b), s, 1000 + f) for i, (b, s) in enumerate(dets)] or [(v, f, None, None, None, None, None, None, 1000 + f)]
    # A last frame far ahead lets the watermark pass everything before it.
    rows += [(v, 10_000, None, None, None, None, None, None, 9_000) for v in "ab"]
    df = spark.createDataFrame(rows, DET + ", sec long").withColumn("ts", F.timestamp_seconds("sec")).drop("sec")
    df.where("frame_index < 45").coalesce(1).write.parquet(f"{tmp_path}/in/1")
    df.where("frame_index >= 45").coalesce(1).write.parquet(f"{tmp_path}/in/2")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = {tuple(r) for r in run_to_table(stream_tracks(stream, cfg, "2 seconds"), f"{tmp_path}/out").select("source_video", "track_id", "frame_index").collect()}
    det = df.where("score IS NOT NULL").drop("ts")
    frames = df.where("frame_index < 10000").select("source_video", "frame_index").distinct()
    want = {tuple(r) for r in track_videos(det, frames, cfg, True).select("source_video", "track_id", "frame_index").collect()}
    assert got == want and want


def test_lanes_of_any_size_give_the_same_tracks(spark):
    cfg = TrackerConfig(max_age=4)
    scenes = {f"v{s}": scene(s, 90) for s in range(10, 22)}
    rows = [(v, f, i, *map(float, b), s) for v, fr in scenes.items() for f, d in fr for i, (b, s) in enumerate(d)]
    frames = spark.createDataFrame([(v, f) for v, fr in scenes.items() for f, _ in fr], "source_video string, frame_index long")
    got = [{(r.source_video, r.track_id, r.frame_index) for r in track_videos(spark.createDataFrame(rows, DET), frames, cfg, True, lane_boxes=n).collect()}
           for n in (1, 5, 1 << 14)]
    want = {(v, k, f) for v, fr in scenes.items() for k, o in brute(fr, cfg, True).items() for f in o}
    assert got[0] == got[1] == got[2] == want and want


@pytest.mark.parametrize("rows_per_batch", [7, 10_000])
def test_one_step_advances_every_video_of_a_lane(monkeypatch, rows_per_batch):
    import pyarrow as pa

    from skytriage.operators import tracking

    steps = []
    step = tracking.FrameTracker.step
    monkeypatch.setattr(tracking.FrameTracker, "step", lambda self, *a: steps.append(1) or step(self, *a))
    rows = [(0, f, f"v{v:02}", 1, f, f + 1, v + 2.0 * f, 0.0, v + 2.0 * f + 20, 20.0, 0.9) for f in range(25) for v in range(40)]
    names = ["lane", "step", "source_video", "piece", "frame_index", "ordinal", "x1", "y1", "x2", "y2", "score"]
    t = pa.table([pa.array(c) for c in zip(*rows)], names=names)
    out = pa.Table.from_batches(tracking._fold(TrackerConfig())(iter(t.to_batches(rows_per_batch))))
    assert len(steps) == 25
    tracks = out.filter(pa.compute.is_null(out["spawned"])).group_by(["source_video", "number"]).aggregate([("ordinal", "count")])
    assert tracks.num_rows == 40 and set(tracks["ordinal_count"].to_pylist()) == {25}
    assert out["spawned"].drop_null().to_pylist() == [1] * 40


def test_pairs_of_boxes_are_computed_once(spark):
    from skytriage.operators.linking import mutual_links

    det = spark.createDataFrame([("v", f, 0, 10.0 + f, 10.0, 30.0 + f, 30.0, 0.9) for f in range(5)], DET)
    links = mutual_links(link_candidates(det, 2, 0.3, 2.0))
    assert links._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert sorted(tuple(r) for r in links.select("a_frame", "b_frame", "gap").collect()) == [(f, f + 1, 1) for f in range(4)]


@pytest.mark.parametrize("factor", [0.0, 2.0])
def test_candidates_are_all_pairs_of_positive_affinity(spark, factor):
    from skytriage.functions.geometry import Box, affinity

    rng, nan, far = random.Random(12), float("nan"), 1e9
    boxes = [(0, 0, 10, 10), (20, 0, 30, 10), (0, 19.999999999, 10, 30), (0, 0, 20, 10), (0, 0, 10, 33), (5, 5, 5, 5), (5, 5, 5 + 1e-9, 5 + 1e-9),
             (nan, 0, 10, 10), (None, 0, 10, 10), (far, far, far + 8, far + 8), (far + 15, far, far + 23, far + 8), (0, 0, float("inf"), 10), (10, 10, 0, 0)]
    boxes += [(x, y, x + w, y + h) for x, y, w, h in ((rng.randint(0, 60), rng.randint(0, 60), rng.randint(1, 40), rng.randint(1, 40)) for _ in range(30))]
    rows = [("v", f, i, *(None if v is None else float(v) for v in b), 0.9) for f in range(2) for i, b in enumerate(boxes) if (f, b[2:]) != (1, (5, 5))]
    det = spark.createDataFrame(rows, DET)
    a, b = (det.where(f"frame_index = {f}").select(*[F.col(c).alias(n + c) for c in ("det_index", "x1", "y1", "x2", "y2")]) for f, n in ((0, "a_"), (1, "b_")))
    box = lambda n: Box(*(F.col(n + c) for c in ("x1", "y1", "x2", "y2")))
    every = a.crossJoin(b).select("a_det_index", "b_det_index", affinity(box("a_"), box("b_"), 0.3, factor).alias("w")).where("w > 0")
    want = sorted(repr(tuple(r)) for r in every.collect())
    got = sorted(repr(tuple(r)) for r in link_candidates(det, 1, 0.3, factor).select("a_det", "b_det", "affinity").collect())
    assert got == want and len(want) > 30
