"""Tracks with the exact frame-by-frame semantics (D3).

A video is cut where nothing usable was seen for so long that every track has ended;
the pieces are independent and run in parallel. They are dealt to lanes, and a task advances
all pieces of a lane together, frame by frame as the rows arrive: only the tracks alive are
held, never a whole video, and the cost of a step is shared by the pieces of the lane.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from skytriage.operators.association import FrameTracker, TrackerConfig
from skytriage.operators.frames import FRAME, changes
from skytriage.session import durable

_SPAN = 4096

#: Boxes that a lane has to expect at a time: how many pieces a task advances together.
LANE_BOXES = 1 << 14


def frame_ordinals(frames: DataFrame) -> DataFrame:
    """Frames with ``ordinal``, their place in the video.

    Counted per stretch of frame numbers first, so no task ranks a whole video.
    """
    block = F.floor(F.col("frame_index") / _SPAN).alias("_blk")
    f = frames.select(*FRAME, block)
    per = f.groupBy("source_video", "_blk").agg(F.count("*").alias("n"))
    w = Window.partitionBy("source_video").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select("source_video", "_blk", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("_before"))
    local = Window.partitionBy("source_video", "_blk").orderBy("frame_index")
    return f.withColumn("_k", F.row_number().over(local)).join(carry, ["source_video", "_blk"]).select(
        *FRAME, (F.col("_before") + F.col("_k")).alias("ordinal"))


def quiet_cuts(usable: DataFrame, max_age: int) -> DataFrame:
    """Usable frames with ``piece``: the ordinal at which their stretch began.

    A new piece starts after more than ``max_age`` frames without a usable detection.
    """
    u = usable.withColumn("_blk", F.floor(F.col("ordinal") / _SPAN))
    local = Window.partitionBy("source_video", "_blk").orderBy("ordinal")
    running = local.rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("source_video").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    last = u.groupBy("source_video", "_blk").agg(F.max("ordinal").alias("m")).select(
        "source_video", "_blk", F.max("m").over(earlier).alias("_last"))
    prev = u.withColumn("_prev", F.lag("ordinal").over(local)).join(last, ["source_video", "_blk"]).withColumn(
        "_prev", F.coalesce("_prev", "_last"))
    fresh = F.col("_prev").isNull() | (F.col("ordinal") - F.col("_prev") > max_age + 1)
    marked = prev.withColumn("_start", F.when(fresh, F.col("ordinal")))
    carry = marked.groupBy("source_video", "_blk").agg(F.max("_start").alias("m")).select(
        "source_video", "_blk", F.max("m").over(earlier).alias("_carry"))
    return marked.withColumn("_own", F.max("_start").over(running)).join(carry, ["source_video", "_blk"]).select(
        *usable.columns, F.coalesce("_own", "_carry").alias("piece"))


def _fold(config: TrackerConfig):
    """Rows by lane and step in, confirmed observations and one total per piece out.

    The pieces of a lane begin at step 0, in the order in which every step has them.
    """
    keys = ["source_video", "piece"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tracker, lane, at, held = FrameTracker(config), None, -1, []
        homes: dict[tuple, int] = {}

        def rows(home: list[int], **columns: np.ndarray) -> pa.RecordBatch:
            kinds, names = held[0].schema, list(homes)
            first = [pa.array([names[h][0] for h in home], kinds.field("source_video").type), pa.array([names[h][1] for h in home], pa.int64())]
            rest = [pa.array(columns[c]) if c in columns else pa.nulls(len(home), t) for c, t in _OUT]
            return pa.RecordBatch.from_arrays(first + rest, names=keys + [c for c, _ in _OUT])

        def totals() -> Iterator[pa.RecordBatch]:
            if homes:
                yield rows(range(len(homes)), spawned=np.pad(tracker.spawned, (0, len(homes)))[:len(homes)])

        def advance() -> Iterator[pa.RecordBatch]:
            """The rows held are one step of one lane."""
            nonlocal tracker, lane, at
            t = pa.Table.from_batches(held).combine_chunks()
            if lane != t["lane"][0]:
                yield from totals()
                homes.clear()
                tracker, lane, at = FrameTracker(config), t["lane"][0], -1
            tracker.skip(t["step"][0].as_py() - at - 1)
            at = t["step"][0].as_py()
            starts = np.flatnonzero(changes(t, keys))
            here = [homes.setdefault(k, len(homes)) for k in zip(*(t[c].take(starts).to_pylist() for c in keys))]
            home = np.repeat(np.array(here, dtype=np.int64), np.diff(starts, append=t.num_rows))
            column = lambda c: t[c].to_numpy()
            sure = tracker.step(home, np.column_stack([column(c) for c in ("x1", "y1", "x2", "y2")]), column("score"),
                                np.column_stack([column("frame_index"), column("ordinal")]))
            if sure is not None:
                home, number, tags, box, score = sure
                yield rows(home.tolist(), number=number, frame_index=tags[:, 0], ordinal=tags[:, 1], score=score,
                           **{c: box[:, k] for k, c in enumerate(("x1", "y1", "x2", "y2"))})

        for batch in batches:
            if not batch.num_rows:
                continue
            cuts = np.flatnonzero(changes(pa.Table.from_batches([batch]), ["lane", "step"])).tolist()
            for a, b in zip(cuts, cuts[1:] + [batch.num_rows]):
                part = batch.slice(a, b - a)
                if held and any(held[0][c][0] != part[c][0] for c in ("lane", "step")):
                    yield from advance()
                    held.clear()
                held.append(part)
        if held:
            yield from advance()
            yield from totals()

    return run


_OUT = [("number", pa.int64()), ("frame_index", pa.int64()), ("ordinal", pa.int64()), *[(c, pa.float64()) for c in ("x1", "y1", "x2", "y2", "score")],
        ("spawned", pa.int64())]


def track_videos(det: DataFrame, frames: DataFrame, config: TrackerConfig = TrackerConfig(),
                 include_expired: bool = False, lane_boxes: int = LANE_BOXES) -> DataFrame:
    """Observations of confirmed tracks: ``source_video, track_id, frame_index``, box, score.

    ``frames`` lists every frame of every video, also those without detections: they are
    what ages a track. Without ``include_expired`` only tracks still alive when their
    video ends are returned. Track ids count all started tracks, so they have gaps.
    """
    usable_det = det.where(F.col("score") >= config.low_threshold)
    numbered = durable(frame_ordinals(frames))
    busy = usable_det.groupBy(*FRAME).agg(F.count("*").alias("boxes"))
    usable = durable(quiet_cuts(numbered.join(busy, FRAME), config.max_age))
    n_parts = int(det.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at_once = usable.groupBy("source_video", "piece").agg(F.max("boxes").alias("n")).agg(F.sum("n")).first()[0] or 0
    lane = F.pmod(F.xxhash64("source_video", "piece"), F.lit(max(n_parts, -(-at_once // lane_boxes)))).alias("lane")
    corner = [F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2", "score")]
    rows = usable_det.select(*FRAME, "det_index", *corner).join(usable, FRAME).select(
        lane, (F.col("ordinal") - F.col("piece")).alias("step"), "source_video", "piece", F.col("frame_index").cast("long").alias("frame_index"),
        "ordinal", "det_index", "x1", "y1", "x2", "y2", "score")
    video_type = dict(det.dtypes)["source_video"]
    schema = (f"source_video {video_type}, piece bigint, number bigint, frame_index bigint, ordinal bigint, "
              "x1 double, y1 double, x2 double, y2 double, score double, spawned bigint")
    folded = durable(
        # A fixed number of partitions: the fold costs far more per byte than the sizes
        # by which adaptive execution merges partitions would suggest.
        rows.repartitionById(n_parts, F.pmod("lane", F.lit(n_parts)).cast("int")).sortWithinPartitions("lane", "step", "source_video", "piece", "det_index")
        .mapInArrow(_fold(config), schema))
    earlier = Window.partitionBy("source_video").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = folded.where("spawned IS NOT NULL").select(
        "source_video", "piece", F.coalesce(F.sum("spawned").over(earlier), F.lit(0)).alias("_offset"))
    seen = folded.where("spawned IS NULL").join(offsets, ["source_video", "piece"]).withColumn(
        "track_id", F.col("number") + F.col("_offset"))
    if not include_expired:
        length = numbered.groupBy("source_video").agg(F.max("ordinal").alias("_n"))
        alive = seen.groupBy("source_video", "track_id").agg(F.max("ordinal").alias("_last")).join(length, "source_video").where(
            F.col("_n") - F.col("_last") <= config.max_age).select("source_video", "track_id")
        seen = seen.join(alive, ["source_video", "track_id"], "left_semi")
    return seen.select("source_video", "track_id", "frame_index", "x1", "y1", "x2", "y2", "score")
