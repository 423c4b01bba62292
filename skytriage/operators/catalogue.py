"""Video catalogue: limits before anything is read, and a sample to look at."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skytriage.constants import MEDIA_LIMITS
from skytriage.functions.geometry import corners, pixels_on_target
from skytriage.operators.scan import medians, ranked


def media_violation(limits: dict = MEDIA_LIMITS):
    """First violated property of ``width, height, fps, duration_seconds``, else null."""
    w, h, fps, dur = (F.col(c) for c in ("width", "height", "fps", "duration_seconds"))
    return (
        F.when((w <= 0) | (h <= 0), "invalid dimensions")
        .when(fps <= 0, "invalid frame rate").when(dur <= 0, "invalid duration")
        .when((w > limits["side"]) | (h > limits["side"]), "resolution")
        .when(fps > limits["fps"], "frame rate").when(dur > limits["seconds"], "duration")
        .when(w.cast("double") * h * fps * dur > limits["work"], "total pixels"))


def media_limits_gate(videos: DataFrame, limits: dict = MEDIA_LIMITS) -> tuple[DataFrame, DataFrame]:
    """(accepted videos, rejected videos with the reason)."""
    judged = videos.withColumn("violation", media_violation(limits))
    return judged.where("violation IS NULL").drop("violation"), judged.where("violation IS NOT NULL")


def sample_frames(frames: DataFrame, gt: DataFrame, limit: int = 12) -> DataFrame:
    """At most ``limit`` single-frame videos that would show a conversion error.

    Smallest, middle and largest by median box size, the first with several objects and
    the first with none, then an even stride. A video keeps the first reason it got.
    """
    if limit < 1:
        raise ValueError(f"limit must be at least 1; got {limit}")
    single = frames.groupBy("source_video").agg(F.count("*").alias("n")).where("n = 1").select("source_video")
    sized = gt.withColumn("_px", pixels_on_target(corners()))
    boxes = sized.groupBy("source_video").agg(F.count("*").alias("n_boxes")).join(
        medians(sized, ["source_video"], "_px", "median_px"), "source_video")
    listed = ranked(single.join(boxes, "source_video", "left"), [], [F.col("source_video")], "place").fillna({"n_boxes": 0})
    by_size = ranked(listed.where("n_boxes > 0"), [], [F.col("median_px"), F.col("place")], "size_rank")
    size = by_size.agg(F.count("*").alias("n"))
    tagged = by_size.withColumn("_one", F.lit(1)).join(F.broadcast(size.withColumn("_one", F.lit(1))), "_one")
    picks = tagged.select("source_video", "place", F.explode(F.array_compact(F.array(
        F.when(F.col("size_rank") == 0, F.struct(F.lit(0).alias("priority"), F.lit("smallest box").alias("reason"))),
        F.when(F.col("size_rank") == F.floor(F.col("n") / 2), F.struct(F.lit(1).alias("priority"), F.lit("median box").alias("reason"))),
        F.when(F.col("size_rank") == F.col("n") - 1, F.struct(F.lit(2).alias("priority"), F.lit("largest box").alias("reason"))),
    ))).alias("p")).select("source_video", "place", "p.*")
    for rank, (cond, reason) in enumerate((("n_boxes > 1", "several objects"), ("n_boxes = 0", "no objects")), start=3):
        first = listed.where(cond).orderBy("place").limit(1)
        picks = picks.unionByName(first.select("source_video", "place", F.lit(rank).alias("priority"), F.lit(reason).alias("reason")))
    picks = picks.groupBy("source_video", "place").agg(F.min(F.struct("priority", "reason")).alias("p")).select(
        "source_video", "place", "p.*")
    # At most five rows and one count come back to decide the stride.
    places = [r["place"] for r in picks.select("place").collect()]
    total = listed.count()
    remaining = limit - len(places)
    out = picks
    if remaining > 0 and total:
        step = max(1, total // (remaining + 1))
        wanted = [p for p in range(0, total, step)[: limit + 5] if p not in places][:remaining]
        out = picks.unionByName(listed.where(F.col("place").isin(wanted) if wanted else F.lit(False)).select(
            "source_video", "place", (F.lit(5) + F.col("place")).cast("int").alias("priority"),
            F.lit("even stride").alias("reason")))
    return out.orderBy("priority").limit(limit).select("source_video", "reason")
