"""False alarms on footage without targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skytriage.constants import BUCKET_LABELS, CONFIDENCE_EDGES, MIN_FOOTAGE_HOURS
from skytriage.functions.geometry import corners, pixels_on_target, size_bucket
from skytriage.functions.numeric import poisson_interval
from skytriage.operators.scan import medians


def confidence_bands() -> list[tuple[str, float, float]]:
    return [(f"{lo:.2f}-{min(hi, 1.0):.2f}", lo, hi) for lo, hi in zip(CONFIDENCE_EDGES, CONFIDENCE_EDGES[1:])]


def footage(frames: DataFrame, videos: DataFrame, keys: list[str] = []) -> DataFrame:
    """Frames and seconds per group: each clip counts at its own frame rate (F8)."""
    per_clip = frames.groupBy("source_video").agg(F.count("*").alias("n")).join(videos, "source_video", "left")
    rate = F.when(F.col("fps") > 0, F.col("fps")).otherwise(
        F.raise_error(F.concat(F.lit("no positive fps for the frames of "), F.col("source_video").cast("string"))).cast("double"))
    total = per_clip.groupBy(*keys).agg(F.sum("n").alias("n_frames"), F.sum(F.col("n") / rate).alias("duration_seconds"))
    return total.withColumn("effective_fps", F.col("n_frames") / F.col("duration_seconds"))


def alarm_rate(det: DataFrame, frames: DataFrame, videos: DataFrame, confidence_threshold: float,
               keys: list[str] = []) -> DataFrame:
    """Counts, rates and the exact interval, overall or per ``keys`` (columns of videos).

    Alarms are joined to the footage, not the other way round: a clip on which nothing
    fired still counts as watched.
    """
    if not 0.0 <= confidence_threshold <= 1.0:
        raise ValueError(f"confidence_threshold must be in [0, 1]; got {confidence_threshold}")
    watched = footage(frames, videos, keys)
    fired = det.where(F.col("score") >= confidence_threshold)
    if keys and keys != ["source_video"]:
        fired = fired.join(videos.select("source_video", *keys), "source_video")
    alarms = fired.groupBy(*keys).agg(F.count("*").alias("n_false_alarms"))
    on = keys or ["_one"]
    if not keys:
        watched, alarms = watched.withColumn("_one", F.lit(1)), alarms.withColumn("_one", F.lit(1))
    both = watched.join(alarms, on, "left").fillna({"n_false_alarms": 0})
    n_frames = F.when(F.col("n_frames") > 0, F.col("n_frames")).otherwise(
        F.raise_error(F.lit("no frames supplied")).cast("long"))
    hours = F.col("duration_seconds") / 3600.0
    return both.select(
        *keys, "n_false_alarms", n_frames.alias("n_frames"), hours.alias("duration_hours"), "effective_fps",
        F.lit(confidence_threshold).alias("confidence_threshold"),
        poisson_interval(F.col("n_false_alarms")).alias("_ci")
    ).select(
        *keys, "n_false_alarms", "n_frames", "duration_hours", "effective_fps", "confidence_threshold",
        (F.col("n_false_alarms") / F.col("duration_hours")).alias("per_hour"),
        (F.col("n_false_alarms") / F.col("n_frames")).alias("per_frame"),
        (F.col("_ci.low") / F.col("duration_hours")).alias("low_per_hour"),
        (F.col("_ci.high") / F.col("duration_hours")).alias("high_per_hour"),
        (F.col("duration_hours") < MIN_FOOTAGE_HOURS).alias("not_enough_footage"))


def alarm_profile(det: DataFrame, confidence_threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(per size bucket, per confidence band, one row of score statistics)."""
    spark = det.sparkSession
    fired = det.where(F.col("score") >= confidence_threshold).select(
        "score", size_bucket(pixels_on_target(corners())).alias("bucket"))
    buckets = spark.createDataFrame([(b,) for b in BUCKET_LABELS], "bucket string")
    by_bucket = buckets.join(fired.groupBy("bucket").agg(F.count("*").alias("n")), "bucket", "left").fillna({"n": 0})
    bands = confidence_bands()
    wide = fired.agg(*[F.count_if((F.col("score") >= lo) & (F.col("score") < hi)).alias(name) for name, lo, hi in bands])
    by_band = wide.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("band"), F.col(f"`{n}`").alias("n")) for n, _, _ in bands])))
    large = F.count_if(F.col("bucket") == BUCKET_LABELS[-1])
    stats = fired.withColumn("_one", F.lit(1)).groupBy("_one").agg(
        F.count("*").alias("n"), F.max("score").alias("max_score"),
        (large >= F.greatest(F.lit(1), F.floor(F.count("*") / 2))).alias("mostly_large"))
    mid = medians(fired.withColumn("_one", F.lit(1)), ["_one"], "score", "median_score")
    return by_bucket, by_band, stats.join(mid, "_one").drop("_one")


def false_alarms(det: DataFrame, frames: DataFrame, videos: DataFrame,
                 confidence_threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rate, counts per size bucket, counts per confidence band)."""
    by_bucket, by_band, _ = alarm_profile(det, confidence_threshold)
    return alarm_rate(det, frames, videos, confidence_threshold), by_bucket, by_band
