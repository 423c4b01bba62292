"""What a dataset holds, counted rather than quoted."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skytriage.constants import BUCKET_LABELS, CLASSES, MIN_NEGATIVE_SHARE, MIN_TRACKS_PER_CLASS
from skytriage.functions.geometry import corners, pixels_on_target, size_bucket
from skytriage.operators.scan import medians

FRAME = ["source_video", "frame_index"]


def census_counts(frames: DataFrame, gt: DataFrame, videos: DataFrame) -> DataFrame:
    """One row of totals; frames without boxes stay in the frame count."""
    boxes = gt.groupBy(*FRAME).agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("label") == c).alias(f"n_{c}") for c in CLASSES],
        *[F.count_if(size_bucket(pixels_on_target(corners())) == b).alias(f"b{i}") for i, b in enumerate(BUCKET_LABELS)],
        F.count_if(F.col("track_id").isNull()).alias("untracked"))
    per_frame = frames.select(*FRAME).join(boxes, FRAME, "left")
    zero = F.lit(0)
    totals = per_frame.agg(
        F.count("*").alias("n_frames"), F.count_if(F.col("n").isNull()).alias("n_empty_frames"),
        F.coalesce(F.sum("n"), zero).alias("n_boxes"),
        *[F.coalesce(F.sum(f"n_{c}"), zero).alias(f"boxes_{c}") for c in CLASSES],
        *[F.coalesce(F.sum(f"b{i}"), zero).alias(f"size_{b}") for i, b in enumerate(BUCKET_LABELS)],
        F.coalesce(F.sum("untracked"), zero).alias("n_untracked")).withColumn("_one", F.lit(1))
    sources = videos.agg(
        F.count("*").alias("n_videos"),
        *[F.count_if(F.col("track_id_source") == s).alias(f"ids_{s}") for s in ("annotated", "single_target", "none")],
    ).withColumn("_one", F.lit(1))
    return sources.join(totals, "_one").drop("_one")


def track_census(gt: DataFrame) -> DataFrame:
    """One row per (video, track): observations, frame range, median size, majority label.

    A tie between labels goes to the one seen first.
    """
    keys = ["source_video", "track_id"]
    tracked = gt.where(F.col("track_id").isNotNull()).withColumn("_px", pixels_on_target(corners()))
    per_label = tracked.groupBy(*keys, "label").agg(
        F.count("*").alias("n"), F.min(F.struct("frame_index", "gt_index")).alias("seen"),
        F.max("frame_index").alias("last"))
    rank = F.struct(F.col("n"), (-F.col("seen.frame_index")).alias("f"), (-F.col("seen.gt_index")).alias("o"))
    joined = per_label.groupBy(*keys).agg(
        F.max_by("label", rank).alias("label"), F.count("*").alias("n_labels"), F.sum("n").alias("n_observations"),
        F.min("seen.frame_index").alias("first_frame"), F.max("last").alias("last_frame"))
    return joined.join(medians(tracked, keys, "_px", "median_pixels_on_target"), keys).withColumn(
        "span", F.col("last_frame") - F.col("first_frame") + 1)


def census_warnings(counts: DataFrame, tracks: DataFrame) -> DataFrame:
    """``(code, subject, count)`` rows for everything a reader has to know first."""
    changed = tracks.where("n_labels > 1").select(
        F.lit("label_changes").alias("code"),
        F.concat_ws("#", F.col("source_video").cast("string"), F.col("track_id").cast("string")).alias("subject"),
        F.col("n_labels").cast("long").alias("count"))
    classes = [c for c in CLASSES if c != "unknown"]
    per_class = tracks.agg(F.count("*").alias("n_tracks"),
                           *[F.count_if(F.col("label") == c).alias(f"tracks_{c}") for c in classes])
    row = counts.withColumn("_one", F.lit(1)).join(per_class.withColumn("_one", F.lit(1)), "_one")
    populated = sum(((F.col(f"boxes_{c}") > 0).cast("int") for c in CLASSES), F.lit(0))
    only = F.coalesce(*[F.when(F.col(f"boxes_{c}") > 0, c) for c in CLASSES])

    def warn(code, cond, count, subject=None):
        return F.when(cond, F.struct(F.lit(code).alias("code"), (subject if subject is not None else F.lit(None)).cast("string").alias("subject"),
                                     count.cast("long").alias("count")))

    rules = [
        warn("untracked_boxes", F.col("n_untracked") > 0, F.col("n_untracked")),
        warn("zero_tracks", (F.col("n_tracks") == 0) & (F.col("n_boxes") > 0), F.col("n_boxes")),
        warn("no_video_grouping", (F.col("n_videos") > 1) & (F.col("n_videos") == F.col("n_frames")), F.col("n_videos")),
        warn("inferred_ids", F.col("ids_single_target") > 0, F.col("ids_single_target")),
        *[warn("few_tracks", F.col(f"tracks_{c}") < MIN_TRACKS_PER_CLASS, F.col(f"tracks_{c}"), F.lit(c)) for c in classes],
        warn("no_discrimination_signal",
             (populated == 1) & (F.col("n_frames") > 0)
             & (F.col("n_empty_frames") / F.col("n_frames") < MIN_NEGATIVE_SHARE), F.col("n_empty_frames"), only),
    ]
    rest = row.select(F.inline(F.array_compact(F.array(*rules))))
    return changed.unionByName(rest)


def census(frames: DataFrame, gt: DataFrame, videos: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    counts, tracks = census_counts(frames, gt, videos), track_census(gt)
    return counts, tracks, census_warnings(counts, tracks)


def frame_structure(frames: DataFrame) -> DataFrame:
    """Per video: frame count and whether every frame index occurs once."""
    per_frame = frames.groupBy(*FRAME).agg(F.count("*").alias("n"))
    return per_frame.groupBy("source_video").agg(
        F.sum("n").alias("n_frames"), (F.max("n") == 1).alias("unique_frames"))
