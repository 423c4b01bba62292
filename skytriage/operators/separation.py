"""Descriptive statistics of labelled tracks and the two-arm comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skytriage.constants import FEATURES, MIN_CLIPS_PER_CLASS, MIN_TRACKS_PER_BUCKET, MIN_TRACKS_PER_CLASS, SMALL_BUCKETS
from skytriage.functions.numeric import chance_separation, wilson
from skytriage.operators.scan import order_statistic


def label_census(tracks: DataFrame, target: int = MIN_TRACKS_PER_CLASS) -> DataFrame:
    """Tracks and distinct clips per class, what is missing to ``target``, thin classes."""
    per_clip = tracks.groupBy("label", "source_clip").agg(F.count("*").alias("n"))
    out = per_clip.groupBy("label").agg(F.sum("n").alias("n_tracks"), F.count("*").alias("n_clips"))
    return out.withColumns({
        "shortfall": F.greatest(F.lit(target) - F.col("n_tracks"), F.lit(0).cast("long")),
        "few_clips": F.col("n_clips") < MIN_CLIPS_PER_CLASS})


def feature_ranges(tracks: DataFrame) -> DataFrame:
    """(feature, label): count, lowest, upper median and highest value."""
    long = tracks.unpivot(["label"], list(FEATURES), "feature", "value")
    ends = long.groupBy("feature", "label").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    mid = order_statistic(long, ["feature", "label"], "value", {"median": F.floor(F.col("n") / 2)})
    return ends.join(mid, ["feature", "label"]).select("feature", "label", "n", "low", "median", "high")


def separated_pairs(ranges: DataFrame) -> DataFrame:
    """Label pairs whose observed ranges on a feature do not touch.

    ``ranges`` has one row per feature and class, so the join is over a few dozen rows.
    """
    a, b = ranges.alias("a"), ranges.alias("b")
    disjoint = ~((F.col("a.low") <= F.col("b.high")) & (F.col("b.low") <= F.col("a.high")))
    return a.join(b, F.col("a.feature") == F.col("b.feature")).where(
        (F.col("a.label") < F.col("b.label")) & disjoint).select(
        F.col("a.feature").alias("feature"), F.col("a.label").alias("label_a"), F.col("b.label").alias("label_b"))


def separation_summary(counts: DataFrame, pairs: DataFrame, n_features: int = len(FEATURES)) -> DataFrame:
    """Features found separated against the number noise alone would give.

    ``counts`` has ``label, n_tracks``, one row per class.
    """
    one = counts.withColumn("_one", F.lit(1))
    a, b = one.alias("a"), one.alias("b")
    expected = a.join(b, F.col("a._one") == F.col("b._one")).where(F.col("a.label") < F.col("b.label")).agg(
        (F.coalesce(F.sum(chance_separation(F.col("a.n_tracks"), F.col("b.n_tracks"))), F.lit(0.0)) * n_features)
        .alias("expected")).withColumn("_one", F.lit(1))
    found = pairs.agg(F.countDistinct("feature").alias("found")).withColumn("_one", F.lit(1))
    return found.join(expected, "_one").select(
        "found", "expected", (F.col("found") <= F.col("expected")).alias("at_or_below_chance"))


def separate(tracks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ranges, separated pairs, summary against chance)."""
    ranges = feature_ranges(tracks)
    pairs = separated_pairs(ranges)
    counts = tracks.groupBy("label").agg(F.count("*").alias("n_tracks"))
    return ranges, pairs, separation_summary(counts, pairs)


def hypothesis_buckets(tracks: DataFrame) -> DataFrame:
    side = F.when(F.col("median_pixels_on_target") <= 20.0, "<=20px").otherwise(">20px")
    return tracks.groupBy(side.alias("side")).agg(F.count("*").alias("n_tracks"))


def bucket_scores(preds: DataFrame) -> DataFrame:
    """Per arm and size bucket: correct, total, accuracy, interval, thin flag.

    ``preds`` has ``arm, bucket, correct``.
    """
    out = preds.groupBy("arm", "bucket").agg(F.count_if("correct").alias("correct"), F.count("*").alias("total"))
    ci = wilson(F.col("correct"), F.col("total"))
    return out.withColumn("_ci", ci).select(
        "arm", "bucket", "correct", "total", (F.col("correct") / F.col("total")).alias("accuracy"),
        F.col("_ci.low").alias("low"), F.col("_ci.high").alias("high"),
        (F.col("total") < MIN_TRACKS_PER_BUCKET).alias("thin"))


def compare_arms(scores: DataFrame) -> DataFrame:
    """One row: does motion win where targets are small, and which buckets had unequal counts.

    A small bucket where appearance wins settles it as false; otherwise one where motion
    wins settles it as true; otherwise the data cannot tell (null).
    """
    a = scores.where("arm = 'appearance'").select("bucket", *[F.col(c).alias(f"a_{c}") for c in ("total", "low", "high")])
    m = scores.where("arm = 'motion'").select("bucket", *[F.col(c).alias(f"m_{c}") for c in ("total", "low", "high")])
    both = a.join(m, "bucket")
    usable = F.col("bucket").isin(*SMALL_BUCKETS) & (F.col("a_total") > 0) & (F.col("m_total") > 0)
    lost = F.coalesce(F.bool_or(usable & (F.col("a_low") > F.col("m_high"))), F.lit(False))
    won = F.coalesce(F.bool_or(usable & (F.col("m_low") > F.col("a_high"))), F.lit(False))
    uneven = F.sort_array(F.collect_list(F.when(F.col("a_total") != F.col("m_total"), F.col("bucket"))))
    return both.agg(F.when(lost, F.lit(False)).when(won, F.lit(True)).alias("motion_wins"),
                    F.array_join(uneven, ",").alias("unequal_buckets"))
