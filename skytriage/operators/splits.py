"""Train / val / test assignment by source video (G1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skytriage.operators.scan import ranked


def split_sizes(n: int, train_fraction: float, val_fraction: float) -> tuple[int, int]:
    """(train, val) counts, rounding half to even and always leaving something to test on."""
    n_train, n_val = max(1, round(n * train_fraction)), max(1, round(n * val_fraction))
    if n_train + n_val >= n:
        n_val = max(1, n - n_train - 1)
        n_train = min(n_train, n - n_val - 1)
    return n_train, n_val


def grouped_split(videos: DataFrame, seed: int, train_fraction: float = 0.7, val_fraction: float = 0.15) -> DataFrame:
    """``source_video, split``: videos in the order of a keyed hash, cut by rank.

    Only whole videos move, and adding one shifts at most the videos next to the cuts.
    The first 16 hex digits sort like the 64-bit number they spell.
    """
    if not 0 < train_fraction < 1 or not 0 <= val_fraction < 1 or train_fraction + val_fraction >= 1:
        raise ValueError("fractions must be in range and leave room for a test split")
    name = F.col("source_video").cast("string")
    hashed = videos.select("source_video", F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), name), 256), 1, 16).alias("_h"))
    counts = videos.agg(F.count("*").alias("n"), F.countDistinct("source_video").alias("u")).first()
    if counts["n"] != counts["u"]:
        raise ValueError(f"duplicate videos: {counts['n']} given, {counts['u']} unique")
    if counts["n"] < 3:
        raise ValueError(f"need at least 3 videos to hold anything out, got {counts['n']}")
    n_train, n_val = split_sizes(counts["n"], train_fraction, val_fraction)
    at = ranked(hashed, [], [F.col("_h"), F.col("source_video")])
    split = (F.when(F.col("position") < n_train, "train")
             .when(F.col("position") < n_train + n_val, "val").otherwise("test"))
    return at.select("source_video", split.alias("split"))
