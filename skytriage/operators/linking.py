"""Detections linked into tracklets by mutual best affinity.

The scalable default: no state is carried along a video, so its length and the number
of boxes in it do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skytriage.functions.geometry import affinity, corners, field_box, pixels_on_target
from skytriage.operators.grid import near_cells, near_probes
from skytriage.operators.scan import split_by_size
from skytriage.session import computed_once, durable

FRAME = ["source_video", "frame_index"]

#: Boxes of a frame up to which every box of the earlier frame may be compared with them.
CROWD = 64


def link_candidates(det: DataFrame, max_gap: int, iou_threshold: float, factor: float, crowd: int = CROWD) -> DataFrame:
    """Pairs (earlier box, later box) up to ``max_gap`` frames apart with positive affinity.

    Frames with few boxes meet on the frame number. In crowded ones the later boxes are
    filed under grid cells and only cells within reach are looked at.
    """
    box = F.struct("x1", "y1", "x2", "y2")
    reach = F.greatest(
        F.lit(factor) * F.greatest(pixels_on_target(corners()), F.lit(1e-6)),
        F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) * max(1.0 - iou_threshold, 0.5 / iou_threshold - 0.5))
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    gaps = F.explode_outer(F.sequence(F.lit(1), F.lit(max_gap))).alias("gap")
    before = det.select("source_video", F.col("frame_index").alias("a_frame"), F.col("det_index").alias("a_det"), box.alias("a"),
                        cx.alias("_cx"), cy.alias("_cy"), reach.alias("_reach"), gaps).withColumn("frame_index", F.col("a_frame") + F.col("gap"))
    after = det.select(*FRAME, F.col("det_index").alias("b_det"), box.alias("b"), cx.alias("_bx"), cy.alias("_by"))
    small, large = split_by_size(after, FRAME, crowd)
    pairs = before.join(small, FRAME)
    # Nearly all pairs are out of reach along one axis, which two subtractions tell. The rest are measured, behind
    # a generator: as part of the join's condition the formula makes a method too long for the JVM to compile.
    # A box with a corner that is null or no number goes on to the formula too.
    dx, dy = (F.col("a")[lo] + F.col("a")[hi] - F.col("b")[lo] - F.col("b")[hi] for lo, hi in (("x1", "x2"), ("y1", "y2")))
    within = F.col("_reach") * 2.000002
    pairs = pairs.where(((F.abs(dx) <= within) & (F.abs(dy) <= within)) | F.isnan(dx + dy) | (dx + dy).isNull())
    cols = ["source_video", "a_frame", "a_det", "gap", "frame_index", "b_det", "a", "b"]
    pairs = pairs.select(*cols)
    if large is not None:
        probing = before.withColumn("_cell", F.explode_outer(near_probes(F.col("_cx"), F.col("_cy"), F.col("_reach"))))
        filed = large.withColumn("_cell", F.explode_outer(near_cells(F.col("_bx"), F.col("_by"))))
        pairs = pairs.unionByName(probing.join(filed, [*FRAME, "_cell"]).select(*cols))
    strength = affinity(field_box(F.col("a")), field_box(F.col("b")), iou_threshold, factor)
    return computed_once(pairs, affinity=strength).where("affinity > 0").drop("a", "b").withColumnRenamed("frame_index", "b_frame")


def mutual_links(candidates: DataFrame) -> DataFrame:
    """Pairs that are each other's best: strongest, then nearest in time, then lowest index.

    Each pair counts for both of its ends, and one aggregation, combined before the shuffle,
    finds the best of every end; a pair that both of its ends name is a link. Ends of both
    sides stay in one table throughout, so the pairs are computed once.
    """
    def at(frame: str, det: str, side: int, other: str) -> Column:
        best = F.struct("affinity", (-F.col("gap")).alias("g"), (-F.col(other)).alias("o"))
        return F.struct(F.col(frame).alias("frame"), F.col(det).alias("det"), F.lit(side).alias("side"), best.alias("best"))

    ends = candidates.select("source_video", F.inline(F.array(at("a_frame", "a_det", 0, "b_det"), at("b_frame", "b_det", 1, "a_det"))))
    best = ends.groupBy("source_video", "frame", "det", "side").agg(F.max("best").alias("best"))
    ahead, g, other = F.col("side") == 0, F.col("best.g"), -F.col("best.o")
    named = best.select(
        "source_video", F.when(ahead, F.col("frame")).otherwise(F.col("frame") + g).alias("a_frame"), F.when(ahead, F.col("det")).otherwise(other).alias("a_det"),
        F.when(ahead, F.col("frame") - g).otherwise(F.col("frame")).alias("b_frame"), F.when(ahead, other).otherwise(F.col("det")).alias("b_det"),
        (-g).alias("gap"), F.col("best.affinity").alias("affinity"))
    both = named.groupBy("source_video", "a_frame", "a_det", "b_frame", "b_det").agg(
        F.max("gap").alias("gap"), F.max("affinity").alias("affinity"), F.count("*").alias("_ends"))
    return both.where("_ends = 2").drop("_ends")


def chain_labels(links: DataFrame) -> DataFrame:
    """First box of the chain for every linked box, by pointer doubling.

    Every box has at most one predecessor. A round replaces each pointer by its target's
    pointer, so the number of rounds is the logarithm of the longest chain. The keys are
    single boxes, hence spread evenly whatever the length of a video.
    """
    me = ["source_video", "b_frame", "b_det"]
    ptr = durable(links.select(*me, F.col("a_frame").alias("p_frame"), F.col("a_det").alias("p_det"), F.lit(False).alias("_done")))
    while True:
        for _ in range(2):
            target = ptr.select("source_video", F.col("b_frame").alias("p_frame"), F.col("b_det").alias("p_det"),
                                F.col("p_frame").alias("_tf"), F.col("p_det").alias("_td"), F.col("_done").alias("_tdone"))
            ptr = ptr.join(target, ["source_video", "p_frame", "p_det"], "left").select(
                *me, F.coalesce("_tf", "p_frame").alias("p_frame"), F.coalesce("_td", "p_det").alias("p_det"),
                F.coalesce(F.col("_tdone"), F.lit(True)).alias("_done"))
        ptr = durable(ptr)
        if ptr.where(~F.col("_done")).isEmpty():
            return ptr.select("source_video", F.col("b_frame").alias("frame_index"), F.col("b_det").alias("det_index"),
                              F.col("p_frame").alias("root_frame"), F.col("p_det").alias("root_det"))


def link_detections(det: DataFrame, max_gap: int = 1, iou_threshold: float = 0.3, factor: float = 2.0,
                    crowd: int = CROWD) -> DataFrame:
    """Detections with ``root_frame, root_det``, the first detection of their tracklet."""
    links = mutual_links(link_candidates(det, max_gap, iou_threshold, factor, crowd))
    labels = chain_labels(links)
    return det.join(labels, [*FRAME, "det_index"], "left").withColumns({
        "root_frame": F.coalesce("root_frame", "frame_index"), "root_det": F.coalesce("root_det", "det_index")})
