"""Average precision, counts and the scored report."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from skytriage.constants import AP_SWEEP, BUCKET_LABELS, BUCKETS, MIN_EVAL_BOXES, OPERATING_CONFIDENCE, SMALL_BUCKETS
from skytriage.functions.geometry import corners, pixels_on_target
from skytriage.operators.matching import FRAME, FRAME_LIMIT, IGNORED, TRUE_POSITIVE, Cell, match_outcomes
from skytriage.operators.scan import prefix_scan, suffix_max, with_blocks
from skytriage.session import durable


def eligible_counts(gt: DataFrame) -> DataFrame:
    """One row per size range ('all' and each bucket) with its ground-truth count."""
    px = pixels_on_target(corners())
    ranges = [("all", 0.0, float("inf")), *BUCKETS]
    wide = gt.select(px.alias("px")).agg(*[
        F.count_if((F.col("px") >= lo) & (F.col("px") < hi)).alias(name) for name, lo, hi in ranges])
    pairs = F.array(*[F.struct(F.lit(n).alias("bucket"), F.col(f"`{n}`").alias("n_eligible")) for n, _, _ in ranges])
    return wide.select(F.inline(pairs))


def average_precision(matches: DataFrame, eligible: DataFrame, keys: list[str]) -> DataFrame:
    """All-point AP per key from flat match rows.

    ``matches`` carries ``is_tp``, ``is_ignored``, ``score`` and a total tie order
    (``source_video, frame_index, det_index``); ``eligible`` has keys and ``n_eligible``.
    """
    tie = [F.desc("score"), *[F.col(c) for c in FRAME], F.col("det_index")]
    blocked = with_blocks(durable(matches.where(~F.col("is_ignored"))), [*[F.col(k) for k in keys], *tie])
    ranked = prefix_scan(blocked, keys, tie, sums={
        "_rank": F.lit(1).cast("long"), "_tp": F.col("is_tp").cast("long")})
    hits = ranked.where("is_tp").withColumn("_precision", F.col("_tp") / F.col("_rank"))
    best = suffix_max(hits, keys, "_rank", "_best", F.col("_precision"))
    area = best.groupBy(*keys).agg(F.sum("_best").alias("_area"))
    return eligible.join(area, keys, "left").select(
        *keys, "n_eligible",
        F.when(F.col("n_eligible") > 0, F.coalesce(F.col("_area"), F.lit(0.0)) / F.col("n_eligible"))
        .otherwise(0.0).alias("average_precision"))


def evaluate(det: DataFrame, gt: DataFrame, frames: DataFrame, cells: list[Cell],
             confidence: float | None = None, frame_limit: int = FRAME_LIMIT) -> DataFrame:
    """Counts, precision, recall and AP per cell; an evaluation over no frames fails.

    With ``confidence`` the counts, precision and recall describe the detections at or
    above it; AP always ranks all of them.
    """
    return _evaluate(det, gt, frames, cells, [confidence], frame_limit).drop("confidence")


def _by_cell(batch: pa.RecordBatch) -> np.ndarray:
    """The outcomes of a batch, one line per cell."""
    return np.ascontiguousarray(batch.column("kinds").flatten().to_numpy().reshape(batch.num_rows, -1).T)


def _block_counts(n_cells: int, n_kept: int):
    """Rows, true positives and ignored rows of a block in every cell, all of them and at every confidence."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found = None, np.zeros((1 + n_kept, 3, n_cells), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column("_at")[0].as_py() if at is None else at
            kinds = _by_cell(batch)
            kept = batch.column("kept").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, n_kept)
            for i, rows in enumerate([slice(None), *kept.T]):
                part = kinds[:, rows]
                found[i] += [np.full(n_cells, part.shape[1]), (part == TRUE_POSITIVE).sum(axis=1), (part == IGNORED).sum(axis=1)]
        if at is not None:
            names = [f"{name}{end}" for end in ("", *(f"_{i}" for i in range(n_kept))) for name in ("_n", "_n_tp", "_n_ign")]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n_cells, at)), pa.array(np.arange(n_cells, dtype=np.int32)), *map(pa.array, found.reshape(-1, n_cells))],
                                             names=["_at", "cell", *names])

    return count


def _block_precision(n_cells: int):
    """Per block and cell the best precision at a true positive, and the sum over these of the best at or after each.

    Rows come from the last to the first. The first of a block carries what was counted up
    to the end of the block, and the best precision of all blocks after it.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, area = None, np.zeros(n_cells)
        for batch in batches:
            if not batch.num_rows:
                continue
            if at is None:
                at = batch.column("_at")[0].as_py()
                n, tp, ign, best = (np.array([c[k] for c in batch.column("carry")[0].as_py()]) for k in ("n", "tp", "ign", "best"))
            kinds = _by_cell(batch)
            hit, out = kinds == TRUE_POSITIVE, kinds == IGNORED
            hits, outs = hit.cumsum(axis=1), out.cumsum(axis=1)
            ranked = (n - ign)[:, None] - np.arange(batch.num_rows) + (outs - out)
            precision = np.where(hit, (tp[:, None] - hits + hit) / np.maximum(ranked, 1), 0.0)
            precision[:, 0] = np.maximum(precision[:, 0], best)
            since = np.maximum.accumulate(precision, axis=1)
            area += np.where(hit, since, 0.0).sum(axis=1)
            n, tp, ign, best = n - batch.num_rows, tp - hits[:, -1], ign - outs[:, -1], since[:, -1]
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n_cells, at)), pa.array(np.arange(n_cells, dtype=np.int32)), pa.array(best), pa.array(area)],
                                             names=["_at", "cell", "_best", "_area"])

    return scan


def _evaluate(det, gt, frames, cells, confidences, frame_limit=FRAME_LIMIT) -> DataFrame:
    """All cells, and counts at several confidences, from one matching and one ranking.

    The ranked detections lie in blocks, each in one task, with the outcomes of all cells side
    by side. A task goes through its block with numbers per cell only, so rows are never
    expanded per cell; what passes between blocks is a row per block and cell.
    """
    kinds = F.transform("cells", lambda o: o["kind"])
    # Written once: the range partitioning reads its input twice, for bounds and for rows.
    outcomes = durable(match_outcomes(det, gt, cells, frame_limit).select(*FRAME, "det_index", "score", kinds.alias("kinds")))
    tie = [F.desc("score"), *[F.col(c) for c in FRAME], F.col("det_index")]
    last_first = [F.asc("score"), *[F.desc(c) for c in FRAME], F.desc("det_index")]
    keeps = F.array(*[F.lit(True) if c is None else F.coalesce(F.col("score") >= c, F.lit(False)) for c in confidences])
    # Written again, as the numbers of rows and blocks have to stay. They count up from the first row of a block.
    blocked = durable(outcomes.repartitionByRange(*tie).sortWithinPartitions(*last_first).select(
        F.monotonically_increasing_id().alias("_at"), keeps.alias("kept"), "kinds"))
    names = [f"{name}{end}" for end in ("", *(f"_{i}" for i in range(len(confidences)))) for name in ("_n", "_n_tp", "_n_ign")]
    counts = durable(blocked.mapInArrow(_block_counts(len(cells), len(confidences)), ", ".join(["_at bigint", "cell int", *(f"{n} bigint" for n in names)])))
    through = Window.partitionBy("cell").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("cell").orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, -1)
    ends = counts.select("_at", "cell", *[F.sum(c).over(through).alias(n) for c, n in (("_n", "n"), ("_n_tp", "tp"), ("_n_ign", "ign"))])

    def scanned(carried: DataFrame) -> DataFrame:
        """One row per block and cell; ``carried`` has ``n, tp, ign, best`` for each."""
        carry = carried.groupBy("_at").agg(F.array_sort(F.collect_list(F.struct("cell", "n", "tp", "ign", "best"))).alias("carry"))
        # A broadcast leaves rows and blocks where they are. It has a row per block, and only the first row of a block finds one.
        return blocked.select("_at", "kinds").join(F.broadcast(carry), "_at", "left").mapInArrow(
            _block_precision(len(cells)), "_at bigint, cell int, _best double, _area double")

    best = scanned(ends.withColumn("best", F.lit(0.0))).select("_at", "cell", F.coalesce(F.max("_best").over(after), F.lit(0.0)).alias("best"))
    area = scanned(ends.join(best, ["_at", "cell"])).groupBy("cell").agg(F.sum("_area").alias("_area"))
    per_cell = counts.groupBy("cell").agg(*[F.sum(c).alias(c) for c in names]).join(area, "cell")
    dim = det.sparkSession.createDataFrame(
        [(i, c.iou_threshold, c.bucket) for i, c in enumerate(cells)], "cell int, iou_threshold double, bucket string")
    # Every relation below has one row per cell or a single row.
    n_images = frames.agg(F.count("*").alias("n_images"))
    joined = (
        dim.join(per_cell, "cell", "left").join(eligible_counts(gt), "bucket", "left")
        .withColumn("_one", F.lit(1)).join(n_images.withColumn("_one", F.lit(1)), "_one"))
    at = F.array(*[F.struct(
        F.lit(c).cast("double").alias("confidence"), F.coalesce(f"_n_tp_{i}", F.lit(0)).alias("tp"),
        (F.coalesce(f"_n_{i}", F.lit(0)) - F.coalesce(f"_n_tp_{i}", F.lit(0)) - F.coalesce(f"_n_ign_{i}", F.lit(0))).alias("fp"))
        for i, c in enumerate(confidences)])
    tp, fp = F.col("tp"), F.col("fp")
    none = F.raise_error(F.lit("no images to evaluate")).cast("double")
    return joined.select("*", F.inline(at)).select(
        "cell", "confidence", "iou_threshold", "bucket", tp.alias("true_positives"), fp.alias("false_positives"),
        (F.col("n_eligible") - tp).alias("false_negatives"), "n_eligible",
        F.when(F.col("n_images") == 0, none)
        .when(F.col("n_eligible") > 0, F.coalesce(F.col("_area"), F.lit(0.0)) / F.col("n_eligible"))
        .otherwise(0.0).alias("average_precision"),
        F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0).alias("precision"),
        F.when(F.col("n_eligible") > 0, tp / F.col("n_eligible")).otherwise(0.0).alias("recall"))


def sweep_ap(det: DataFrame, gt: DataFrame, frames: DataFrame, bucket: str = "all",
             thresholds: tuple[float, ...] = AP_SWEEP) -> tuple[DataFrame, DataFrame]:
    """(AP per threshold, one row with their mean); the mean needs all ten thresholds."""
    per = evaluate(det, gt, frames, [Cell(t, bucket) for t in thresholds]).select(
        "bucket", "iou_threshold", "average_precision")
    mean = per.groupBy("bucket").agg(
        F.when(F.count_if(F.col("iou_threshold").isin(*AP_SWEEP)) == len(AP_SWEEP),
               F.avg("average_precision")).alias("mean_ap"))
    return per, mean


def report_cells(iou_thresholds=(0.5,), iou_thresholds_small=(0.25, 0.5), sweep: bool = True) -> list[tuple[str, Cell]]:
    """(section, cell) of the report: overall, per bucket, and the sweeps."""
    out = [("overall", Cell(t)) for t in iou_thresholds]
    for b in BUCKET_LABELS:
        out += [("bucket", Cell(t, b)) for t in (iou_thresholds_small if b in SMALL_BUCKETS else iou_thresholds)]
    if sweep:
        out += [("sweep", Cell(t)) for t in AP_SWEEP]
        out += [("bucket_sweep", Cell(t, b)) for b in BUCKET_LABELS for t in AP_SWEEP]
    return out


def score_report(det: DataFrame, gt: DataFrame, frames: DataFrame, iou_thresholds=(0.5,),
                 iou_thresholds_small=(0.25, 0.5), sweep: bool = True,
                 operating_confidence: float | None = OPERATING_CONFIDENCE) -> DataFrame:
    """Every section of the report as rows: section, cell, counts, AP, thin flag."""
    listed = report_cells(iou_thresholds, iou_thresholds_small, sweep)
    cells = list(dict.fromkeys(c for _, c in listed))
    confidences = [None] if operating_confidence is None else [None, operating_confidence]
    scored = durable(_evaluate(det, gt, frames, cells, confidences))
    sections = det.sparkSession.createDataFrame(
        [(s, cells.index(c)) for s, c in listed], "section string, cell int")
    out = sections.join(scored.where("confidence IS NULL"), "cell")
    if operating_confidence is not None:
        shown = [cells.index(Cell(t)) for t in iou_thresholds]
        at = scored.where(F.col("confidence").isNotNull() & F.col("cell").isin(shown))
        out = out.unionByName(at.withColumn("section", F.lit("operating_point")).select(out.columns))
    out = out.drop("confidence")
    return out.drop("cell").withColumn("thin", F.col("n_eligible") < MIN_EVAL_BOXES)


def run_totals(frames: DataFrame, det: DataFrame, seconds: float) -> DataFrame:
    """Images, detections and images per second of one evaluation run."""
    n_images = frames.agg(F.count("*").alias("n_images")).withColumn("_one", F.lit(1))
    n_det = det.agg(F.count("*").alias("n_detections")).withColumn("_one", F.lit(1))
    rate = F.col("n_images") / F.lit(float(seconds)) if seconds > 0 else F.lit(0.0)
    return n_images.join(n_det, "_one").select("n_images", "n_detections", rate.alias("images_per_second"))
