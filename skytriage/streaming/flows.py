"""Structured Streaming forms of the batch operators (K2-K7)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from skytriage.functions.numeric import poisson_interval
from skytriage.operators.features import track_features, track_summary
from skytriage.operators.triage import analyze_tracks, decide
from skytriage.sources import packs
from skytriage.sources.runs import append_tracks, ingest_runs, parse_decisions


def job_progress(frames: DataFrame, totals: DataFrame | None = None, every: int = 30) -> DataFrame:
    """Frames done per job, in steps of ``every``, and the share of the total if known.

    ``frames`` (stream or table) has ``job_id, frame_index``.
    """
    done = frames.groupBy("job_id").agg(F.max("frame_index").alias("last"))
    stepped = done.select("job_id", (F.floor((F.col("last") + 1) / every) * every).alias("frames_done"))
    if totals is None:
        return stepped.withColumn("progress", F.lit(0.0))
    share = F.when(F.col("n_frames") > 0, F.least(F.lit(1.0), F.col("frames_done") / F.col("n_frames"))).otherwise(0.0)
    return stepped.join(totals, "job_id", "left").select("job_id", "frames_done", F.coalesce(share, F.lit(0.0)).alias("progress"))


def stream_false_alarms(det: DataFrame, frames: DataFrame, confidence_threshold: float, window: str = "1 hour",
                        delay: str = "10 minutes") -> DataFrame:
    """Alarms, watched seconds and the exact interval on the hourly rate, per window.

    ``det`` has ``ts, score``; ``frames`` has ``ts, fps``, one row per frame seen.
    """
    alarms = det.where(F.col("score") >= confidence_threshold).select("ts", F.lit(1).alias("alarm"), F.lit(0).alias("frame"), F.lit(0.0).alias("secs"))
    watched = frames.select("ts", F.lit(0).alias("alarm"), F.lit(1).alias("frame"), (1.0 / F.col("fps")).alias("secs"))
    both = alarms.unionByName(watched).withWatermark("ts", delay)
    per = both.groupBy(F.window("ts", window)).agg(F.sum("alarm").alias("n_false_alarms"), F.sum("frame").alias("n_frames"), F.sum("secs").alias("seconds"))
    hours = F.col("seconds") / 3600.0
    return per.withColumn("_ci", F.when(F.col("seconds") > 0, poisson_interval(F.col("n_false_alarms")))).select(
        F.col("window.start").alias("start"), "n_false_alarms", "n_frames", "seconds", (F.col("n_false_alarms") / hours).alias("per_hour"),
        (F.col("_ci.low") / hours).alias("low_per_hour"), (F.col("_ci.high") / hours).alias("high_per_hour"))


def record_late(rows: DataFrame, batch_id: int, store: str, window: str = "1 hour", delay: str = "10 minutes") -> None:
    """Write how many rows of a batch come too late for their window, and the rows themselves.

    A row is late when its window ended by the watermark: the latest ``ts`` of all batches
    before, less ``delay``, which is when :func:`stream_false_alarms` and the like drop it
    without a word. ``store/counts`` has a row per batch (``n_rows, n_late, latest`` and the
    watermark), ``store/rows`` what was late, in the same columns. A batch that runs again
    sees only the batches before it and replaces its own folders. Rows without a time are not late.
    """
    spark = rows.sparkSession
    shape = "n_rows bigint, n_late bigint, latest timestamp, watermark timestamp, batch bigint"
    before = None
    if batch_id > 0:
        before = spark.read.schema(shape).parquet(f"{store}/counts").where(F.col("batch") < batch_id).agg(F.unix_micros(F.max("latest"))).first()[0]
    mark = F.timestamp_micros(F.lit(before).cast("bigint")) - F.expr(f"INTERVAL '{delay}'")
    late = F.coalesce(F.window("ts", window)["end"] <= mark, F.lit(False))
    # Spark drops a row without a time wherever a window is asked for.
    told = rows.where(F.col("ts").isNotNull()).withColumn("_late", late).unionByName(rows.where(F.col("ts").isNull()).withColumn("_late", F.lit(False)))
    told.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("_late").alias("n_late"), F.max("ts").alias("latest")).withColumn("watermark", mark).write.mode(
        "overwrite").parquet(f"{store}/counts/batch={batch_id}")
    told.where("_late").drop("_late").write.mode("overwrite").parquet(f"{store}/rows/batch={batch_id}")


def report_late(stream: DataFrame, store: str, checkpoint: str, window: str = "1 hour", delay: str = "10 minutes") -> StreamingQuery:
    """Late rows of a stream (K3) by batch, beside the query that drops them; ``stream`` has ``ts``."""
    return (stream.writeStream.foreachBatch(lambda batch, batch_id: record_late(batch, batch_id, store, window, delay))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def activity_sessions(det: DataFrame, gap: str, delay: str = "10 minutes", keys: list[str] = ["source_video"]) -> DataFrame:
    """Stretches of detections without a pause longer than ``gap`` (K7)."""
    return det.withWatermark("ts", delay).groupBy(*keys, F.session_window("ts", gap)).agg(F.count("*").alias("n_detections")).select(
        *keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_detections")


def once_per_track(decisions: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each track's first decision within the delay; repeats are dropped (K5).

    Keeps only the ids of the last ``delay``. :func:`decide_once` remembers for good.
    """
    return decisions.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["track_id"])


def record_first(decisions: DataFrame, batch_id: int, store: str, buckets: int = 64) -> None:
    """Write those of a batch's decisions that are the first of their track to ``store``.

    Of several in the batch the earliest counts, then the smallest in its other columns.
    The store is laid out by batch and by a hash of the track id, so only the ids in the
    buckets that the batch touches are read, and of them only what earlier batches wrote:
    a batch that is run again finds what it found before and replaces its own folder.
    Decisions without a track id are not decisions on a track and are left out.
    """
    spark = decisions.sparkSession
    rest = [c for c in decisions.columns if c not in ("track_id", "created_at")]
    once = decisions.where(F.col("track_id").isNotNull()).groupBy("track_id").agg(F.min(F.struct("created_at", *rest)).alias("d")).select("track_id", "d.*")
    placed = once.select(*decisions.columns, F.pmod(F.xxhash64("track_id"), F.lit(buckets)).cast("int").alias("bucket"))
    touched = sorted(r["bucket"] for r in placed.select("bucket").distinct().collect())  # at most ``buckets``
    if batch_id > 0 and touched:
        earlier = spark.read.schema(f"{_ddl(decisions)}, batch bigint, bucket int").parquet(store).where((F.col("batch") < batch_id) & F.col("bucket").isin(touched))
        placed = placed.join(earlier.select("bucket", "track_id"), ["bucket", "track_id"], "left_anti").select(*decisions.columns, "bucket")
    placed.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{store}/batch={batch_id}")


def decide_once(decisions: DataFrame, store: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """One decision per track for good (K5, J12): the first that arrives, however late a repeat comes."""
    return (decisions.writeStream.foreachBatch(lambda batch, batch_id: record_first(batch, batch_id, store, buckets))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def first_decisions(spark: SparkSession, schema: str, store: str) -> DataFrame:
    """What :func:`decide_once` has kept; ``schema`` is that of the decisions."""
    return spark.read.schema(f"{schema}, batch bigint, bucket int").parquet(store).drop("bucket")


#: What a decision needs beside the observations, and what is taken where nothing is known.
_CONTEXT = {
    "authorized": ("boolean", False), "flight_id": ("string", None), "operator": ("string", None), "site_known": ("boolean", None), "zone_class": ("string", None),
    "restriction_active": ("boolean", None), "restriction_reason": ("string", None), "history_count": ("bigint", None), "history_days": ("int", None),
    "classifier_trained": ("boolean", False), "classifier_label": ("string", None), "classifier_confidence": ("double", None),
    "interval_low": ("double", None), "interval_high": ("double", None),
}


def reevaluate(changed: DataFrame, history: DataFrame, fps: float | Column = 30.0, context: DataFrame | None = None) -> DataFrame:
    """Fresh decisions for the tracks in ``changed`` from all their observations (K4).

    Only these tracks are read from the history: the semi join prunes before any shuffle
    of observations by track. ``context`` has ``track_id`` and any of the columns that
    authorisation, zone, history and classifier give (one row per track); a track or
    column that is missing there counts as unknown.
    """
    ids = changed.select("track_id").distinct()
    obs = history.join(ids, "track_id", "left_semi")
    summary = track_summary(obs, fps).select("track_id", "n_observations", "duration_seconds", "median_pixels_on_target")
    feats = track_features(obs, fps)[0].drop("n_observations", "duration_frames", "median_pixels_on_target")
    given = context.columns if context is not None else []
    known = ids if context is None else ids.join(context.select("track_id", *[c for c in _CONTEXT if c in given]), "track_id", "left")
    known = known.select("track_id", *[F.coalesce(F.col(c) if c in given else F.lit(None).cast(kind), F.lit(default).cast(kind)).alias(c) for c, (kind, default) in _CONTEXT.items()])
    classifier = [c for c in _CONTEXT if c.startswith(("classifier", "interval"))]
    joined = summary.join(feats, "track_id", "left").join(known.select("track_id", *classifier), "track_id")
    evidence = analyze_tracks(joined).join(known.drop(*classifier), "track_id").withColumns({
        "failed_tools": F.array().cast("array<string>"), "round_cap_reached": F.lit(False), "has_analysis": F.lit(True)})
    return decide(evidence).select("track_id", "n_observations", "rule_id", "verdict", "uncertainty", "attention")


def stream_reevaluate(obs: DataFrame, history_path: str, out_path: str, checkpoint: str, fps: float = 30.0, buckets: int = 64,
                      context: Callable[[DataFrame, int], DataFrame] | None = None) -> StreamingQuery:
    """Append each micro-batch to the history and re-decide the tracks it touched.

    Both folders are written per batch id, so a repeated batch replaces its own output, and
    a batch sees the history up to its own. The history is laid out by a hash of the track,
    and only the buckets of touched tracks are read. ``context`` gives, for the touched
    tracks of a batch, what :func:`reevaluate` takes.
    """
    bucket = F.pmod(F.xxhash64("track_id"), F.lit(buckets)).cast("int")

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("bucket", bucket).write.partitionBy("bucket").mode("overwrite").parquet(f"{history_path}/batch={batch_id}")
        every = spark.read.schema(f"{_ddl(batch)}, batch bigint, bucket int").parquet(history_path).where(F.col("batch") <= batch_id)
        mine = every.where(F.col("batch") == batch_id)
        touched = [r["bucket"] for r in mine.select("bucket").distinct().collect()]  # at most ``buckets``
        history = every.where(F.col("bucket").isin(touched)).drop("batch", "bucket")
        ids = mine.select("track_id").distinct()
        reevaluate(ids, history, fps, context(ids, batch_id) if context else None).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return obs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)


def latest_decisions(spark: SparkSession, out_path: str) -> DataFrame:
    """Newest decision per track of :func:`stream_reevaluate`."""
    all_ = spark.read.parquet(f"{out_path}/batch=*")
    rest = [c for c in all_.columns if c not in ("track_id", "batch_id")]
    return all_.groupBy("track_id").agg(F.max(F.struct("batch_id", *rest)).alias("d")).select("track_id", *[F.col(f"d.{c}").alias(c) for c in rest])


def stream_ingest_runs(spark: SparkSession, path: str, labels: DataFrame, store: str, checkpoint: str,
                       report: Callable[[DataFrame, int], None] | None = None, quarantine: str | None = None) -> StreamingQuery:
    """New run folders under ``path``, or new files of a pack of runs, into the track store (K6).

    A bad file does not stop the rest: it is written, with path and text, to the folder
    ``quarantine`` (by default next to the store), one sub-folder per batch.
    """
    bad_path = quarantine or f"{store.rstrip('/')}-quarantine"
    files = packs.documents(spark, path, stream=True)

    def step(batch: DataFrame, batch_id: int) -> None:
        good, bad = parse_decisions(batch)
        bad.write.mode("overwrite").parquet(f"{bad_path}/batch={batch_id}")
        tracks, runs = ingest_runs(good, labels)
        append_tracks(tracks, store)
        if report is not None:
            report(runs, batch_id)

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Drain a stream into a folder and read it back; in update mode the last row per key wins elsewhere."""
    spark = stream.sparkSession
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/log").outputMode("append").trigger(availableNow=True).start()
    else:
        def step(batch: DataFrame, batch_id: int) -> None:
            batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/data/batch={batch_id}")

        q = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/log").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data" if mode == "append" else f"{path}/data/batch=*")
