"""Line-per-frame annotation text: reader and writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skytriage.constants import TEXT_VOCAB
from skytriage.session import computed_once
from skytriage.sources import packs

_BOX = "struct<x1:double,y1:double,x2:double,y2:double,label:string,gt_index:bigint,problem:string>"


def map_class(token: Column, vocab: dict[str, str] = TEXT_VOCAB) -> Column:
    """Class of a source token; an unknown token stays unknown."""
    table = F.create_map(*[F.lit(x) for kv in vocab.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(token))), F.lit("unknown"))


def with_class(df: DataFrame, vocab: dict[str, str] = TEXT_VOCAB, token: str = "token") -> DataFrame:
    return df.withColumn("label", map_class(F.col(token), vocab))


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def read_frame_text(spark: SparkSession, path: str, video: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(frames, ground truth, rejected lines) from ``frame n (x y w h class)*n`` lines.

    A malformed line is never skipped in silence: it comes back with its file, its text
    and what is wrong with it. ``video`` defaults to the name of the file. A pack holds
    lines, each with the name of its file in ``path``.
    """
    if packs.is_packed(path):
        read, name = packs.packed(spark, path), F.col("path")
    else:
        read, name = spark.read.text(path), F.col("_metadata.file_path")
    source = video if video is not None else file_stem(name)
    lines = read.select(name.alias("path"), source.alias("source_video"), F.trim("value").alias("line"))
    parts = computed_once(lines.where("line <> ''"), p=F.split("line", r"\s+"))
    whole = r"^[+-]?\d+$"
    n = F.expr("try_cast(p[1] AS BIGINT)")
    head = (
        F.when(F.size("p") < 2, "fewer than two fields")
        .when(~(F.expr("p[0]").rlike(whole) & F.expr("p[1]").rlike(whole)), "frame and count must be integers")
        .when(n < 0, "negative object count").when(F.size("p") != 2 + n * 5, "field count does not match"))

    def one(i: Column) -> Column:
        v = [F.try_element_at(F.col("p"), (3 + i * 5 + k).cast("int")).try_cast("double") for k in range(4)]
        bad = F.lit(False)
        for c in v:
            bad = bad | c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
        x, y, w, h = v
        return F.struct(
            x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"),
            map_class(F.try_element_at(F.col("p"), (7 + i * 5).cast("int"))).alias("label"), i.cast("long").alias("gt_index"),
            F.when(bad, "non-numeric box").when((w <= 0) | (h <= 0), "non-positive size").alias("problem"))

    boxes = F.when(n > 0, F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), one)).otherwise(F.array().cast(f"array<{_BOX}>"))
    read = computed_once(parts, head=head)
    read = computed_once(read, boxes=F.when(F.col("head").isNull(), boxes))
    problem = F.coalesce("head", F.get(F.filter(F.col("boxes.problem"), lambda m: m.isNotNull()), F.lit(0)))
    judged = read.withColumn("problem", problem)
    good = judged.where("problem IS NULL").select("source_video", F.expr("CAST(p[0] AS BIGINT)").alias("frame_index"), "boxes")
    gt = good.select("source_video", "frame_index", F.inline("boxes")).drop("problem")
    return good.select("source_video", "frame_index"), gt, judged.where("problem IS NOT NULL").select("path", "line", "problem")


def frame_index_base(frames: DataFrame) -> DataFrame:
    return frames.groupBy("source_video").agg(F.min("frame_index").alias("frame_index_base"))


#: Frames of one video that share a written file.
FRAMES_PER_FILE = 100_000


def frame_lines(frames: DataFrame, gt: DataFrame) -> DataFrame:
    """One text line per frame, empty frames included: ``source_video, frame_index, value``."""
    box = F.struct("gt_index", F.concat_ws(" ", "x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), "label").alias("t"))
    per = gt.groupBy("source_video", "frame_index").agg(F.sort_array(F.collect_list(box)).alias("b"))
    joined = frames.join(per, ["source_video", "frame_index"], "left")
    line = F.concat_ws(" ", "frame_index", F.coalesce(F.size("b"), F.lit(0)), F.array_join(F.coalesce("b.t", F.array().cast("array<string>")), " "))
    return joined.select("source_video", "frame_index", F.rtrim(line).alias("value"))


def write_frame_text(frames: DataFrame, gt: DataFrame, path: str, frames_per_file: int = FRAMES_PER_FILE) -> None:
    """One directory per video, one file per ``frames_per_file`` frame numbers, lines in the order of frames.

    In a pack a line bears the name ``<video>.txt``, and lines are in no order.
    """
    if packs.is_packed(path):
        return packs.write_packed(frame_lines(frames, gt).select(F.concat(F.col("source_video").cast("string"), F.lit(".txt")).alias("path"), "value"), path)
    stretch = F.floor(F.col("frame_index") / F.lit(frames_per_file))
    placed = frame_lines(frames, gt).repartition("source_video", stretch).sortWithinPartitions("source_video", "frame_index")
    placed.select("source_video", "value").write.partitionBy("source_video").mode("errorifexists").text(path)
