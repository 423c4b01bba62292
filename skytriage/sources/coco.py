"""COCO-style annotation sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skytriage.constants import COCO_CATEGORY_IDS
from skytriage.functions.geometry import Box, corners, xywh_to_xyxy, xyxy_to_xywh
from skytriage.operators.scan import ranked
from skytriage.session import computed_once
from skytriage.sources import packs
from skytriage.sources.json_document import document_records

_IMAGE = "id:bigint,file_name:string,width:int,height:int,source_video:string,frame_index:bigint"
_ANNOTATION = "id:bigint,image_id:bigint,category_id:int,bbox:array<double>,area:double,iscrowd:int,track_id:bigint"


def to_coco(frames: DataFrame, gt: DataFrame, videos: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, categories) with ids counted up in (video, frame, object) order.

    The numbering comes from the block scan, so no task sees the whole set. A box on a
    frame that is not in ``frames`` stops the job.
    """
    named = "file_name" if "file_name" in frames.columns else None
    made = F.format_string("%s/%06d.jpg", F.col("source_video").cast("string"), F.col("frame_index"))
    sized = frames.join(videos.select("source_video", "width", "height"), "source_video", "left")
    numbered = ranked(sized, [], [F.col("source_video"), F.col("frame_index")], "_i")
    images = numbered.select(
        (F.col("_i") + 1).alias("id"), (F.coalesce(F.col(named), made) if named else made).alias("file_name"), "width", "height", "source_video", "frame_index")
    boxes = gt if "track_id" in gt.columns else gt.withColumn("track_id", F.lit(None).cast("long"))
    known = boxes.join(images.select("source_video", "frame_index", F.col("id").alias("image_id")), ["source_video", "frame_index"], "left").withColumn(
        "image_id", F.coalesce("image_id", F.raise_error(F.concat_ws(" ", F.lit("a box on a frame that is not listed:"), F.col("source_video").cast("string"), F.col("frame_index").cast("string"))).cast("long")))
    placed = ranked(known, [], [F.col("image_id"), F.col("gt_index")], "_i")
    w = xyxy_to_xywh(corners())
    ids = F.create_map(*[F.lit(x) for kv in COCO_CATEGORY_IDS.items() for x in kv])
    annotations = placed.select(
        (F.col("_i") + 1).alias("id"), "image_id", F.element_at(ids, F.col("label")).alias("category_id"), F.array(*w).alias("bbox"),
        (w.c * w.d).alias("area"), F.lit(0).alias("iscrowd"), "track_id")
    categories = frames.sparkSession.createDataFrame([(i, n) for n, i in COCO_CATEGORY_IDS.items()], "id int, name string")
    return images, annotations, categories


def write_coco(frames: DataFrame, gt: DataFrame, videos: DataFrame, path: str) -> None:
    """Three folders of JSON lines, written in parallel: images, annotations, categories."""
    for name, df in zip(("images", "annotations", "categories"), to_coco(frames, gt, videos)):
        df.write.mode("errorifexists").json(f"{path}/{name}", ignoreNullFields=False)


def _packed(spark: SparkSession, path: str) -> DataFrame:
    """``d``: the three arrays of every document of a pack, parsed whole; checked as documents in files are."""
    shape = ", ".join(f"{n}: array<{t}>" for n, t in (("images", f"struct<{_IMAGE}>"), ("annotations", f"struct<{_ANNOTATION}>"), ("categories", "string")))
    # In brackets, so that nothing after the end of a document goes unseen.
    bracketed = F.from_json(F.concat(F.lit("["), "value", F.lit("]")), f"array<struct<{shape}>>", {"mode": "FAILFAST"})
    docs = computed_once(packs.packed(spark, path).select("path", "value"), _docs=bracketed)
    d = F.get("_docs", 0)
    lacking = d["images"].isNull() | d["annotations"].isNull() | d["categories"].isNull()
    checked = F.when((F.size("_docs") == 1) & ~lacking, d).otherwise(F.raise_error(F.concat(F.col("path"), F.when(
        F.size("_docs") == 1, " needs images, annotations, categories").otherwise(" is not one whole JSON document"))).cast(f"struct<{shape}>"))
    return docs.select(checked.alias("d"))


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, boxes, one row: do all images know their video).

    Reads the folders of :func:`write_coco`, or JSON documents of any size, each by many
    tasks, or a pack of small documents. Images without annotations stay. A document without one of the three arrays, one
    that is cut off, or a record of another shape stops the job.
    """
    if packs.is_packed(path):
        def unpacked(section: str) -> DataFrame:
            return _packed(spark, path).select(F.posexplode(f"d.{section}").alias("position", "r")).withColumn("position", F.col("position").cast("bigint"))

        images = unpacked("images").select("position", "r.*")
        boxes = unpacked("annotations").select("r.*")
    elif path.rstrip("/").endswith(".json"):
        records = document_records(spark, path, ["images", "annotations", "categories"])

        def parsed(section: str, fields: str) -> DataFrame:
            return records.where(F.col("section") == section).select("file", "position", F.from_json("record", fields.replace(":", " "), {"mode": "FAILFAST"}).alias("r"))

        images = parsed("images", _IMAGE).select("position", "r.*")
        boxes = parsed("annotations", _ANNOTATION).select("r.*")
    else:
        images = spark.read.json(f"{path}/images", schema=_IMAGE.replace(":", " ")).withColumn("position", F.col("id"))
        boxes = spark.read.json(f"{path}/annotations", schema=_ANNOTATION.replace(":", " "))
    images = images.withColumnRenamed("id", "image_id")
    b = xywh_to_xyxy(Box(*[F.col("bbox")[i] for i in range(4)]))
    out = boxes.select("image_id", F.col("id").alias("annotation_id"), "category_id", b.a.alias("x1"), b.b.alias("y1"), b.c.alias("x2"), b.d.alias("y2"), "track_id")
    grouping = images.agg(F.bool_and(F.col("source_video").isNotNull()).alias("has_video_grouping"), F.count("*").alias("n_images"))
    return images, out, grouping


SPLIT_FOLDERS = {"train": "train", "val": "valid", "test": "test"}


def prepare_splits(frames: DataFrame, gt: DataFrame, assignment: DataFrame, listing: DataFrame, path: str) -> DataFrame:
    """Write frames and boxes per split folder; returns counts per split.

    ``assignment`` has ``source_video, split``; ``listing`` has ``file_name`` of the images
    at hand. No training frames, or a frame without its image, stops the job; another
    empty split is reported in the counts.
    """
    folder = F.create_map(*[F.lit(x) for kv in SPLIT_FOLDERS.items() for x in kv])
    f = frames.join(assignment, "source_video").withColumn("folder", F.element_at(folder, F.col("split")))
    missing = f.join(listing.select("file_name").distinct(), "file_name", "left_anti")
    if not missing.isEmpty():
        raise ValueError("frames name images that are not there; counting them is fine, training on them is not")
    if f.where("folder = 'train'").isEmpty():
        raise ValueError("no frames in the train split")
    g = gt.join(assignment, "source_video").withColumn("folder", F.element_at(folder, F.col("split")))
    f.drop("split").write.partitionBy("folder").mode("errorifexists").parquet(f"{path}/frames")
    g.drop("split").write.partitionBy("folder").mode("errorifexists").parquet(f"{path}/boxes")
    per = g.groupBy("source_video", "frame_index").agg(F.count("*").alias("n"))
    counts = f.join(per, ["source_video", "frame_index"], "left").groupBy("folder").agg(
        F.count("*").alias("n_frames"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_boxes"), F.count_if(F.col("n").isNull()).alias("n_empty_frames"))
    spark = frames.sparkSession
    every = spark.createDataFrame([(v,) for v in SPLIT_FOLDERS.values()], "folder string")
    return every.join(counts, "folder", "left").fillna(0)
