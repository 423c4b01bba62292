"""Single-target rectangle JSON, one document per video."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skytriage.operators.scan import ranked
from skytriage.sources import packs


def read_rect_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(frames, ground truth, rejects) from documents with ``gt_rect`` and optional ``exist``.

    Frames without the target stay as empty frames. The video is the name of the
    enclosing folder and its one track is numbered by the sorted path of the document.
    """
    docs = packs.documents(spark, path).select("path", F.try_parse_json("value").alias("doc"))
    numbered = ranked(docs.select("path").distinct(), [], [F.col("path")], "track_id")
    doc = docs.join(numbered, "path").select(
        "path", "track_id", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("source_video"), "doc",
        F.try_variant_get("doc", "$.gt_rect", "array<variant>").alias("rects"),
        F.try_variant_get("doc", "$.exist", "array<variant>").alias("exist"))
    problem = (F.when(F.col("doc").isNull(), "not valid JSON").when(F.col("rects").isNull(), "no gt_rect list")
               .when(F.col("exist").isNotNull() & (F.size("exist") != F.size("rects")), "exist and gt_rect differ in length"))
    judged = doc.withColumn("problem", problem)
    rows = judged.where("problem IS NULL").select(
        "path", "track_id", "source_video", (F.col("exist").isNotNull()).alias("has_exist"),
        F.posexplode(F.when(F.col("exist").isNull(), F.transform("rects", lambda r: F.struct(r.alias("rect"), F.lit(None).cast("variant").alias("flag"))))
                     .otherwise(F.zip_with("rects", "exist", lambda r, e: F.struct(r.alias("rect"), e.alias("flag"))))).alias("frame_index", "e"))
    items = F.try_variant_get("e.rect", "$", "array<variant>")
    row = rows.withColumn("items", items).withColumn("v", F.transform("items", lambda i: F.try_variant_get(i, "$", "double")))
    four = F.coalesce(F.size("v") == 4, F.lit(False))
    numeric = four & F.forall("v", lambda x: x.isNotNull())
    flag = F.coalesce(F.try_variant_get("e.flag", "$", "boolean"), F.try_variant_get("e.flag", "$", "double") != 0, F.lit(False))
    present = F.when(F.col("has_exist"), flag).otherwise(numeric & F.exists("v", lambda x: x != 0))
    bad = F.when(present, F.when(~four, "present but not four numbers").when(~numeric, "non-numeric rect").when(F.expr("v[2] <= 0 OR v[3] <= 0"), "non-positive size"))
    seen = row.select("path", "source_video", "track_id", F.col("frame_index").cast("long").alias("frame_index"), "v", present.alias("present"), bad.alias("problem"))
    gt = seen.where("present AND problem IS NULL").select(
        "source_video", "frame_index", F.lit(0).cast("long").alias("gt_index"), F.expr("v[0]").alias("x1"), F.expr("v[1]").alias("y1"),
        F.expr("v[0] + v[2]").alias("x2"), F.expr("v[1] + v[3]").alias("y2"), F.lit("drone").alias("label"), "track_id")
    rejects = judged.where("problem IS NOT NULL").select("path", F.lit(None).cast("long").alias("frame_index"), "problem").unionByName(
        seen.where("problem IS NOT NULL").select("path", "frame_index", "problem"))
    return seen.select("source_video", "frame_index"), gt, rejects


def write_rect_json(frames: DataFrame, gt: DataFrame, path: str) -> None:
    """One JSON document per video folder, or per name ``source_video=.../rects.json`` of a pack; more than one box in a frame is an error.

    The format is one list per video, so a video's frames meet in one row.
    """
    per = gt.groupBy("source_video", "frame_index").agg(
        F.count("*").alias("n"), F.first(F.array("x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("r"))
    one = F.when(F.col("n") > 1, F.raise_error(F.lit("rect JSON holds one object per frame")).cast("array<double>")).otherwise(
        F.coalesce("r", F.array().cast("array<double>")))
    rows = frames.join(per, ["source_video", "frame_index"], "left").select("source_video", F.struct("frame_index", one.alias("rect"), F.col("n").isNotNull().cast("int").alias("exist")).alias("f"))
    docs = rows.groupBy("source_video").agg(F.sort_array(F.collect_list("f")).alias("f")).select(
        "source_video", F.to_json(F.struct(F.col("f.rect").alias("gt_rect"), F.col("f.exist").alias("exist"))).alias("value"))
    if packs.is_packed(path):
        return packs.write_packed(docs.select(F.concat(F.lit("source_video="), F.col("source_video").cast("string"), F.lit("/rects.json")).alias("path"), "value"), path)
    docs.write.partitionBy("source_video").mode("errorifexists").text(path)
