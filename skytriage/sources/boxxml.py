"""Per-image box XML: reading, index base, rejection, reconciliation, notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from skytriage.constants import XML_VOCAB
from skytriage.functions.geometry import Box
from skytriage.session import computed_once
from skytriage.sources import packs
from skytriage.sources.text import file_stem, map_class

MAX_BYTES = 1 << 20

_S = T.StringType()


def _fields(*pairs) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in pairs])


# Numbers are read as text: an object with a number that cannot be read would be left out otherwise.
SCHEMA = _fields(
    ("filename", _S), ("size", _fields(("width", _S), ("height", _S), ("depth", _S))),
    ("object", T.ArrayType(_fields(
        ("name", _S), ("pose", _S), ("truncated", _S), ("difficult", _S),
        ("bndbox", _fields(("xmin", _S), ("ymin", _S), ("xmax", _S), ("ymax", _S)))))))
#: A file is one annotation or a list of them.
_DOCUMENT = T.StructType([*SCHEMA.fields, T.StructField("annotation", T.ArrayType(SCHEMA)), T.StructField("_corrupt_record", _S)])
_LIST_ROOT = r"^\uFEFF?\s*(<\?[^>]*\?>\s*|<!--[\s\S]*?-->\s*)*<annotations[\s/>]"
#: Images per written file, so that files of usual images stay far below ``MAX_BYTES``.
PER_FILE = 200


def read_box_xml(spark: SparkSession, path: str, video: Column | None = None,
                 max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, raw objects, refused files) from ``<annotation>`` documents, one or a list of them per file.

    Files above ``max_bytes`` are never opened, files that are not UTF-8 or declare a document
    type never parsed; an annotation with a missing tag is refused as a whole. Files of no
    bytes are passed over by Spark's file sources. ``video`` defaults to the name of the file.
    In a pack the length stands beside the text, and what is above the limit goes no further.
    """
    if packs.is_packed(path):
        listed = packs.packed(spark, path).select("path", "length", F.col("value").alias("content"))
    else:
        listed = spark.read.format("binaryFile").load(path)
    fits = F.col("length") <= max_bytes
    size_bad = listed.where(~fits).select("path", F.lit("larger than the limit").alias("problem"))
    opened = listed.where(fits).select("path", F.col("content").cast("string").alias("text"))
    gate = F.when(~F.is_valid_utf8("text"), "not UTF-8").when(F.upper("text").contains("<!DOCTYPE"), "declares a document type")
    gated = size_bad.unionByName(opened.select("path", gate.alias("problem")).where("problem IS NOT NULL"))
    read = computed_once(opened.where(gate.isNull()).select("path", F.col("text").rlike(_LIST_ROOT).alias("is_list"), "text"), x=F.from_xml("text", _DOCUMENT.simpleString()))
    one = F.array(F.struct(*[F.col(f"x.{f}").alias(f) for f in SCHEMA.names]))
    listing = F.when(F.col("is_list") & F.col("x._corrupt_record").isNull(), F.coalesce("x.annotation", F.array().cast(T.ArrayType(SCHEMA)))).otherwise(one)
    whole_number = lambda c: F.col(c).try_cast("int")
    objects = F.transform(F.coalesce("a.object", F.array()), lambda o: F.struct(
        o["name"].alias("name"), *[o["bndbox"][c].try_cast("int").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")],
        *[F.coalesce(o[c].try_cast("int"), F.lit(0)).alias(c) for c in ("truncated", "difficult")]))
    docs = computed_once(read.select("path", F.col("x._corrupt_record").isNotNull().alias("broken"), F.explode(listing).alias("a")), objects=objects).select(
        "path", "broken", F.col("a.filename").alias("filename"), whole_number("a.size.width").alias("width"), whole_number("a.size.height").alias("height"), "objects")
    whole = F.forall("objects", lambda o: o["name"].isNotNull() & o["xmin"].isNotNull() & o["ymin"].isNotNull() & o["xmax"].isNotNull() & o["ymax"].isNotNull())
    problem = (F.when(F.col("broken"), "not readable as XML").when(F.col("filename").isNull(), "no filename").when(F.col("width").isNull() | F.col("height").isNull(), "no size")
               .when(~whole, "object without name or integer corners"))
    judged = docs.withColumns({"problem": problem, "source_video": file_stem(F.col("path")) if video is None else video})
    good = judged.where("problem IS NULL")
    images = good.select("source_video", "filename", "width", "height")
    raw = good.select("source_video", "filename", "width", "height", F.posexplode("objects").alias("gt_index", "o")).select(
        "source_video", "filename", "width", "height", F.col("gt_index").cast("long").alias("gt_index"),
        *[F.col(f"o.{c}").alias(c) for c in ("name", "xmin", "ymin", "xmax", "ymax", "truncated", "difficult")])
    return images, raw, gated.unionByName(judged.where("problem IS NOT NULL").select("path", "problem"))


def voc_to_xyxy(xmin: Column, ymin: Column, xmax: Column, ymax: Column, index_base: str = "one") -> Box:
    """Corners under the chosen base: one-based maxima are inclusive, so only minima move."""
    if index_base not in ("one", "zero"):
        raise ValueError(f"index_base must be 'one' or 'zero'; got {index_base!r}")
    shift = 1 if index_base == "one" else 0
    return Box((xmin - shift).cast("double"), (ymin - shift).cast("double"), xmax.cast("double"), ymax.cast("double"))


def xyxy_to_voc(box: Box, index_base: str = "one") -> Box:
    shift = 1 if index_base == "one" else 0
    whole = lambda c: F.bround(c).cast("int")
    return Box(whole(box.a) + shift, whole(box.b) + shift, whole(box.c), whole(box.d))


def _converted(raw: DataFrame, index_base: str) -> DataFrame:
    b = voc_to_xyxy(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")], index_base)
    reason = (F.when((b.c <= b.a) | (b.d <= b.b), "non-positive extent").when((b.a < 0) | (b.b < 0), "outside the image")
              .when((b.c > F.col("width")) | (b.d > F.col("height")), "past the frame edge"))
    return raw.select("*", b.a.alias("x1"), b.b.alias("y1"), b.c.alias("x2"), b.d.alias("y2"), reason.alias("reason"))


def reject_boxes(images: DataFrame, raw: DataFrame, index_base: str = "one") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(frames, ground truth, rejected boxes).

    An image with any rejected box is dropped as a whole: what the box described is
    still visible in it, so keeping the image would call that object background.
    """
    done = _converted(raw, index_base)
    bad_images = done.groupBy("source_video").agg(F.bool_or(F.col("reason").isNotNull()).alias("bad")).where("bad").select("source_video")
    kept = images.join(bad_images, "source_video", "left_anti")
    frames = kept.select("source_video", F.lit(0).cast("long").alias("frame_index"), "filename", "width", "height")
    gt = done.join(bad_images, "source_video", "left_anti").select(
        "source_video", F.lit(0).cast("long").alias("frame_index"), "gt_index", "x1", "y1", "x2", "y2", map_class(F.col("name"), XML_VOCAB).alias("label"))
    rejects = done.where("reason IS NOT NULL").select("source_video", "filename", "name", "xmin", "ymin", "xmax", "ymax", "reason")
    return frames, gt, rejects


def reconcile(images: DataFrame, raw: DataFrame, index_base: str = "one") -> DataFrame:
    """One row: every source object and frame accounted for, and whether the sums agree.

    Boxes are counted per image first; the join and the totals are over images.
    """
    done = _converted(raw, index_base).groupBy("source_video").agg(
        F.count("*").alias("n"), F.count_if(F.col("reason").isNotNull()).alias("bad"))
    per = images.select("source_video").join(done, "source_video", "left").fillna(0)
    total = per.agg(
        F.sum("n").alias("n_source_objects"), F.sum(F.when(F.col("bad") == 0, F.col("n")).otherwise(0)).alias("n_converted"),
        F.sum("bad").alias("n_rejected"), F.sum(F.when(F.col("bad") > 0, F.col("n") - F.col("bad")).otherwise(0)).alias("n_lost_with_dropped"),
        F.count("*").alias("n_source_frames"), F.count_if(F.col("bad") == 0).alias("n_emitted_frames"),
        F.count_if(F.col("bad") > 0).alias("n_dropped_frames"), F.count_if(F.col("n") == 0).alias("n_genuine_negatives"))
    return total.withColumns({
        "objects_reconcile": F.col("n_source_objects") == F.col("n_converted") + F.col("n_rejected") + F.col("n_lost_with_dropped"),
        "frames_reconcile": F.col("n_source_frames") == F.col("n_emitted_frames") + F.col("n_dropped_frames")})


def index_base_evidence(raw: DataFrame, applied: str = "one") -> DataFrame:
    """One row of counts and what they say about the base of the coordinates."""
    row = raw.agg(
        F.count("*").alias("n_boxes"), F.min(F.least("xmin", "ymin")).alias("min_coordinate"),
        F.count_if((F.col("xmin") == 0) | (F.col("ymin") == 0)).alias("n_zero_minimums"),
        F.count_if((F.col("xmin") == F.col("xmax")) | (F.col("ymin") == F.col("ymax"))).alias("n_zero_extent"),
        F.count_if((F.col("xmax") == F.col("width")) | (F.col("ymax") == F.col("height"))).alias("n_max_at_edge"))
    zero, flat = F.col("n_zero_minimums") > 0, F.col("n_zero_extent") > 0
    verdict = (F.when(F.col("n_boxes") == 0, "empty").when(zero & flat, "contradictory").when(zero, "zero_proven")
               .when(flat, "one_indicated").otherwise("unproven"))
    against = ((F.col("verdict") == "zero_proven") & (F.lit(applied) == "one")) | ((F.col("verdict") == "one_indicated") & (F.lit(applied) == "zero"))
    return row.withColumn("verdict", verdict).withColumn("contradicts_applied", against)


def source_notes(images: DataFrame, raw: DataFrame, rejects: DataFrame, listing: DataFrame) -> DataFrame:
    """``(code, subject, count)`` rows on what the source said that boxes cannot carry.

    ``listing`` has ``filename`` of the images that exist.
    """
    flags = raw.agg(F.count_if(F.col("difficult") != 0).alias("difficult"), F.count_if(F.col("truncated") != 0).alias("truncated"))
    bad = rejects.agg(F.count("*").alias("rejected"), F.count_if(F.col("reason").isin("non-positive extent", "outside the image")).alias("sensitive"))
    none = F.lit(None).cast("string")
    note = lambda code, c, cond: F.when(cond, F.struct(F.lit(code).alias("code"), none.alias("subject"), c.cast("long").alias("count")))
    fixed = flags.select(F.inline(F.array_compact(F.array(*[note(c, F.col(c), F.col(c) > 0) for c in ("difficult", "truncated")])))).unionByName(
        bad.select(F.inline(F.array_compact(F.array(note("rejected", F.col("rejected"), F.col("rejected") > 0),
                                                    note("index_base_sensitive", F.col("sensitive"), F.col("sensitive") > 3))))))
    missing = images.join(listing.select("filename").distinct(), "filename", "left_anti").agg(F.count("*").alias("n")).where("n > 0").select(
        F.lit("missing_images").alias("code"), none.alias("subject"), F.col("n").alias("count"))
    unknown = raw.where(map_class(F.col("name"), XML_VOCAB) == "unknown").groupBy("name").agg(F.count("*").alias("n"))
    top = unknown.orderBy(F.desc("n"), "name").limit(5).select(F.lit("unmapped_class").alias("code"), F.col("name").alias("subject"), F.col("n").alias("count"))
    return fixed.unionByName(missing).unionByName(top)


def write_box_xml(frames: DataFrame, gt: DataFrame, path: str, index_base: str = "one", per_file: int = PER_FILE) -> None:
    """Box XML, at most ``per_file`` images per file under one root; each image is one row.

    In a pack each image is a document, named by its file with ``.xml`` at the end.
    """
    b = xyxy_to_voc(Box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]), index_base)
    obj = F.struct(F.col("label").alias("name"), F.lit(0).alias("truncated"), F.lit(0).alias("difficult"),
                   F.struct(b.a.alias("xmin"), b.b.alias("ymin"), b.c.alias("xmax"), b.d.alias("ymax")).alias("bndbox"))
    per = gt.groupBy("source_video").agg(F.sort_array(F.collect_list(F.struct("gt_index", obj.alias("o")))).alias("b"))
    rows = frames.join(per, "source_video", "left").select(
        "filename", F.struct("width", "height", F.lit(3).alias("depth")).alias("size"), F.coalesce("b.o", F.array()).alias("object"))
    if packs.is_packed(path):
        return packs.write_packed(rows.select(F.concat(F.regexp_replace("filename", r"\.[^./]*$", ""), F.lit(".xml")).alias("path"),
                                              F.to_xml(F.struct(*rows.columns), {"rowTag": "annotation"}).alias("value")), path)
    rows.write.format("xml").option("rootTag", "annotations").option("rowTag", "annotation").option("maxRecordsPerFile", per_file).mode("errorifexists").save(path)
