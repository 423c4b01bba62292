"""Packs of small documents, and columns that are computed once."""

import pytest
from pyspark.sql import functions as F

from skytriage.session import computed_once
from skytriage.sources import boxxml, packs, rects, runs, text


def test_every_document_of_a_pack_is_judged(spark, tmp_path):
    path = str(tmp_path / "runs.packed")
    good = '[{"track_id": "%d", "job_id": "j"}]\n'
    docs = [(f"run={i}/decisions.json", good % i) for i in range(300)] + [("run=300/decisions.json", '[{"track_id": "1"')]
    packs.write_packed(spark.createDataFrame(docs, "path string, value string").coalesce(2), path)
    assert len(list((tmp_path / "runs.packed").glob("part-*"))) == 2
    decisions, bad = runs.read_decisions(spark, path)
    assert {(r.run_dir, r.track_id) for r in decisions.collect()} == {(f"run={i}", str(i)) for i in range(300)}
    assert [(r.run_dir, r.value) for r in bad.collect()] == [("run=300", '[{"track_id": "1"')]
    with pytest.raises(ValueError, match="packed"):
        packs.write_packed(spark.createDataFrame(docs, "path string, value string"), str(tmp_path / "x"))
    (tmp_path / "runs.packed" / "part-x.json").write_text('{"path": "run=3')
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        runs.read_decisions(spark, path)[0].collect()


def test_boxes_survive_a_pack_as_they_do_files(spark, tmp_path):
    frames = spark.createDataFrame([(v, f) for v in (1, 2) for f in range(3)], "source_video long, frame_index long")
    gt = spark.createDataFrame([(1, 0, 1, 2.0, 3.0, 5.0, 9.0, "drone"), (1, 0, 2, 1.0, 1.0, 4.0, 8.0, "bird"), (2, 2, 1, 7.0, 3.0, 9.0, 9.0, "drone")],
                               "source_video long, frame_index long, gt_index long, x1 double, y1 double, x2 double, y2 double, label string")
    seen = lambda df, *keys: sorted((*(str(r[k]) for k in keys), r.x1, r.y1, r.x2, r.y2, r.label) for r in df.collect())
    name = F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long")
    text.write_frame_text(frames, gt, f"{tmp_path}/t")
    text.write_frame_text(frames, gt, f"{tmp_path}/t.packed")
    files, pack = text.read_frame_text(spark, f"{tmp_path}/t", F.col("source_video").cast("long")), text.read_frame_text(spark, f"{tmp_path}/t.packed", name)
    assert seen(files[1], "source_video", "frame_index") == seen(pack[1], "source_video", "frame_index") and files[0].count() == pack[0].count() == 6
    one = gt.where("gt_index = 1")
    rects.write_rect_json(frames, one, f"{tmp_path}/r")
    rects.write_rect_json(frames, one, f"{tmp_path}/r.packed")
    keys = ("source_video", "frame_index", "track_id")
    assert seen(rects.read_rect_json(spark, f"{tmp_path}/r/*/*.txt")[1], *keys) == seen(rects.read_rect_json(spark, f"{tmp_path}/r.packed")[1], *keys) != []
    still = F.col("source_video") * 10 + F.col("frame_index")
    images = frames.select(still.alias("source_video"), F.concat(still.cast("string"), F.lit(".jpg")).alias("filename"), F.lit(40).alias("width"), F.lit(20).alias("height"))
    for at in ("x", "x.packed"):
        boxxml.write_box_xml(images, gt.withColumn("source_video", still), f"{tmp_path}/{at}")
    video = F.regexp_extract("filename", r"^(\d+)", 1).cast("long")
    a, b = (boxxml.reject_boxes(*boxxml.read_box_xml(spark, p, video)[:2]) for p in (f"{tmp_path}/x/*", f"{tmp_path}/x.packed"))
    assert seen(a[1], "source_video") == seen(b[1], "source_video") != [] and a[0].count() == b[0].count() == 6


def test_a_large_document_of_a_pack_is_refused_alone(spark, tmp_path):
    doc = "<annotation><filename>a.jpg</filename><size><width>9</width><height>9</height></size></annotation>"
    packs.write_packed(spark.createDataFrame([("a.xml", doc), ("b.xml", doc + " " * 400)], "path string, value string"), f"{tmp_path}/b.packed")
    images, _, bad = boxxml.read_box_xml(spark, f"{tmp_path}/b.packed", max_bytes=300)
    assert [r.source_video for r in images.collect()] == ["a"] and [(r.path, r.problem) for r in bad.collect()] == [("b.xml", "larger than the limit")]


def test_filters_stay_above_what_is_computed_once(spark):
    plain = spark.range(9).withColumn("v", F.split(F.col("id").cast("string"), "x")).where("size(v) > 0 AND v[0] <> '3'")
    kept = computed_once(spark.range(9), v=F.split(F.col("id").cast("string"), "x")).where("size(v) > 0 AND v[0] <> '3'")
    mentions = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("split(")
    assert kept.count() == plain.count() == 8 and mentions(kept) == 1
