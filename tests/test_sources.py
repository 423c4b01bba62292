"""Malformed input, quarantine and store semantics."""

import json
import os

import pytest
from pyspark.sql import functions as F

from skytriage.operators.catalogue import media_limits_gate
from skytriage.operators.splits import grouped_split, split_sizes
from skytriage.sources import boxxml, coco, rects, runs, text


def put(path, body):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(body)


def test_frame_text(spark, tmp_path):
    put(f"{tmp_path}/a.txt", "3 1 10 20 4 4 Bird\n\n  1 0\n2 2 0 0 5 5 uav 1 1 2 2 kite\n9\nx 1 0 0 1 1 drone\n4 -1\n5 1 0 0 1 1\n6 1 0 0 zz 1 drone\n7 1 0 0 0 1 drone\n")
    frames, gt, bad = text.read_frame_text(spark, str(tmp_path))
    assert sorted(r.frame_index for r in frames.collect()) == [1, 2, 3]
    got = {(r.frame_index, r.gt_index): (r.x1, r.y1, r.x2, r.y2, r.label) for r in gt.collect()}
    assert got == {(3, 0): (10, 20, 14, 24, "bird"), (2, 0): (0, 0, 5, 5, "drone"), (2, 1): (1, 1, 3, 3, "unknown")}
    assert sorted(r.problem for r in bad.collect()) == sorted([
        "fewer than two fields", "frame and count must be integers", "negative object count", "field count does not match", "non-numeric box", "non-positive size"])
    assert text.frame_index_base(frames).first().frame_index_base == 1


def test_rect_json(spark, tmp_path):
    docs = {"b": {"gt_rect": [[1, 2, 3, 4], [], [0, 0, 0, 0], [5, 5, 2, 2]]}, "a": {"gt_rect": [[1, 1, 1, 1], [9, 9, 9, 9]], "exist": [0, 1]},
            "c": {"gt_rect": [[1, 1, 1, 1]], "exist": [1, 1]}, "d": {"boxes": []}, "e": {"gt_rect": [[1, 2, 0, 4], "x"], "exist": [1, 1]}}
    for name, d in docs.items():
        put(f"{tmp_path}/{name}/IR_label.json", json.dumps(d))
    put(f"{tmp_path}/f/IR_label.json", "{nope")
    frames, gt, bad = rects.read_rect_json(spark, f"{tmp_path}/*/IR_label.json")
    assert {(r.source_video, r.frame_index) for r in frames.collect()} >= {("b", i) for i in range(4)} | {("a", 0), ("a", 1)}
    assert {(r.source_video, r.frame_index, r.x2, r.track_id) for r in gt.collect()} == {("b", 0, 4.0, 1), ("b", 3, 7.0, 1), ("a", 1, 18.0, 0)}
    assert sorted(r.problem for r in bad.collect()) == sorted([
        "exist and gt_rect differ in length", "no gt_rect list", "not valid JSON", "non-positive size", "present but not four numbers"])
    two = spark.createDataFrame([("v", 0, i, 0.0, 0.0, 1.0, 1.0) for i in range(2)], "source_video string, frame_index long, gt_index long, x1 double, y1 double, x2 double, y2 double")
    with pytest.raises(Exception, match="one object per frame"):
        rects.write_rect_json(two.select("source_video", "frame_index").distinct(), two, f"{tmp_path}/out")


def voc(name, objs, extra=""):
    body = "".join(f"<object><name>{n}</name><bndbox><xmin>{a}</xmin><ymin>{b}</ymin><xmax>{c}</xmax><ymax>{d}</ymax></bndbox></object>" for n, a, b, c, d in objs)
    return f"{extra}<annotation><filename>{name}.jpg</filename><size><width>100</width><height>80</height><depth>3</depth></size>{body}</annotation>"


def test_box_xml(spark, tmp_path):
    put(f"{tmp_path}/ok.xml", voc("ok", [("UAV", 1, 1, 1, 1), ("aeroplane", 5, 5, 100, 80)]))
    put(f"{tmp_path}/none.xml", voc("none", []))
    put(f"{tmp_path}/edge.xml", voc("edge", [("bird", 5, 5, 20, 20), ("bird", 5, 5, 101, 20)]))
    put(f"{tmp_path}/zero.xml", voc("zero", [("bird", 0, 5, 20, 20)]))
    put(f"{tmp_path}/evil.xml", voc("evil", [("bird", 5, 5, 20, 20)], '<!DOCTYPE x [<!ENTITY a "b">]>'))
    put(f"{tmp_path}/half.xml", voc("half", [("bird", 5, 5, "", 20)]))
    images, raw, bad = boxxml.read_box_xml(spark, f"{tmp_path}/*.xml")
    assert {os.path.basename(r.path) for r in bad.collect()} == {"evil.xml", "half.xml"}
    frames, gt, rejects = boxxml.reject_boxes(images, raw)
    assert {r.source_video for r in frames.collect()} == {"ok", "none"}
    assert {(r.x1, r.y1, r.x2, r.y2, r.label) for r in gt.collect()} == {(0, 0, 1, 1, "drone"), (4, 4, 100, 80, "aircraft")}
    assert {(r.source_video, r.reason) for r in rejects.collect()} == {("edge", "past the frame edge"), ("zero", "outside the image")}
    row = boxxml.reconcile(images, raw).first()
    assert (row.n_source_objects, row.n_converted, row.n_rejected, row.n_lost_with_dropped, row.n_genuine_negatives) == (5, 2, 2, 1, 1)
    assert row.objects_reconcile and row.frames_reconcile
    assert boxxml.index_base_evidence(raw).first().verdict == "contradictory"
    assert boxxml.index_base_evidence(raw.where("source_video <> 'zero'"), "zero").first().contradicts_applied
    assert boxxml.index_base_evidence(raw.limit(0)).first().verdict == "empty"


def test_box_xml_refusals(spark, tmp_path):
    put(f"{tmp_path}/corner.xml", voc("corner", [("bird", 5, 5, 20, 20), ("bird", 5, 5, "x", 20)]))
    put(f"{tmp_path}/cut.xml", voc("cut", [("bird", 5, 5, 20, 20), ("bird", 5, 5, 20, 20)])[:-60])
    put(f"{tmp_path}/large.xml", voc("large", [("bird", 5, 5, 20, 20)]) + " " * boxxml.MAX_BYTES)
    put(f"{tmp_path}/blank.xml", "\n")
    with open(f"{tmp_path}/latin.xml", "wb") as f:
        f.write(voc("é", [("bird", 5, 5, 20, 20)]).encode("latin-1"))
    put(f"{tmp_path}/list.xml", f"<annotations>{voc('l1', [('bird', 5, 5, 20, 20)])}{voc('l2', [])}</annotations>")
    put(f"{tmp_path}/none.xml", "<?xml version='1.0'?><annotations/>")
    images, raw, bad = boxxml.read_box_xml(spark, f"{tmp_path}/*.xml")
    problems = {os.path.basename(r.path): r.problem for r in bad.collect()}
    assert set(problems) == {"corner.xml", "cut.xml", "large.xml", "blank.xml", "latin.xml"}
    assert problems["corner.xml"] == "object without name or integer corners" and problems["latin.xml"] == "not UTF-8"
    assert problems["large.xml"] == "larger than the limit"
    assert sorted(r.filename for r in images.collect()) == ["l1.jpg", "l2.jpg"] and raw.count() == 1


def test_store_reads_touched_buckets_and_older_files(spark, tmp_path):
    store = f"{tmp_path}/store"
    assert runs.load_tracks(spark, store)[0].count() == 0 and runs.load_tracks(spark, store)[1].count() == 0
    feats = "named_struct(" + ",".join(f"'{f}', 1.0D" for f in runs.FEATURES) + ")"

    def batch(low, high):
        return spark.range(low, high).selectExpr(
            "cast(id as string) track_id", "'c' source_clip", "'bird' label", "'clip_provenance' label_basis", "'me' asserted_by", "'r' run_id",
            "3.0D duration_seconds", "9L n_observations", "14.0D median_pixels_on_target", "false synthetic", f"{feats} features")

    put(f"{store}/old.json", '{"track_id": "3", "source_clip": "old"}\n')
    runs.append_tracks(batch(0, 5), store)
    runs.append_tracks(batch(2, 9), store)
    runs.append_tracks(batch(0, 0), store)
    tracks, bad = runs.load_tracks(spark, store)
    assert sorted((r.track_id, r.source_clip) for r in tracks.collect()) == [(str(i), "old" if i == 3 else "c") for i in range(9)]
    assert bad.count() == 0


def test_frame_text_files_per_video(spark, tmp_path):
    frames = spark.range(40).selectExpr("cast(id % 2 as string) source_video", "id frame_index")
    gt = frames.selectExpr("*", "0L gt_index", "1.0D x1", "1.0D y1", "3.0D x2", "3.0D y2", "'drone' label").where("frame_index % 3 = 0")
    text.write_frame_text(frames, gt, f"{tmp_path}/out", frames_per_file=20)
    for video in (0, 1):
        files = [f for f in os.listdir(f"{tmp_path}/out/source_video={video}") if f.endswith(".txt")]
        assert 1 <= len(files) <= 2
    back, boxes, bad = text.read_frame_text(spark, f"{tmp_path}/out", F.col("source_video").cast("string"))
    assert back.count() == 40 and boxes.count() == 14 and bad.count() == 0


def test_coco_document(spark, tmp_path):
    doc = {"images": [{"id": 7, "file_name": "a.jpg", "width": 10, "height": 10, "source_video": "v"}, {"id": 3, "file_name": "b.jpg", "width": 10, "height": 10}],
           "annotations": [{"id": 1, "image_id": 7, "category_id": 2, "bbox": [1, 2, 3, 4]}], "categories": [{"id": 2, "name": "bird"}]}
    put(f"{tmp_path}/x.json", json.dumps(doc, indent=1))
    images, boxes, info = coco.read_coco(spark, f"{tmp_path}/x.json")
    assert [r.image_id for r in images.orderBy("position").collect()] == [7, 3]
    b = boxes.first()
    assert (b.x1, b.y1, b.x2, b.y2) == (1, 2, 4, 6) and not info.first().has_video_grouping
    del doc["categories"]
    put(f"{tmp_path}/y.json", json.dumps(doc))
    with pytest.raises(Exception, match="needs images"):
        coco.read_coco(spark, f"{tmp_path}/y.json")[0].collect()


ODD_DOCUMENT = {
    "info": {"by": {"name": "a } ] { [ \" quote \\"}, "years": [[1, 2], [{"x": {}}]]}, "licenses": [], "images": [
        {"id": 1, "file_name": "br}ace{.jpg", "width": 1, "height": 2, "source_video": "v\\\\", "extra": {"deep": [{"a": 1}, {"b": "}"}]}},
        {"id": 2, "file_name": "quo\"te\\}.jpg", "width": 1, "height": 2, "source_video": "été日本}{"}, {}],
    "empty": [], "annotations": [{"id": 5, "image_id": 1, "category_id": 2, "bbox": [1, 2, 3, 4], "segmentation": [[1, 2], [3]]}, {"id": 6, "image_id": 2, "bbox": [0, 0, 1, 1]}],
    "categories": [], "images_of": [{"id": 99}]}


@pytest.mark.parametrize("indent, ascii_only, tail, split", [(None, True, "", "1g"), (1, False, "\n", "64b"), (None, False, " \n\n", "16b"), (2, True, "", "7b")])
def test_documents_are_read_in_pieces(spark, tmp_path, indent, ascii_only, tail, split):
    from skytriage.sources.json_document import document_records

    for k, doc in enumerate((ODD_DOCUMENT, {"categories": [{"id": 1}], "annotations": [], "images": [{"id": 8, "file_name": "z"}] * 30})):
        put(f"{tmp_path}/{k}.json", json.dumps(doc, indent=indent, ensure_ascii=ascii_only) + tail)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = document_records(spark, f"{tmp_path}/*.json", ["images", "annotations", "categories"]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = {(r.file[-6:], r.section, r.position): json.loads(r.record) for r in rows}
    want = {(f"{k}.json", s, i): x for k, doc in enumerate((ODD_DOCUMENT, {"categories": [{"id": 1}], "images": [{"id": 8, "file_name": "z"}] * 30}))
            for s in ("images", "annotations", "categories") for i, x in enumerate(doc.get(s, []))}
    assert {(k[0][-6:], *k[1:]): v for k, v in got.items()} == want and len(rows) == len(want)


def test_packed_documents_are_read_alike(spark, tmp_path):
    from skytriage.sources import packs

    other = {"categories": [{"id": 1}], "annotations": [], "images": [{"id": 8, "file_name": "z"}] * 30}
    docs = {f"{k}-{style}.json": json.dumps(doc, indent=style, ensure_ascii=style is None) + ("" if style else " \n\n") for k, doc in enumerate((ODD_DOCUMENT, other)) for style in (None, 1)}
    for name, text in docs.items():
        put(f"{tmp_path}/files/{name}", text)
    packs.write_packed(spark.createDataFrame(list(docs.items()), "path string, value string"), f"{tmp_path}/x.packed")
    apart, together = ([sorted(map(str, df.collect())) for df in coco.read_coco(spark, p)] for p in (f"{tmp_path}/files/*.json", f"{tmp_path}/x.packed"))
    assert apart == together and len(together[0]) == 66


@pytest.mark.parametrize("text", ['{"images": [], "annotations": [], "categories": []', '{"images": [{"id": 1}], "annotations": [], "categories": [], "x": "', '{"images": [], "annotations": []}',
                                  '{"images": [], "annotations": [], "categories": []}}', '{"images": [{"id": "x"}], "annotations": [], "categories": []}', ""])
def test_broken_packed_documents_stop_the_job(spark, tmp_path, text):
    from skytriage.sources import packs

    good = json.dumps({"images": [{"id": 1}], "annotations": [], "categories": []})
    packs.write_packed(spark.createDataFrame([("a", good), ("b", text)], "path string, value string"), f"{tmp_path}/x.packed")
    with pytest.raises(Exception, match="not one whole JSON document|needs images|MALFORMED_RECORD"):
        coco.read_coco(spark, f"{tmp_path}/x.packed")[0].collect()


def test_landmarks_are_found_once_per_piece(spark, tmp_path):
    from skytriage.sources.json_document import document_records

    put(f"{tmp_path}/x.json", json.dumps(ODD_DOCUMENT))
    plan = document_records(spark, f"{tmp_path}/x.json", ["images"])._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan


@pytest.mark.parametrize("text", ['{"images": [{"id": 1}], "annotations": [], "categories": []', '{"images": [{"id": 1}], "annotations": [], "categories": [], "x": "', '{"images": [{"id": 1}', '{"images": [], "annotations": [], "categories": []}}'])
def test_broken_documents_stop_the_job(spark, tmp_path, text):
    put(f"{tmp_path}/x.json", json.dumps({"images": [{"id": 1}], "annotations": [], "categories": []}))
    assert coco.read_coco(spark, f"{tmp_path}/x.json")[0].count() == 1
    put(f"{tmp_path}/y.json", text)
    with pytest.raises(Exception, match="not one whole JSON document|needs images"):
        coco.read_coco(spark, f"{tmp_path}/y.json")[0].collect()


def test_track_store_and_registry(spark, tmp_path):
    feats = "named_struct(" + ",".join(f"'{f}', 1.0D" for f in runs.FEATURES) + ")"
    new = spark.range(5).selectExpr("cast(id % 3 as string) track_id", "'c' source_clip", "'bird' label", "'clip_provenance' label_basis", "'me' asserted_by",
                                    "cast(id as string) run_id", "3.0D duration_seconds", "9L n_observations", "14.0D median_pixels_on_target", "false synthetic", f"{feats} features")
    store = f"{tmp_path}/store"
    runs.append_tracks(new, store, first=True)
    runs.append_tracks(new, store)
    put(f"{store}/extra.json", "\n{broken\n")
    tracks, bad = runs.load_tracks(spark, store)
    assert sorted((r.track_id, r.run_id) for r in tracks.collect()) == [("0", "0"), ("1", "1"), ("2", "2")]
    assert [r.line for r in bad.collect()] == ["{broken"]
    site = {"site_id": "s", "name": "S", "zone_class": "restricted", "restrictions": [], "authorized_flights": [
        {"flight_id": "f", "operator": "o", "starts_at": "2026-01-02T00:00:00Z", "ends_at": "2026-01-01T00:00:00Z"}]}
    put(f"{tmp_path}/sites.json", json.dumps({"sites": [site]}))
    sites, flights, _ = runs.site_dims(spark, f"{tmp_path}/sites.json")
    assert sites.first().zone_class == "restricted"
    with pytest.raises(Exception, match="must end after"):
        flights.collect()


def test_ingest_missing_feature_fails(spark):
    d = spark.createDataFrame([("t", "j", True, '{"features_available": true, "duration_seconds": 3, "features": {"speed_variance": 1}}')], "track_id string, job_id string, ok boolean, result string")
    d = d.selectExpr("track_id", "job_id", "false synthetic", "'r' run_dir", "array(named_struct('tool_name', 'analyze_track', 'ok', ok, 'result', result)) tool_calls")
    labels = spark.createDataFrame([("r", "c", "bird", "me")], "run_dir string, source_clip string, label string, asserted_by string")
    with pytest.raises(Exception, match="no mean_speed"):
        runs.ingest_runs(d, labels)[0].collect()


def test_splits(spark):
    assert [split_sizes(n, 0.7, 0.15) for n in (3, 4, 10, 30)] == [(1, 1), (2, 1), (7, 2), (21, 4)]
    def parts(n):
        return {r.source_video: r.split for r in grouped_split(spark.range(n).selectExpr("concat('v', id) source_video"), 5).collect()}
    a, b = parts(200), parts(201)
    assert sum(a[v] != b[v] for v in a) <= 3 and parts(200) == a
    with pytest.raises(ValueError, match="at least 3"):
        parts(2)
    with pytest.raises(ValueError, match="duplicate"):
        grouped_split(spark.createDataFrame([("x",)] * 4, "source_video string"), 1)


def test_media_gate(spark):
    rows = [(0, 10, 30.0, 5.0), (5000, 10, 30.0, 5.0), (10, 10, 0.0, 5.0), (10, 10, 121.0, 5.0), (10, 10, 30.0, 301.0), (4096, 4096, 120.0, 300.0), (640, 480, 30.0, 10.0)]
    ok, bad = media_limits_gate(spark.createDataFrame(rows, "width int, height int, fps double, duration_seconds double"))
    assert ok.count() == 1 and {r.violation for r in bad.collect()} == {"invalid dimensions", "resolution", "invalid frame rate", "frame rate", "duration", "total pixels"}


def test_bad_lines_have_their_number_in_a_file_of_several_splits(spark, tmp_path):
    lines = [f'{{"track_id": "{k}"}}' for k in range(400)]
    want = {}
    for k in (0, 7, 133, 134, 398):
        lines[k] = f'broken {k}'
        want[k + 1] = lines[k]
    lines[5] = lines[6] = lines[250] = "  "
    put(f"{tmp_path}/store/a.json", "\n".join(lines))
    put(f"{tmp_path}/store/b.json", "\n\nbroken\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        tracks, bad = runs.load_tracks(spark, f"{tmp_path}/store")
        assert tracks.count() == 400 - 5 - 3
        rows = bad.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {r.line_number: r.line for r in rows if r.path.endswith("a.json")} == want
    assert [(r.line_number, r.line) for r in rows if r.path.endswith("b.json")] == [(3, "broken")]


def test_registry_refuses_fields_it_does_not_have(spark, tmp_path):
    flight = {"flight_id": "f", "operator": "o", "starts_at": "2024-01-01T00:00:00Z", "ends_at": "2024-01-02T00:00:00Z", "notes": ""}
    put(f"{tmp_path}/good.json", json.dumps({"sites": [{"site_id": "a", "name": "A", "zone_class": "restricted", "authorized_flights": [flight], "restrictions": []}]}))
    assert runs.site_dims(spark, f"{tmp_path}/good.json")[1].count() == 1
    bad = {"sites": [{"site_id": "a", "restrictoins": []}, {"site_id": "b", "authorized_flights": [flight, flight | {"pilot": 1}], "restrictions": [{"reason": "r", "until": "x"}, 7]}], "version": 2}
    put(f"{tmp_path}/bad.json", json.dumps(bad))
    put(f"{tmp_path}/text.json", "not json")
    documents = spark.read.text(f"{tmp_path}/*.json", wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    assert sorted((r.file.rsplit("/", 1)[1], r.field) for r in runs.registry_faults(documents).collect()) == sorted(
        [("bad.json", f) for f in ("version", "sites[0].restrictoins", "sites[1].authorized_flights[1].pilot", "sites[1].restrictions[0].until", "sites[1].restrictions[1]")] + [("text.json", "")])
    for part in range(3):
        with pytest.raises(Exception, match="does not have.*bad.json.*restrictoins"):
            runs.site_dims(spark, f"{tmp_path}/bad.json")[part].collect()


def test_frames_are_not_taken_for_a_small_table(spark):
    from skytriage.plans.fixtures import view

    frames = view(spark, "/root/testdata/sf0.01", "fx_frames")
    estimate = frames._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert int(str(estimate)) >= 16 * frames.count() > 0
