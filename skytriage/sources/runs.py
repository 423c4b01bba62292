"""Decision records, labelled tracks, the track store and the site registry."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from skytriage.constants import FEATURES, MIN_TRACK_SECONDS
from skytriage.session import computed_once
from skytriage.sources import packs

# Names in a decision record -> names here. Fixed values; all others agree.
RECORD_NAMES = {"mean_speed": "mean_speed_px_per_frame"}

_DECISIONS = (
    "array<struct<track_id:string,job_id:string,site_id:string,verdict:string,attention:string,uncertainty:string,rule_id:string,"
    "synthetic:boolean,created_at:string,tool_calls:array<struct<tool_name:string,ok:boolean,arguments:string,result:string,error:string>>>>")
_ANALYSIS = ("features_available boolean, duration_seconds double, n_observations bigint, median_pixels_on_target double, features struct<"
             + ",".join(f"{RECORD_NAMES.get(f, f)}:double" for f in FEATURES) + ">")
TRACK_SCHEMA = ("track_id string, source_clip string, label string, label_basis string, asserted_by string, run_id string, duration_seconds double,"
                " n_observations bigint, median_pixels_on_target double, synthetic boolean, features struct<" + ",".join(f"{f}:double" for f in FEATURES) + ">")


def parse_decisions(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decisions, bad files) from run files read whole, a stream or a table of ``path, value``.

    Decisions carry ``run_dir`` and their ``position`` in the list. A file that is no list of
    records, or holds one without a track id, counts in none of its parts; it comes back with
    its path and text.
    """
    read = computed_once(files, records=F.from_json("value", _DECISIONS))
    broken = F.col("records").isNull() | F.exists("records", lambda r: r.isNull() | r["track_id"].isNull())
    run_dir = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    good = read.where(~broken).select(run_dir.alias("run_dir"), F.posexplode("records").alias("position", "r")).select("r.*", "run_dir", "position")
    return good, read.where(broken).select(run_dir.alias("run_dir"), "path", "value")


def read_decisions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(decisions, bad files) of all runs matching ``path``, files or a pack; see :func:`parse_decisions`."""
    return parse_decisions(packs.documents(spark, path))


def ingest_runs(decisions: DataFrame, labels: DataFrame, min_seconds: float = MIN_TRACK_SECONDS) -> tuple[DataFrame, DataFrame]:
    """(labelled tracks, counts per run).

    ``labels`` has ``run_dir, source_clip, label, asserted_by``: what somebody said about
    the clip, which is why every track gets the basis ``clip_provenance``. A record with
    features but without one of the nine stops the job. One synthetic record marks its
    whole run, and the first record names it.
    """
    if "position" not in decisions.columns:
        decisions = decisions.withColumn("position", F.lit(0))
    call = F.get(F.filter("tool_calls", lambda c: (c["tool_name"] == "analyze_track") & c["ok"] & c["result"].isNotNull()), F.lit(0))
    read = computed_once(decisions, a=F.from_json(call["result"], _ANALYSIS))
    secs = F.coalesce("a.duration_seconds", F.lit(0.0))
    state = (F.when(~F.coalesce("a.features_available", F.lit(False)), "without_features").when(secs < min_seconds, "too_short").otherwise("kept"))
    judged = read.withColumn("disposition", state)
    runs = judged.groupBy("run_dir").agg(
        F.count("*").alias("n_decisions"), F.count_if(F.col("disposition") == "kept").alias("n_kept"),
        F.count_if(F.col("disposition") == "without_features").alias("n_without_features"),
        F.count_if(F.col("disposition") == "too_short").alias("n_too_short"),
        F.coalesce(F.bool_or("synthetic"), F.lit(False)).alias("synthetic"), F.min_by("job_id", F.struct("position", "job_id")).alias("run_id"))

    def feature(name: str):
        col = F.col(f"a.features.{RECORD_NAMES.get(name, name)}")
        return F.coalesce(col, F.raise_error(F.concat(F.lit(f"no {name} in the analysis of "), F.col("track_id"))).cast("double")).alias(name)

    tracks = judged.where("disposition = 'kept'").join(labels, "run_dir").join(
        runs.select("run_dir", "run_id", F.col("synthetic").alias("_synthetic")), "run_dir").select(
        "track_id", "source_clip", "label", F.lit("clip_provenance").alias("label_basis"), "asserted_by", "run_id",
        F.col("a.duration_seconds").alias("duration_seconds"), F.coalesce("a.n_observations", F.lit(0)).alias("n_observations"),
        F.coalesce("a.median_pixels_on_target", F.lit(0.0)).alias("median_pixels_on_target"), F.col("_synthetic").alias("synthetic"),
        F.struct(*[feature(f) for f in FEATURES]).alias("features"))
    return tracks, runs


#: Folders of the store, by a hash of the track id; an append reads those that its ids fall into.
STORE_BUCKETS = 64


def _store_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """All lines, blank ones too, of the files below ``paths``, with where they were read; paths that match nothing hold none.

    ``at`` is where the split of a file begins and ``n`` counts up by one within it.
    """
    found = None
    for p in paths:
        try:
            lines = spark.read.option("recursiveFileLookup", True).text(p)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"),
                             F.trim("value").alias("line"))
        found = lines if found is None else found.unionByName(lines)
    return spark.createDataFrame([], "path string, at bigint, n bigint, line string") if found is None else found


def _parsed(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    read = computed_once(lines.where("line <> ''"), t=F.from_json("line", TRACK_SCHEMA + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    ok = F.col("t._corrupt").isNull() & F.col("t.track_id").isNotNull()
    return read.where(ok).select("t.*").drop("_corrupt"), read.where(~ok | ok.isNull()).select("path", "at", "n", "line")


def _line_numbers(lines: DataFrame, some: DataFrame) -> DataFrame:
    """``some`` rows of ``lines`` with ``line_number``, from 1 in their file.

    A line's number is its place in its split, plus the lines of the file's earlier splits:
    one row per split is summed up, the lines themselves are not moved.
    """
    splits = lines.groupBy("path", "at").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return some.join(splits.withColumn("before", before), ["path", "at"]).select("path", (F.col("before") + F.col("n") - F.col("first") + 1).alias("line_number"), "line")


def load_tracks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(tracks, bad rows with their file and line number) from JSON lines; blank lines are skipped but counted, an absent store is empty."""
    lines = _store_lines(spark, path)
    tracks, bad = _parsed(lines)
    return tracks, _line_numbers(lines, bad)


def unseen_tracks(new: DataFrame, stored: DataFrame | None) -> DataFrame:
    """New tracks, each id once, that the store does not hold yet.

    Of several rows with one id the first by clip and run counts.
    """
    rest = [c for c in new.columns if c != "track_id"]
    order = ["source_clip", "run_id"] + [c for c in rest if c not in ("source_clip", "run_id")]
    once = new.groupBy("track_id").agg(F.min(F.struct(*order)).alias("r")).select("track_id", *[F.col(f"r.{c}").alias(c) for c in rest])
    return once if stored is None else once.join(stored.select("track_id"), "track_id", "left_anti")


def append_tracks(new: DataFrame, path: str, first: bool = False, buckets: int = STORE_BUCKETS) -> None:
    """Append unseen tracks to the JSON-lines store, in folders by a hash of their id.

    Of the store only the folders that new ids fall into are read, and files that lie
    directly in ``path``. ``first`` says that there is nothing to read yet; an absent store
    is empty anyway. A store is always given the same number of ``buckets``.
    """
    spark = new.sparkSession
    bucket = F.pmod(F.xxhash64("track_id"), F.lit(buckets)).cast("int")
    stored = None
    if not first:
        touched = sorted(r["bucket"] for r in new.select(bucket.alias("bucket")).distinct().collect())  # at most ``buckets``
        named = [f"{path}/bucket={{{','.join(map(str, touched))}}}"] if touched else []
        stored = _parsed(_store_lines(spark, *named, f"{path}/*.json"))[0]
    columns = ["track_id", "source_clip", "label", "label_basis", "asserted_by", "run_id", "duration_seconds", "n_observations",
               "median_pixels_on_target", "synthetic", "features"]
    unseen_tracks(new, stored).select(*columns, bucket.alias("bucket")).repartition("bucket").write.partitionBy("bucket").mode("append").json(path)


_SITE = ("sites array<struct<site_id:string,name:string,zone_class:string,authorized_flights:array<struct<flight_id:string,operator:string,"
         "starts_at:string,ends_at:string,notes:string>>,restrictions:array<struct<restriction_id:string,reason:string,starts_at:string,ends_at:string>>>>")


# Fields that a registry may have; any other is an error. Fixed values.
_FIELDS = {
    "": ["sites"],
    "sites": ["site_id", "name", "zone_class", "authorized_flights", "restrictions"],
    "authorized_flights": ["flight_id", "operator", "starts_at", "ends_at", "notes"],
    "restrictions": ["restriction_id", "reason", "starts_at", "ends_at"],
}


def _unknown(value: Column, kind: str, where: Column) -> Column:
    """Paths of the fields of a JSON object that ``kind`` does not have, or the path itself if it is no object."""
    keys = F.json_object_keys(value)
    extra = F.transform(F.array_except(keys, F.array(*[F.lit(k) for k in _FIELDS[kind]])), lambda k: F.concat(where, F.when(where == "", "").otherwise("."), k))
    return F.when(keys.isNull(), F.array(where)).otherwise(extra)


def registry_faults(documents: DataFrame) -> DataFrame:
    """``file, field``: fields that a registry must not have, with their place in the document, at every level.

    ``documents`` has ``file, value``, one JSON document each. What is not an object where one
    is expected is named by its place, a document that is not JSON by the empty place.
    """
    entry = lambda name, i: F.concat(F.lit(name + "["), i.cast("string"), F.lit("]"))
    top = documents.select("file", _unknown(F.col("value"), "", F.lit("")).alias("unknown"), F.from_json("value", "sites array<string>")["sites"].alias("sites"))
    sites = top.select("file", F.posexplode("sites").alias("i", "site")).withColumn("place", entry("sites", F.col("i")))
    inner = F.from_json("site", "authorized_flights array<string>, restrictions array<string>")
    parts = sites.select("file", "place", _unknown(F.col("site"), "sites", F.col("place")).alias("unknown"), inner.alias("d"))
    out = top.select("file", "unknown").unionByName(parts.select("file", "unknown"))
    for kind in ("authorized_flights", "restrictions"):
        listed = parts.select("file", "place", F.posexplode(f"d.{kind}").alias("i", "entry"))
        out = out.unionByName(listed.select("file", _unknown(F.col("entry"), kind, F.concat("place", F.lit("."), entry(kind, F.col("i")))).alias("unknown")))
    return out.select("file", F.explode("unknown").alias("field"))


def site_dims(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sites, flights, restrictions) from registry documents, JSON (files or a pack) or YAML.

    A field that a registry does not have stops the job and is named with its place: a
    misspelt list of restrictions would otherwise be no restriction. The ordinal keeps the order in which a site lists its intervals. A flight has to end
    after it starts; restrictions are taken as they are; a site without a zone class is
    unrestricted. YAML has no reader in Spark, so
    that one small configuration file is turned into JSON first.
    """
    if path.endswith((".yaml", ".yml")):
        import yaml

        head = spark.read.format("binaryFile").load(path).select("content").first()
        text = json.dumps(yaml.safe_load(head["content"].decode("utf-8")), default=lambda v: v.isoformat())
        documents = spark.createDataFrame([(path, text)], "file string, value string")
    else:
        documents = packs.documents(spark, path).withColumnRenamed("path", "file")
    faults = registry_faults(documents).groupBy("file").agg(F.sort_array(F.collect_list("field")).alias("fields"))
    stop = F.raise_error(F.concat(F.lit("fields that a site registry does not have, in "), F.col("file"), F.lit(": "), F.array_join("fields", ", "))).cast("boolean")
    known = documents.join(faults, "file", "left").where(F.when(F.col("fields").isNull(), True).otherwise(stop))
    site = known.select(F.from_json("value", _SITE)["sites"].alias("sites")).select(F.explode("sites").alias("s")).select("s.*")
    sites = site.select("site_id", "name", F.coalesce("zone_class", F.lit("unrestricted")).alias("zone_class"))
    ts = lambda c: F.to_timestamp(F.col(c)).alias(c.split(".")[-1])
    flights = site.select("site_id", F.posexplode("authorized_flights").alias("ordinal", "f")).select(
        "site_id", "ordinal", "f.flight_id", "f.operator", ts("f.starts_at"), ts("f.ends_at"), "f.notes")
    flights = flights.withColumn("ends_at", F.when(F.col("ends_at") > F.col("starts_at"), F.col("ends_at")).otherwise(
        F.raise_error(F.concat(F.lit("flight must end after it starts: "), F.col("flight_id"))).cast("timestamp")))
    restrictions = site.select("site_id", F.posexplode("restrictions").alias("ordinal", "r")).select(
        "site_id", "ordinal", "r.restriction_id", "r.reason", ts("r.starts_at"), ts("r.ends_at"))
    return sites, flights, restrictions
