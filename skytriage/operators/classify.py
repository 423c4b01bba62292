"""The motion classifier: gates, fit, importance, grouped validation."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from skytriage.constants import FEATURES, MIN_TRACKS_TO_TRAIN
from skytriage.functions.permute import shuffled
from skytriage.operators.scan import ranked
from skytriage.session import durable


def fit_gate(tracks: DataFrame) -> DataFrame:
    """One row: counts, the refusal if training must not happen, and warnings."""
    per = tracks.groupBy("label").agg(F.count("*").alias("n"))
    classes = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_tracks"), F.count("*").alias("n_classes"), F.min("n").alias("smallest_class")).withColumn("_one", F.lit(1))
    groups = tracks.agg(F.countDistinct("source_clip").alias("n_groups")).withColumn("_one", F.lit(1))
    refusal = (F.when(F.col("n_tracks") == 0, "no tracks").when(F.col("n_tracks") < MIN_TRACKS_TO_TRAIN, "too few tracks")
               .when(F.col("n_classes") < 2, "fewer than two classes"))
    notes = F.array_compact(F.array(F.when(F.col("smallest_class") < 20, "smallest class below 20"), F.when(F.col("n_groups") < 3, "fewer than 3 groups")))
    return classes.join(groups, "_one").drop("_one").withColumns({"refusal": refusal, "warnings": F.when(refusal.isNull(), notes).otherwise(F.array().cast("array<string>"))})


def _pipeline(labels: list[str], seed: int, max_iter: int, learner: str) -> Pipeline:
    if learner == "boosted":
        base = GBTClassifier(maxIter=max_iter, seed=seed, maxDepth=4, featuresCol="inputs", labelCol="target")
        tree = OneVsRest(classifier=base, featuresCol="inputs", labelCol="target", predictionCol="prediction", parallelism=min(4, len(labels)))
    else:
        tree = RandomForestClassifier(numTrees=max_iter, seed=seed, featuresCol="inputs", labelCol="target")
    return Pipeline(stages=[StringIndexer(inputCol="label", outputCol="target", stringOrderType="alphabetAsc", handleInvalid="keep"),
                            VectorAssembler(inputCols=list(FEATURES), outputCol="inputs"), tree,
                            IndexToString(inputCol="prediction", outputCol="predicted", labels=labels)])


def fit_motion_arm(tracks: DataFrame, seed: int = 1337, max_iter: int = 200, learner: str = "forest") -> tuple[PipelineModel | None, DataFrame]:
    """(model or None, report). A refusal is a result, not an error.

    The default is a forest of ``max_iter`` trees, which knows any number of classes and
    gives each a probability. ``boosted`` gives as many rounds of boosted trees; these are
    binary in Spark, so classes are told apart one against the rest, and the probabilities
    that ``predict`` gives are those of the binary models, scaled to a sum of one.
    ``tracks`` has ``label, source_clip`` and the nine features.
    """
    report = fit_gate(tracks)
    if report.first()["refusal"]:
        return None, report
    labels = sorted(r["label"] for r in tracks.select("label").distinct().collect())  # a handful of classes
    return _pipeline(labels, seed, max_iter, learner).fit(tracks), report


def predict(model: PipelineModel, tracks: DataFrame) -> DataFrame:
    """Tracks with ``predicted``, ``probability``, a map by class, and ``confidence``, its largest value."""
    out = model.transform(tracks)
    labels = model.stages[0].labels
    if "probability" not in out.columns:  # margins of each class against the rest; boosting fits half the log-odds
        alone = F.transform(vector_to_array("rawPrediction"), lambda m: 1 / (1 + F.exp(-2 * m)))
        out = out.withColumn("_alone", alone)
        total = F.aggregate("_alone", F.lit(0.0), lambda a, x: a + x)
        p = F.transform("_alone", lambda x: x / total)
    else:
        p = F.slice(vector_to_array("probability"), 1, len(labels))
    out = out.withColumn("probability", F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), p)).withColumn(
        "confidence", F.array_max(F.map_values("probability"))).drop("_alone")
    return out.drop("inputs", "rawPrediction", "target", "prediction")


def training_report(model: PipelineModel, tracks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tracks and clips per class, share of each feature in the splits of the trees)."""
    per_class = tracks.groupBy("label").agg(F.count("*").alias("n_tracks"), F.countDistinct("source_clip").alias("n_clips"))
    trees = model.stages[2]
    parts = getattr(trees, "models", [trees])
    shares = [sum(float(m.featureImportances[k]) for m in parts) / len(parts) for k in range(len(FEATURES))]
    return per_class, tracks.sparkSession.createDataFrame(list(zip(FEATURES, shares)), "feature string, share double")


def permutation_importance(model: PipelineModel, tracks: DataFrame, repeats: int = 5, seed: int = 1337) -> DataFrame:
    """Mean loss of accuracy per feature when its values are dealt to other tracks.

    A dealing is a keyed permutation of the tracks' numbers that every task computes for
    itself, so values are fetched by one join on the number of the track instead of a global
    shuffle of the column, and no order of the tracks shows through.
    """
    numbered = durable(ranked(tracks.select("track_id", "label", *FEATURES), [], [F.col("track_id")], "i"))
    n = numbered.count()
    plan = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(r).alias("r")) for f in range(len(FEATURES)) for r in range(repeats)])
    key = F.struct(F.lit(seed), F.col("f"), F.col("r"))
    # A fixed number of partitions: dealing and predicting cost far more per byte than the sizes by
    # which adaptive execution merges partitions would suggest; the tracks themselves may fit in one.
    parts = int(tracks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = numbered.repartition(parts, "i").select("i", "label", F.array(*FEATURES).alias("v"), F.explode_outer(plan).alias("d")).select("i", "label", "v", "d.f", "d.r").select(
        "label", "v", "f", "r", shuffled(F.col("i"), n, key).alias("j"))
    other = numbered.select(F.col("i").alias("j"), F.array(*FEATURES).alias("o"))
    dealt = asked.repartition(parts, "j").join(other, "j").select("label", "f", "r", F.transform("v", lambda x, k: F.when(k == F.col("f"), F.get("o", k)).otherwise(x)).alias("v"))
    wide = dealt.select("label", "f", "r", *[F.col("v")[k].alias(name) for k, name in enumerate(FEATURES)])
    acc = model.transform(wide).groupBy("f", "r").agg(F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("acc"))
    base = model.transform(numbered).agg(F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("base")).withColumn("_one", F.lit(1))
    names = F.array(*[F.lit(x) for x in FEATURES])
    return acc.withColumn("_one", F.lit(1)).join(base, "_one").groupBy("f").agg(F.avg(F.col("base") - F.col("acc")).alias("importance")).select(
        F.get(names, F.col("f")).alias("feature"), "importance")


def clip_folds(tracks: DataFrame, k: int, seed: int = 1337) -> DataFrame:
    """``source_clip, fold``: clips in the order of a keyed hash, dealt round robin."""
    clips = tracks.select("source_clip").distinct()
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("source_clip").cast("string")), 256)
    return ranked(clips.withColumn("_h", key), [], [F.col("_h")]).select("source_clip", (F.col("position") % k).cast("int").alias("fold"))


def cross_validate(tracks: DataFrame, k: int = 5, seed: int = 1337, max_iter: int = 200, learner: str = "forest") -> DataFrame:
    """Out-of-fold predictions; all tracks of a clip are held out together."""
    folded = durable(tracks.join(clip_folds(tracks, k, seed), "source_clip"))
    out = None
    for fold in range(k):
        held = folded.where(F.col("fold") == fold)
        model, _ = fit_motion_arm(folded.where(F.col("fold") != fold), seed, max_iter, learner)
        part = (predict(model, held).select(*folded.columns, "predicted") if model is not None
                else held.withColumn("predicted", F.lit(None).cast("string")))
        out = part if out is None else out.unionByName(part)
    return out
