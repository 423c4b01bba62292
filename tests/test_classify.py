"""Gates, refusals and grouped validation of the motion classifier; labels and streams of runs."""

import random

import pytest
from pyspark.sql import functions as F

from skytriage.constants import FEATURES
from skytriage.functions.permute import shuffled
from skytriage.operators import classify, separation as sp


def tracks(spark, n, classes=2, clips=6):
    df = spark.range(n).select(
        F.concat(F.lit("t"), F.col("id")).alias("track_id"), F.concat(F.lit("class"), F.col("id") % classes).alias("label"),
        F.concat(F.lit("clip"), F.floor(F.col("id") / 2) % clips).alias("source_clip"),
        # Only the first feature tells the classes apart.
        *[((F.col("id") % classes) * 5.0 + (F.col("id") % 7) * 0.1 if i == 0 else (F.hash("id", F.lit(i)) % 100).cast("double")).alias(f) for i, f in enumerate(FEATURES)])
    return df


def test_refusals(spark):
    for df, why in ((tracks(spark, 0), "no tracks"), (tracks(spark, 19), "too few tracks"), (tracks(spark, 30, classes=1), "fewer than two classes")):
        model, report = classify.fit_motion_arm(df)
        assert model is None and report.first().refusal == why
    row = classify.fit_gate(tracks(spark, 30, clips=2)).first()
    assert row.refusal is None and row.warnings == ["smallest class below 20", "fewer than 3 groups"]


def test_fit_importance_and_folds(spark):
    df = tracks(spark, 60).cache()
    model, _ = classify.fit_motion_arm(df, max_iter=10, learner="forest")
    assert classify.predict(model, df).where("predicted <> label").count() <= 3
    imp = {r.feature: r.importance for r in classify.permutation_importance(model, df, repeats=2).collect()}
    assert set(imp) == set(FEATURES) and max(imp, key=imp.get) == FEATURES[0] and imp[FEATURES[0]] > 0.1
    cv = classify.cross_validate(df, k=3, max_iter=5, learner="forest")
    assert cv.count() == 60 and cv.groupBy("source_clip").agg(F.countDistinct("fold").alias("n")).where("n > 1").isEmpty()


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 21, 1000, 4099])
def test_shuffles_are_permutations(spark, n):
    rows = spark.range(n).select("id", *[shuffled(F.col("id"), n, F.struct(F.lit(k), F.lit("x"))).alias(f"p{k}") for k in range(3)]).orderBy("id").collect()
    for k in range(3):
        assert sorted(r[f"p{k}"] for r in rows) == list(range(n))
    if n >= 1000:
        # Nothing is left of the order: few fixed points, half of the steps go up, rows of a kind do not stay together.
        p = [r["p0"] for r in rows]
        assert sum(i == x for i, x in enumerate(p)) < 10 and 0.45 < sum(x < y for x, y in zip(p, p[1:])) / n < 0.55
        assert 0.45 < sum(x % 2 == i % 2 for i, x in enumerate(p)) / n < 0.55 and [r["p0"] for r in rows] != [r["p1"] for r in rows]


def test_importance_of_a_feature_that_follows_the_order_of_tracks(spark):
    # The class alternates with the number of the track, and so does the feature that tells it: a rotation of the
    # order would keep all pairs right or turn all of them wrong; dealt at random half of them stay right.
    t = spark.range(200).select(F.format_string("t%04d", "id").alias("track_id"), F.when(F.col("id") % 2 == 0, "bird").otherwise("drone").alias("label"),
                                (F.floor(F.col("id") / 10)).cast("string").alias("source_clip"), *[(F.col("id") % 2 * 10.0 if f == FEATURES[0] else F.lit(1.0)).alias(f) for f in FEATURES])
    model, _ = classify.fit_motion_arm(t, max_iter=10)
    imp = {r.feature: r.importance for r in classify.permutation_importance(model, t, repeats=4).collect()}
    assert 0.4 < imp[FEATURES[0]] < 0.6 and all(v == 0 for f, v in imp.items() if f != FEATURES[0])


def test_compare_arms(spark):
    def verdict(rows):
        s = spark.createDataFrame([(arm, b, c, t) for arm, b, c, t in rows], "arm string, bucket string, correct int, total int")
        preds = s.select("arm", "bucket", F.explode(F.sequence(F.lit(1), "total")).alias("i"), "correct").select("arm", "bucket", (F.col("i") <= F.col("correct")).alias("correct"))
        return sp.compare_arms(sp.bucket_scores(preds)).first()
    win = [("appearance", "<8px", 20, 100), ("motion", "<8px", 80, 100)]
    lose = [("appearance", "8-16px", 90, 100), ("motion", "8-16px", 10, 101)]
    assert verdict(win).motion_wins is True and verdict(win + lose).motion_wins is False
    assert verdict(win + lose).unequal_buckets == "8-16px"
    assert verdict([("appearance", "<8px", 5, 10), ("motion", "<8px", 6, 10)]).motion_wins is None
    assert verdict([("appearance", ">32px", 1, 100), ("motion", ">32px", 99, 100)]).motion_wins is None


def test_disjoint_ranges(spark):
    df = tracks(spark, 40)
    ranges, pairs, summary = sp.separate(df)
    assert [(r.feature, r.label_a, r.label_b) for r in pairs.collect()] == [(FEATURES[0], "class0", "class1")]
    r = ranges.where(f"feature = '{FEATURES[0]}' AND label = 'class0'").first()
    assert r.n == 20 and r.low == 0 and r.high == pytest.approx(0.6)
    s = summary.first()
    assert s.found == 1 and not s.at_or_below_chance


def test_first_decisions_are_kept_for_good_and_replays_change_nothing(spark, tmp_path):
    from skytriage.streaming import flows

    store, shape = f"{tmp_path}/store", "track_id string, created_at timestamp, verdict string"
    batch = lambda rows: spark.createDataFrame(rows, "track_id string, created_at long, verdict string").withColumn("created_at", F.timestamp_seconds("created_at"))
    parts = [[("a", 100, "watch"), ("a", 50, "dismiss"), ("a", 50, "escalate"), (None, 1, "watch")], [("b", 7, "watch"), ("a", 1, "escalate")], [], [("b", 9, "dismiss"), ("c", 3, None), ("c", 3, None)]]
    want = [("a", "dismiss", 0), ("b", "watch", 1), ("c", None, 3)]
    read = lambda: sorted((r.track_id, r.verdict, r.batch) for r in flows.first_decisions(spark, shape, store).collect())
    for k, rows in enumerate(parts):
        flows.record_first(batch(rows), k, store, 4)
    assert read() == want
    for k in (3, 1, 0, 1):
        flows.record_first(batch(parts[k]), k, store, 4)
        assert read() == want


def test_late_rows_are_counted_and_kept(spark, tmp_path):
    from skytriage.streaming import flows

    store = f"{tmp_path}/late"
    batch = lambda rows: spark.createDataFrame([(s, n) for s, n in rows], "s long, n int").select(F.timestamp_seconds("s").alias("ts"), "n")
    hour = 3600
    parts = [[(5 * hour, 1), (10 * hour + 600, 2), (None, 3)], [(8 * hour, 4), (9 * hour, 5), (10 * hour - 1, 6), (10 * hour, 7)], [], [(10 * hour, 8), (30 * hour, 9)], [(28 * hour, 10), (29 * hour, 11)]]
    # The watermark of the second part is at ten o'clock: the window from nine to ten has just ended.
    want = {0: [], 1: [4, 5, 6], 2: [], 3: [], 4: [10]}
    for k in (*range(len(parts)), 1, 3):
        flows.record_late(batch(parts[k]), k, store)
    counts = {r.batch: (r.n_rows, r.n_late) for r in spark.read.parquet(f"{store}/counts").collect()}
    kept = {}
    for r in spark.read.parquet(f"{store}/rows").collect():
        kept.setdefault(r.batch, []).append(r.n)
    assert counts == {k: (len(parts[k]), len(v)) for k, v in want.items()}
    assert {k: sorted(v) for k, v in kept.items()} == {k: v for k, v in want.items() if v}


def test_boosted_trees_give_probabilities_of_every_class(spark):
    rng = random.Random(12)
    rows = [(k, "abc"[k % 3], f"c{k % 4}", *[k % 3 + rng.random() / 2 if f == FEATURES[0] else rng.random() for f in FEATURES]) for k in range(90)]
    t = spark.createDataFrame(rows, "track_id bigint, label string, source_clip string, " + ", ".join(f"{f} double" for f in FEATURES))
    model, _ = classify.fit_motion_arm(t, max_iter=5, learner="boosted")
    out = classify.predict(model, t).collect()
    assert len(out) == 90 and all(r["predicted"] == r["label"] for r in out)
    for r in out:
        assert set(r["probability"]) == set("abc") and abs(sum(r["probability"].values()) - 1) < 1e-9
        assert r["confidence"] == r["probability"][r["predicted"]] > 0.5
    assert set(out[0].asDict()) == {*t.columns, "predicted", "probability", "confidence"}


def test_importance_is_spread_over_tasks(spark):
    """Tracks that fit one partition are dealt and predicted by many tasks."""
    df = spark.range(60).selectExpr("cast(id as string) track_id", "if(id % 2 = 0, 'bird', 'drone') label", "id % 6 source_clip", *[f"cast(id % 2 as double) {f}" for f in FEATURES]).coalesce(1)
    model, _ = classify.fit_motion_arm(df, max_iter=5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    try:
        plan = classify.permutation_importance(model, df, repeats=2)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    assert "hashpartitioning(i" in plan and "hashpartitioning(j" in plan and plan.count("REPARTITION_BY_NUM") >= 2
