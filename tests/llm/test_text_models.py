import random

import numpy as np
import pytest

from skytriage.llm import decontaminate, language, language_model, toxicity
from skytriage.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def prose(rng, n):
    return " ".join("".join(rng.choice(["ta", "ri", "mo", "len", "sur", "ba", "ko"]) for _ in range(rng.choice([1, 2, 3]))) for _ in range(n))


def test_windows_cover_the_text():
    for t in ("", "a", "one two " * 100, "x" * 1000, " \n "):
        data = toxicity.normalise(t)
        parts = toxicity.windows(data)
        assert all(len(p) <= toxicity.WINDOW_BYTES for p in parts)
        assert set(b" ".join(parts).split()) == set(data.split()) or "x" in t
    assert b"".join(toxicity.windows(toxicity.normalise("x" * 1000))).count(b"x") == 1000


@pytest.fixture(scope="module")
def labelled():
    rng, rows = random.Random(5), []
    for k in range(400):
        words = prose(rng, rng.choice([30, 120])).split(" ")
        bad = k % 4 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["vilequark", "grimsludge", "foulwretch", "dreckling"]))
        rows.append((k, " ".join(words), int(bad)))
    return rows


def test_toxicity_learns_words_and_leaves_clean_text(spark, labelled, odd):
    docs = spark.createDataFrame([(i, t, "q") for i, t, _ in labelled], "doc_id bigint, text string, toxic_score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in labelled] + [(1, None), (None, 1)], "doc_id bigint, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    wrong = [i for i, _, y in labelled if got[i]["toxic_predicted"] != y]
    assert len(wrong) <= 12 and all(0 <= r["toxic_score"] <= 1 for r in got.values())
    other = toxicity.toxicity(odd, labels.where("toxic = 0")).collect()
    assert len(other) == odd.count() and all(r["toxic_predicted"] == 0 for r in other)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0 and toxicity.toxicity(docs, labels.limit(0)).where("toxic_predicted = 1").count() == 0


def test_held_out_labels_are_not_read(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    from skytriage.llm.common import fold
    from pyspark.sql import functions as F

    held = fold(F.col("doc_id"), toxicity.FOLDS) == toxicity.HELD_FOLD
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.training_rows(docs, labels) == toxicity.training_rows(docs, turned)
    turned = docs.withColumn("lang", F.when(fold(F.col("doc_id"), language.FOLDS) == language.HELD_FOLD, "xx").otherwise(F.col("lang")))
    assert language.learn(docs)[0] == language.learn(turned)[0]


def test_language_accuracy_on_held_out_documents(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in QUERIES["op9_language_id"](spark, SF).collect() if r["held_out"]]
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.99


def test_language_against_plain_counting(spark, odd):
    rows = [(1, "aba bab", "p"), (3, "abab", "p"), (4, "cdc dcd CD", "q"), (5, "xyz", None), (7, None, "q"), (8, "123", "p")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    names, matrix = language.learn(docs.withColumn("doc_id", docs["doc_id"] * 0 + 1))
    assert names == ["p", "q"]
    counts = np.zeros(matrix.shape[0] - 1)
    for t in ("aba bab", "abab", "123"):
        for b in language.text_buckets(t):
            np.add.at(counts, b, 1)
    part = counts[: language.BUCKETS] + language.SMOOTHING
    assert np.allclose(matrix[: language.BUCKETS, 0], np.log(part / part.sum()), atol=1e-5)
    got = language.identify(odd, docs.withColumn("doc_id", docs["doc_id"] * 0 + 1)).select("doc_id", "text", "lang_pred", "lang_score").collect()
    assert len(got) == odd.count()
    assert all((r["lang_pred"] == "und" and r["lang_score"] == 0) == (not any(c.isalpha() for c in r["text"] or "")) for r in got)
    assert language.identify(odd.limit(0), docs).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd, docs.limit(0)).collect()} == {"und"}


def slow_alignment(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_against_the_full_table():
    rng = random.Random(7)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(1, 15))] for _ in range(2))
        score, i, k, j, m = decontaminate.align(a, b)
        assert score == slow_alignment(a, b)
        if score:
            assert slow_alignment(a[i: k + 1], b[j: m + 1]) == score and a[i] == b[j] and a[k] == b[m]
    assert decontaminate.align(["a"], ["b"]) == (0, -1, -1, -1, -1)


def test_leaks_exact_edited_and_clean(spark, odd):
    rng = random.Random(9)
    vocab = ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(3)) for _ in range(2000)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(k, text(n)) for k, n in enumerate((20, 40, 64, 150, 8))]
    docs, want = [], set()
    for k, words in items:
        edited = [rng.choice(vocab) if i % 6 == 5 else w for i, w in enumerate(words)]
        for d, body in ((10 * k, words), (10 * k + 1, edited), (10 * k + 2, [w for i, w in enumerate(words) if i % 9 != 8])):
            docs.append((d, " ".join(text(rng.choice([0, 5, 300])) + body + text(200)).title()))
            want.add((d, k))
    docs += [(500 + k, " ".join(text(400))) for k in range(30)] + [(600, " ".join(items[1][1] + text(3000) + items[0][1])), (601, None), (602, ""), (None, " ".join(items[0][1])), (None, "clean without an id"), (0, docs[0][1]), (0, "clean with the id of a leak"), (500, " ".join(items[3][1]))]
    want |= {(600, 1), (600, 0), (None, 0), (500, 3)}
    frame = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id bigint, text string, place string, seed string")
    bench = spark.createDataFrame([(k, ", ".join(w), "z") for k, w in items] + [(90, None, "z"), (91, "", "z"), (92, "...", "z")], "item_id bigint, text string, words string")
    got = decontaminate.leaks(frame, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    at = {(r["doc_id"], r["item_id"]): r for r in got}
    assert at[600, 0]["first_word"] == 3040 and at[600, 0]["last_word"] == 3059 and at[600, 0]["score"] == 1
    left = decontaminate.decontaminate(frame, bench)
    assert left.columns == frame.columns and sorted(str(r["doc_id"]) for r in left.collect()) == sorted(map(str, [None, 0, 601, 602, *range(500, 530)]))
    assert {r["text"] for r in left.collect() if r["doc_id"] in (None, 0)} == {"clean without an id", "clean with the id of a leak"}
    assert decontaminate.leaks(odd, bench).count() == 0 and decontaminate.leaks(frame.limit(0), bench).count() == 0
    assert decontaminate.decontaminate(frame, bench.limit(0)).count() == len(docs)


def test_frequent_leaks_stay_seeds(spark):
    item = " ".join(f"w{k}" for k in range(20))
    frame = spark.createDataFrame([(k, item + f" tail{k}") for k in range(300)], "doc_id bigint, text string")
    assert decontaminate.leaks(frame, spark.createDataFrame([(1, item)], "item_id bigint, text string")).count() == 300


def test_training_copies_against_all_pairs():
    rng = random.Random(8)
    texts, usual = [], [f"w{k}" for k in range(60)]
    for _ in range(150):
        words = rng.sample(usual, rng.randint(0, 40))
        texts.append(" ".join(words).encode())
        for _ in range(rng.randint(0, 3)):
            texts.append(" ".join(rng.choice(usual) if rng.random() < 0.08 else w for w in words).encode())
    want = []
    for t in texts:
        words = set(t.split())
        if not any(words and len(words & set(o.split())) >= 0.8 * len(words | set(o.split())) for o in want):
            want.append(t)
    assert toxicity._distinct(texts) == want and 150 < len(want) < len(texts)


def test_small_dictionaries_hold_words_of_all_samples():
    words = [f"vile{k:03d}" for k in range(40)]
    samples = [f" {words[k % 40]} {words[k * 7 % 40]} ".encode() for k in range(400)]
    content = toxicity._trained(samples, 2048)
    assert len(b"".join(samples)) > 2048 and all(w.encode() in content for w in words)
    assert toxicity._trained(samples[:3], 2048) == b"".join(samples[:3]) and toxicity._trained([], 2048) == b""
    assert toxicity._trained([b" a "] * 1000, 2048) == b" a "


def test_pseudo_likelihood_against_plain_loops():
    rng = np.random.default_rng(1)
    net = language_model.Network()
    for p in net.parts:
        p += rng.normal(0, 0.3, p.shape).astype(np.float32)
    docs = [bytes(rng.integers(1, 128, n).astype(np.uint8)) for n in (0, 1, 5, 0, 30)]
    tables, bias, groups, group_bias, matrix, out = (p.astype(float) for p in net.parts)
    size = out.shape[1]
    assert groups.shape[1] * size == 128
    for d, got in zip(docs, language_model.log_probabilities(net, docs)):
        row = [0, 0, *d, 0, 0]
        want = 0.0
        for i in range(2, len(d) + 2):
            z = bias + sum(tables[k][row[i + p]] for k, p in enumerate((-2, -1, 1, 2)))
            g, k = divmod(row[i], size)
            for logits, at in ((np.tanh(z) @ groups + group_bias, g), (np.tanh(z) @ matrix[g] + out[g], k)):
                want += logits[at] - np.log(np.exp(logits).sum())
        assert abs(got - want) < 1e-3 * max(1, abs(want))


@pytest.mark.parametrize("classes", [128, 1024])
def test_probabilities_of_all_classes_sum_to_one(classes):
    net = language_model.Network(classes=classes)
    assert (language_model.Network(net.flat()).flat() == net.flat()).all()
    sides = [np.full(classes, k) for k in (3, 90, 7, 0)]
    assert abs(np.exp(net.log_prob(sides, np.arange(classes)).astype(float)).sum() - 1) < 1e-5


def test_a_step_of_learning_follows_the_slope():
    """The change of every weight has the sign of the slope found by nudging it."""
    rng, net = np.random.default_rng(4), language_model.Network()
    context, target = [rng.integers(0, 128, 40) for _ in range(4)], rng.integers(1, 128, 40)

    def loss(flat):
        n = language_model.Network()
        at = 0
        for k, p in enumerate(n.parts):
            n.parts[k] = flat[at: at + p.size].reshape(p.shape)
            at += p.size
        return -n.log_prob(context, target).mean()

    before = net.flat()
    net.learn(context, target)
    change = net.flat() - before
    for k in rng.choice(len(before), 300, replace=False):
        up, down = before.copy(), before.copy()
        up[k] += 1e-4
        down[k] -= 1e-4
        slope = (loss(up) - loss(down)) / 2e-4
        want = -language_model.RATE * slope / np.sqrt(0.01 + slope * slope)
        assert abs(change[k] - want) < 1e-4 + 1e-2 * abs(want)


def test_network_learns_both_sides():
    rng, net = np.random.default_rng(6), language_model.Network()
    orderly = bytes([1, 2, 3, 4, 5, 6]) * 700
    row, at, _ = language_model._padded([orderly])
    for _ in range(150):
        net.learn(net.context(row, at), row[at])
    mixed = bytes(rng.permutation(np.frombuffer(orderly, np.uint8)).astype(np.uint8))
    good, bad = language_model.log_probabilities(net, [orderly, mixed]) / len(orderly)
    assert good > -0.7 and good > bad + 1


def test_training_averages_what_tasks_learn(spark):
    docs = spark.createDataFrame([(k, "one two three four five six " * 100) for k in range(60)], "doc_id bigint, text string")
    coded = language_model.encode(docs, ["one", "two", "three", "four", "five", "six"])
    start = language_model.Network().flat()
    rounds = [start]
    for _ in range(4):
        rounds.append(language_model.train_round(coded, rounds[-1]))
    text = coded.first()["classes"]
    scores = [language_model.log_probabilities(language_model.Network(w), [text])[0] for w in rounds]
    assert scores == sorted(scores) and scores[-1] > scores[0] / 1.3
    assert (language_model.train_round(coded.limit(0), start) == start).all()


def test_words_are_counted_over_every_document(spark, odd, monkeypatch):
    monkeypatch.setattr(language_model, "COUNTER", 5)
    want = {}
    for r in odd.collect():
        for w in decontaminate.words_of(r["text"]):
            want[w.decode()] = want.get(w.decode(), 0) + 1
    assert {r["word"]: r["n"] for r in language_model.word_counts(odd).collect()} == want


def test_scores_of_odd_documents(spark, odd):
    got = language_model.score(odd).collect()
    assert len(got) == odd.count()
    alone = {r["doc_id"]: r for r in got}
    assert all(alone[k]["n_words"] == 0 and alone[k]["log_prob"] == 0 and alone[k]["mean_log_prob"] is None for k in (1, 2, 3, 4, 9))
    assert all(r["log_prob"] < 0 for r in got if r["n_words"])
    assert language_model.score(odd.limit(0)).count() == 0


def test_words_of_one_class_differ_by_their_counts(spark, monkeypatch):
    monkeypatch.setattr(language_model, "KNOWN", 130)
    rng = random.Random(3)
    usual = [f"w{k}z" for k in range(95)]
    rows = [(k, " ".join(rng.choice(usual) for _ in range(60)) + " " + tail) for k, tail in enumerate(["oftenx qx"] * 40 + ["seldomqx qx", "oncegqx qx"] + [f"filler{j}x fx fx fx" for j in range(60)])]
    rows += [(200, "alpha qx"), (201, "oftenx qx"), (202, "bravo"), (203, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    counts = {}
    for _, t in rows:
        for w in decontaminate.words_of(t):
            counts[w] = counts.get(w, 0) + 1
    known = sorted(counts, key=lambda w: (-counts[w], w))
    own, codes = set(known[:95]), language_model.Codes([], 128)
    total = {}
    for w, n in counts.items():
        if w not in own:
            total[codes.ending(w)] = total.get(codes.ending(w), 0) + n
    frame = language_model.word_counts(docs)
    pairs = language_model.known_words(frame)
    assert pairs == [(w.decode(), counts[w]) for w in known[:130]] and len(known) > 140
    sizes = language_model.class_sizes(frame, pairs, 128)
    assert {k: n for k, n in enumerate(sizes.tolist()) if n > 1} == {k: n for k, n in total.items() if n > 1}
    # With the network left untrained, the whole sum can be recounted.
    monkeypatch.setattr(language_model, "train_round", lambda coded, start: start)
    net, of = language_model.Network(), {w: k + 1 for k, w in enumerate(known[:95])}
    got = language_model.score(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        words = decontaminate.words_of(dict(rows)[r["doc_id"]])
        want = language_model.log_probabilities(net, [bytes(of.get(w) or codes.ending(w) for w in words)])[0]
        want += sum(np.log(counts[w] / total[codes.ending(w)]) for w in words if w not in own)
        assert abs(r["log_prob"] - want) <= 1e-4 * abs(want)


def test_classes_follow_the_vocabulary(spark):
    assert [language_model.classes_for(v) for v in (0, 1, 16384, 65535, 65536, 1 << 20, 1 << 40)] == [128, 128, 128, 128, 256, 1024, 65536]
    docs = spark.createDataFrame([(k, "one two three other") for k in range(20)], "doc_id bigint, text string")
    coded = language_model.encode(docs, ["one", "two", "three"], [20, 20, 20], 1024)
    start = language_model.Network(classes=1024).flat()
    net = language_model.Network(language_model.train_round(coded, start))
    text = coded.first()["classes"]
    assert net.classes == 1024 and len(text) == 8 and language_model.log_probabilities(net, [text])[0] > language_model.log_probabilities(language_model.Network(start), [text])[0]
