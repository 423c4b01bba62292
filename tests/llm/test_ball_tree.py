import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from skytriage.llm import ball_tree as B

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return PATTERN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow(docs, items, top):
    """The contract with dictionaries and plain loops: (item, rank, doc, score)."""
    found = [(i, words(t)) for i, t in docs]
    n = sum(bool(w) for _, w in found)
    total = sum(len(w) for _, w in found)
    df = Counter(t for _, w in found for t in set(w))
    out = []
    for item, text in items:
        scored = []
        for i, w in found:
            tf = Counter(w)
            m = 100 - 50 + 50 * len(w) * n // total if total else 1
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m)) for t in set(words(text)) if tf[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, k, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def corpus(rng, n):
    vocabulary = ["Of", "the", "7", "été", "x1", "日本"] + [f"w{k}" for k in range(120)]
    text = lambda k: rng.choice([" ", "-", ", "]).join(rng.choices(vocabulary, [40, 30] + [3] * (len(vocabulary) - 2), k=k))
    docs = [(k * 3 % n, text(rng.choice([1, 8, 40]))) for k in range(n)] + [(None, text(30)), (None, None), (5, ""), (5, " .!"), (7, "w1 w2 w3"), (7, "w1 w2 w3"), (2, "w1 w2 w3"), (8, "w5 " * 5000)]
    items = [(1, text(12)), (2, "w1 w2 w3"), (2, "W5"), (3, "of the of"), (4, None), (5, "nowhere"), (None, text(3)), (6, text(60))]
    return docs, items


def tables(spark, docs, items):
    extra = [(*r, "z", 1.5) for r in docs]
    return (spark.createDataFrame(extra, "doc_id bigint, text string, item_id string, score double").repartition(3),
            spark.createDataFrame([(*r, 7) for r in items], "item_id bigint, text string, doc_id int"))


@pytest.mark.parametrize("limits", [{}, {"vocabulary": 20, "cells": 400, "leaf": 2}, {"most": 1, "leaf": 4}])
def test_against_plain_loops(spark, limits):
    docs, items = corpus(random.Random(6), 150)
    got = B.search(*tables(spark, docs, items), top=5, **limits).collect()
    assert sorted((tuple(r) for r in got), key=str) == slow(docs, items, 5)


def test_empty_tables(spark):
    docs, items = corpus(random.Random(6), 3)
    assert B.search(*tables(spark, [], items)).collect() == []
    assert B.search(*tables(spark, docs, [])).collect() == []
    assert B.search(*tables(spark, [(1, None), (2, "...")], items)).collect() == []


@pytest.mark.parametrize("leaf", [1, 5])
def test_bounds_hold_for_every_document_and_prune(leaf):
    rng = np.random.default_rng(3)
    items = [sorted(rng.choice(60, 6, replace=False).tolist()) for _ in range(9)]
    order, starts = B.groups_of(items, 60)
    assert sorted(order.tolist()) == list(range(60)) and starts[0] == 0
    x = np.where(rng.random((80, 60)) < 0.05, rng.integers(1, 50, (80, 60)), 0).astype(float)
    x[7] = 0
    x[8:20] = x[20]
    q = np.zeros((len(items), 60))
    for k, its in enumerate(items):
        q[k, np.argsort(order)[its]] = rng.integers(1, 9, len(its))
    tree = B.Tree(x, starts, leaf)
    assert sorted(tree.order.tolist()) == list(range(80))
    bounds = tree.centroids @ q.T + tree.radii @ np.sqrt(np.add.reduceat(q * q, starts, axis=1)).T
    leaves = 0
    for node, (a, b) in enumerate(tree.spans):
        assert (bounds[node] >= (x[tree.order[a:b]] @ q.T).max(axis=0) * (1 - 1e-12)).all()
        leaves += tree.children[node] is None
    best = [B.Best(2) for _ in items]
    its = [np.flatnonzero(row) for row in q]
    seen = sum(B.search_tree(tree, x[tree.order].astype(np.int32), list(range(80)), [t], row.astype(np.int64), bounds[:, [k]], [best[k]]) for k, (t, row) in enumerate(zip(its, q)))
    assert seen < leaves * len(items)
    for row, b in zip(q, best):
        want = sorted(((int(s), -i) for i, s in enumerate(x @ row) if s > 0), reverse=True)[:2]
        assert sorted(((s, i) for s, _, i in b.heap), reverse=True) == want
