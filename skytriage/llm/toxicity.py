"""Toxicity by compression distance (operator 2).

Two zstandard dictionaries are trained on labelled text: one on ordinary documents, one on
what toxic documents hold that ordinary text does not supply, put in front of the ordinary
dictionary so that ordinary prose compresses alike under both. A text is cut into windows;
a window's margin is the number of bytes that the toxic dictionary saves over the ordinary
one. A logistic curve over the margins of a document, calibrated on labelled documents that
took no part in training the dictionaries, gives the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytriage.llm.common import fold

#: Labelled rows per class that training reads at most (taken in the order of a hash of the id).
TRAIN_ROWS = 3000
WINDOW_BYTES = 64
ORDINARY_DICT = 8 * 1024
TOXIC_DICT = 2 * 1024
#: A word of toxic text stays out of the toxic dictionary unless its share of documents is so many standard errors above that in ordinary ones.
WORD_SIGMAS = 3.5
#: With few toxic documents, in which a word cannot be that far above, so many fewer per power of ten below.
SIGMAS_PER_TEN = 1.5
#: Parts for the calibration: each is scored by dictionaries of the others.
PARTS = 4
#: Every window is compressed after so many bytes that both dictionaries end in, so that neither stores it raw.
PRIMER_BYTES = 32
#: Bytes that a window of ordinary text saves now and then by chance.
CHANCE_BYTES = 3
N_FEATURES = 7
#: Shorter matches than this are not worth a sequence; keeps chance fragments out of the margins.
MIN_MATCH = 6
#: Training texts that share this much of their words are copies.
COPY_SHARE = 0.8
#: What the dictionary trainer is given at least: bytes as a multiple of the dictionary's, and samples.
TRAINER_SHARE = 8
TRAINER_SAMPLES = 32
FOLDS = 5
HELD_FOLD = 0

_PIECE = re.compile(rb"\s+")
_WORD = re.compile(rb"[^\s!-/:-@\[-`{-~]+")


def normalise(text: str | None) -> bytes:
    """UTF-8, ASCII lower case, one space for each run of white space, a space at both ends."""
    return b" " + _PIECE.sub(b" ", text.encode("utf-8", "replace").lower()).strip() + b" " if text else b""


def windows(data: bytes, size: int = WINDOW_BYTES) -> list[bytes]:
    """Consecutive windows of about ``size`` bytes that share the space at which they are cut."""
    out, at = [], 0
    while at < len(data):
        end = at + size
        if end < len(data):
            space = data.rfind(b" ", at + 1, end)
            end = space + 1 if space > at else end
        out.append(data[at:end])
        if end >= len(data):
            break
        at = end - 1 if data[end - 1: end] == b" " else end
    return out


@dataclass
class Model:
    """Both dictionaries (raw content) and the weights of the calibration."""

    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    pair: tuple | None = None

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        out = []
        for content in (self.ordinary, self.toxic):
            params = zstandard.ZstdCompressionParameters(
                format=zstandard.FORMAT_ZSTD1_MAGICLESS, window_log=17, hash_log=15, chain_log=16, search_log=7, min_match=MIN_MATCH, target_length=64,
                strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=params)
            out.append(zstandard.ZstdCompressor(dict_data=held, compression_params=params))
        return out[0], out[1]


def margins(data: bytes, model: Model) -> np.ndarray:
    """Bytes that the toxic dictionary saves, per window."""
    if model.pair is None:
        model.pair = model.compressors()
    ordinary, toxic, primer = model.pair[0].compress, model.pair[1].compress, model.ordinary[-PRIMER_BYTES:]
    return np.array([len(ordinary(w)) - len(toxic(w)) for w in (primer + x for x in windows(data))], dtype=np.float64)


def features(saved: np.ndarray) -> np.ndarray:
    """What the calibration sees of a document: a constant, its best and three best windows, its sum and mean, and the sum above chance finds."""
    if not len(saved):
        return np.array([1.0, *[0.0] * (N_FEATURES - 1)])
    best = np.sort(saved)[::-1]
    gain, sure = np.clip(saved - 1, 0, None), np.clip(saved - CHANCE_BYTES, 0, None)
    return np.array([1.0, best[0].clip(0) / 8, best[:3].clip(0).sum() / 16, np.log1p(gain.sum()), np.log1p(gain.mean()), np.log1p(sure.sum()), min(2, np.count_nonzero(sure))])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    penalty = np.diag([0.0] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty + 1e-6 * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(h, x.T @ (y - p) - penalty @ w), -4, 4)
    return w


def _trained(samples: list[bytes], size: int) -> bytes:
    """Content of a dictionary trained on ``samples``; each of them once where they fit ``size`` so.

    Few samples are trained on several times over, since the trainer wants many times the
    size of the dictionary; which parts of them it picks depends on all of them.
    """
    once = b"".join(dict.fromkeys(samples))
    if len(once) <= size:
        return once
    times = max(-(-TRAINER_SHARE * size // sum(map(len, samples))), -(-TRAINER_SAMPLES // len(samples)))
    try:
        return zstandard.train_dictionary(size, samples * times, k=64, d=8).as_bytes()
    except zstandard.ZstdError:  # samples of a few bytes each, which it cannot cut segments from
        return once


def _distinctive(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Each toxic text without the words that ordinary documents use about as often."""
    share: dict[bytes, list[float]] = {}
    for side, texts in enumerate((toxic, ordinary)):
        for t in texts:
            for w in set(_WORD.findall(t)):
                share.setdefault(w, [0.0, 0.0])[side] += 1 / len(texts)
    n = [max(1, len(toxic)), max(1, len(ordinary))]
    sigmas = {w: (a - b) / np.sqrt(a / n[0] + b / n[1]) for w, (a, b) in share.items() if a * n[0] > 1.5}
    floor = min(WORD_SIGMAS, 0.8 + SIGMAS_PER_TEN * np.log10(n[0]))
    kept = {w for w, z in sigmas.items() if z >= floor}
    return [b" " + b" ".join(w for w in _WORD.findall(t) if w in kept) + b" " for t in toxic]


def _distinct(texts: list[bytes]) -> list[bytes]:
    """``texts`` without those whose words are, to ``COPY_SHARE`` of both together, the words of one kept before: near copies count once.

    Two such texts share one of the rarest words of each, as many as a copy may lack and one
    more, so only texts that do are compared.
    """
    sets = [frozenset(_WORD.findall(t)) for t in texts]
    held = Counter(w for words in sets for w in words)
    kept: list[bytes] = []
    at: dict[bytes, list[frozenset[bytes]]] = {}
    for t, words in zip(texts, sets):
        rare = sorted(words, key=lambda w: (held[w], w))[: int(len(words) * (1 - COPY_SHARE) + 1e-9) + 1]
        near = {other for w in rare for other in at.get(w, ()) if COPY_SHARE * len(words) <= len(other) <= len(words) / COPY_SHARE}
        if any(len(words & other) >= COPY_SHARE * len(words | other) for other in near):
            continue
        for w in rare:
            at.setdefault(w, []).append(words)
        kept.append(t)
    return kept


def _dictionaries(ordinary: list[bytes], toxic: list[bytes]) -> tuple[bytes, bytes]:
    ordinary, toxic = _distinct(ordinary), _distinct(toxic)
    base = _trained([w for t in ordinary for w in windows(t)], ORDINARY_DICT) or b" "
    extra = _trained([w for t in _distinctive(toxic, ordinary) if t.strip() for w in windows(t)], TOXIC_DICT)
    return base, b" ".join([extra, base])


def train(rows: list[tuple[str | None, int]], odds: float | None = None) -> Model:
    """Fit on ``(text, label)`` pairs; ``odds`` are those of a toxic row where they differ from those among the pairs.

    The margins that calibrate come from dictionaries of the other parts of the rows; the
    dictionaries of the model are trained on all. Without two rows of each class it scores 0.
    """
    texts = [[normalise(t) for t, y in rows if y == k] for k in (0, 1)]
    if min(map(len, texts)) < 2:
        return Model(b" ", b" ", np.array([-30.0, *[0.0] * (N_FEATURES - 1)]))
    x, y = [], []
    parts = min(PARTS, *map(len, texts))
    for held in range(parts):
        part = Model(*_dictionaries(*([t for i, t in enumerate(own) if i % parts != held] for own in texts)), np.zeros(N_FEATURES))
        for k in (0, 1):
            for t in texts[k][held::parts]:
                x.append(features(margins(t, part)))
                y.append(float(k))
    weights = _logistic(np.array(x), np.array(y))
    if odds:
        weights[0] += np.log(odds) - np.log(sum(y) / (len(y) - sum(y)))
    return Model(*_dictionaries(*texts), weights)


def _known(labels: DataFrame) -> DataFrame:
    """Labels of the rows to learn from."""
    return labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id"), FOLDS) != HELD_FOLD)).distinct()


def toxic_odds(labels: DataFrame) -> float | None:
    """Toxic rows per ordinary row among all labels to learn from; None without either."""
    n = {r["toxic"]: r["count"] for r in _known(labels).groupBy("toxic").count().collect()}
    return n[1] / n[0] if len(n) == 2 else None


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> list[tuple[str | None, int]]:
    """At most ``rows`` labelled documents of each class outside the held-out fold, in the order of a hash of their id.

    Rows whose label is null or neither 0 nor 1 teach nothing. Of several documents with one
    id the first in the order of their texts teaches; two labels of one id both do.
    """
    known = _known(labels)
    rank = F.md5(F.col("doc_id").cast("string"))
    picked = [known.where(F.col("toxic") == k).orderBy(rank, "doc_id").limit(rows) for k in (0, 1)]
    both = picked[0].unionByName(picked[1])
    found = docs.select("doc_id", "text").join(F.broadcast(both), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    return [(r["text"], r["toxic"]) for r in sorted(found, key=lambda r: (str(r["doc_id"]), r["toxic"]))]


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` with ``toxic_score`` (0 to 1), ``toxic_predicted`` (1 from 0.5 on) and ``toxic_windows``.

    Labels are read from ``labels`` (doc_id, toxic), and only for rows outside the held-out
    fold; nothing but the text is scored. Null and empty texts have no window and get the
    score of a document in which nothing is saved. All columns of ``docs`` are kept; columns
    of the three names above are replaced. Repeated rows are scored each.
    """
    found = score_column(docs, labels, id_col, text_col, rows)
    new = {"toxic_score": found["score"], "toxic_predicted": (found["score"] >= 0.5).cast("int"), "toxic_windows": found["windows"]}
    return docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in new), *(c.alias(k) for k, c in new.items()))


def score_column(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Column:
    """Train, and give ``struct<score, windows>`` of the text of a row as a column."""
    model = train(training_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels, rows), toxic_odds(labels))
    return scorer(model)(F.col(text_col))


def scorer(model: Model):
    """A vectorised function from text to ``struct<score, windows>``."""
    @F.pandas_udf("score double, windows int")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = np.zeros(len(texts))
            n = np.zeros(len(texts), dtype=np.int32)
            for i, t in enumerate(texts):
                saved = margins(normalise(t), model)
                n[i] = len(saved)
                out[i] = 1 / (1 + np.exp(-np.clip(features(saved) @ model.weights, -30, 30)))
            yield pd.DataFrame({"score": out, "windows": n})

    return score
