"""Language identification by naive Bayes over hashed character n-grams (operator 9).

A text becomes lower-case letters with one space between words; its n-grams of one to three
characters are hashed into buckets, counted per language over all learning documents, and
smoothed counts give a matrix of log-probabilities. The matrix (buckets times languages, a
size that does not depend on the corpus) goes to the tasks, where numpy scores whole batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytriage.llm.common import add_vectors, fold

SIZES = (1, 2, 3)
BUCKETS = 1 << 14
SMOOTHING = 0.5
FOLDS = 4
HELD_FOLD = 2
#: Learning fails beyond this; a language column with more values holds something else.
MAX_LANGUAGES = 512
UNKNOWN = "und"
#: Characters that are hashed at once.
CHUNK = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Per code point: its lower case where it is a letter, else 0."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _codes(text: str) -> np.ndarray:
    """Letters of ``text`` in lower case, each run of anything else as one 0, a 0 at both ends; empty without letters."""
    got = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    got = np.concatenate((np.zeros(1, np.uint32), got, np.zeros(1, np.uint32)))
    keep = np.ones(len(got), dtype=bool)
    keep[1:] = (got[1:] != 0) | (got[:-1] != 0)
    got = got[keep]
    return got if len(got) > 1 else got[:0]


def _buckets(codes: np.ndarray, size: int) -> np.ndarray:
    """Bucket of every n-gram of ``size`` characters; those of different sizes do not meet."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    h = codes[:n].astype(np.uint64)
    for k in range(1, size):
        h = h * np.uint64(1_000_003) + codes[k: n + k]
    h = (h + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)
    at = (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
    if size == 1:
        at = at[codes != 0]
    return at + SIZES.index(size) * BUCKETS


def text_buckets(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text, in pieces of bounded size."""
    codes = _codes(text) if text else np.zeros(0, np.uint32)
    for at in range(0, len(codes), CHUNK):
        for size in SIZES:
            yield _buckets(codes[at: at + CHUNK + size - 1], size)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            own = counts.setdefault(lang.as_py(), np.zeros(len(SIZES) * BUCKETS + 1, dtype=np.int64))
            own[-1] += 1
            for at in text_buckets(text.as_py()):
                own[:-1] += np.bincount(at, minlength=len(SIZES) * BUCKETS)
    task = TaskContext.get().partitionId()
    for lang, own in counts.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([task], pa.int32()), pa.array([own.tobytes()])], names=["name", "task", "vector"])


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and the matrix of log-probabilities, its last row the prior.

    Learns from ``doc_id, text, lang``: rows with a language outside the held-out fold, all of
    them. Texts that are null or hold no letter count for the prior only.
    """
    seen = docs.where(F.col("lang").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_FOLD)).select("lang", "text")
    rows = add_vectors(seen.mapInArrow(_counted, "name string, task int, vector binary"), "int64").limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    found = sorted((r["name"], np.frombuffer(r["vector"], dtype=np.int64)) for r in rows)
    width = len(SIZES) * BUCKETS
    matrix = np.zeros((width + 1, len(found)), dtype=np.float64)
    for k, (_, counts) in enumerate(found):
        for s in range(len(SIZES)):
            part = counts[s * BUCKETS: (s + 1) * BUCKETS] + SMOOTHING
            matrix[s * BUCKETS: (s + 1) * BUCKETS, k] = np.log(part / part.sum())
        matrix[width, k] = np.log(counts[-1])
    if found:
        matrix[width] -= np.logaddexp.reduce(matrix[width])
    return [name for name, _ in found], matrix.astype(np.float32)


def posterior(text: str | None, matrix: np.ndarray) -> np.ndarray | None:
    """Probability of each language; None for a text without letters."""
    total = np.zeros(matrix.shape[1], dtype=np.float64)
    seen = 0
    for at in text_buckets(text):
        seen += len(at)
        total += matrix[at].sum(axis=0, dtype=np.float64)
    if not seen:
        return None
    total += matrix[-1]
    p = np.exp(total - total.max()) if len(total) else total
    return p / p.sum() if len(total) else None


def predictor(languages: list[str], matrix: np.ndarray):
    """A vectorised function from text to ``struct<lang, score>``; ties go to the first language in order."""

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for i, t in enumerate(texts):
                p = posterior(t, matrix)
                if p is not None:
                    k = int(p.argmax())
                    lang[i], score[i] = languages[k], p[k]
            yield pd.DataFrame({"lang": lang, "score": score})

    return predict


def identify(docs: DataFrame, learn_from: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score`` (probability of that language).

    Learns from ``learn_from`` (doc_id, text, lang; ``docs`` itself where not given). Null
    texts and texts without a letter get ``und`` and score 0, as does every text where no row
    could be learned from. All columns are kept; columns of the two names are replaced.
    """
    found = language_column(docs if learn_from is None else learn_from, text_col)
    new = {"lang_pred": found["lang"], "lang_score": found["score"]}
    return docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in new), *(c.alias(k) for k, c in new.items()))


def language_column(learn_from: DataFrame, text_col: str = "text") -> Column:
    """Learn, and give ``struct<lang, score>`` of the text of a row as a column."""
    return predictor(*learn(learn_from))(F.col(text_col))
