"""Benchmark decontamination by rare seeds and Smith-Waterman alignment (operator 10).

1. Items are cut into passages of at most ``PASSAGE`` words, and the words of the corpus that
   occur in them are counted.
2. At each position of a passage the shortest n-gram that the corpus would hold at most once
   by chance (its words drawn independently) is a seed. Chance, not the count of the n-gram
   itself, decides: a leaked item is frequent, and must stay findable.
3. Documents are cut into cells of ``CELL`` words; a cell with a possible seed is kept with
   as many words of context on both sides as a passage can need.
4. Seeds and cells meet in a join on the seed's hash. A local alignment of the words of
   passage and cell scores every pair that met.

Bitmaps of a fixed size tell tasks which words and seeds can matter, so what is sent to them
does not grow with corpus or benchmark.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytriage.llm.common import written
from skytriage.session import durable

SEED_SIZES = (3, 4, 5, 6)
#: A seed may be expected so often in the corpus by chance.
EXPECTED = 1.0
PASSAGE = 64
PASSAGE_STEP = 32
CELL = 128
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of the score of an exact copy from which a document counts as contaminated.
THRESHOLD = 0.5
BITMAP_BITS = 22

_SPACES = bytes(c if chr(c).isalnum() or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words in UTF-8; everything in ASCII but letters and digits separates."""
    return text.lower().encode("utf-8", "replace").translate(_SPACES).split() if text else []


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words))


def _grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every n-gram of ``size`` words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        h = (h ^ hashes[k: n + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _slots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash; both are set for a hash that is there."""
    return tuple((hashes * np.uint64(k) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64) for k in (0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def _maybe(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in the bitmap: all that are, and few others."""
    one, two = _slots(hashes)
    return bits[one] & bits[two]


def _bitmap(values: DataFrame, col: str) -> np.ndarray:
    """Bits (as booleans) of the slots of a column of hashes; at most 2 ** BITMAP_BITS slots come back."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.unique(np.concatenate(_slots(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))))
            yield pa.RecordBatch.from_arrays([pa.array(found)], names=["slot"])

    out = np.zeros(1 << BITMAP_BITS, dtype=bool)
    out[values.select(F.col(col).cast("bigint")).mapInArrow(slots, "slot bigint").distinct().toPandas()["slot"].to_numpy(np.int64)] = True
    return out


def passages(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, passage, words`` (space-joined): windows of ``PASSAGE`` words every ``PASSAGE_STEP``; none for items without words."""
    picked = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers, texts = [], [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                for k, at in enumerate(range(0, max(1, len(words) - PASSAGE_STEP), PASSAGE_STEP) if len(words) > PASSAGE else range(min(1, len(words)))):
                    ids.append(item), numbers.append(k), texts.append(b" ".join(words[at: at + PASSAGE]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], names=["item_id", "passage", "words"])

    return picked.mapInArrow(cut, f"item_id {dict(picked.dtypes)['item_id']}, passage int, words string")


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_hashes(t.encode().split()) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)).view(np.int64) if found else np.zeros(0, np.int64))], names=["word"])


def word_counts(docs: DataFrame, parts: DataFrame) -> tuple[DataFrame, int]:
    """How often each word (as a hash) of ``parts`` occurs in all of ``docs``, and the number of words there."""
    bits = _bitmap(parts.select("words").mapInArrow(_vocabulary, "word bigint"), "word")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        total = 0
        for batch in batches:
            for t in batch.column(0):
                h = _hashes(words_of(t.as_py()))
                total += len(h)
                known, n = np.unique(h[_maybe(bits, h)], return_counts=True)
                for w, k in zip(known.view(np.int64).tolist(), n.tolist()):
                    seen[w] = seen.get(w, 0) + k
        yield pa.RecordBatch.from_arrays([pa.array([*seen, -1], pa.int64()), pa.array([*seen.values(), total], pa.int64())], names=["word", "n"])

    counts = durable(docs.select("text").mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.where("word = -1").agg(F.sum("n")).first()[0] or 0
    return counts.where("word <> -1"), total


def seeds(parts: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """Seeds of every passage: ``seed, size, item_id, passage, words``.

    At each position the shortest size in ``SEED_SIZES`` expected at most ``EXPECTED`` times,
    or the longest that fits; a passage shorter than the shortest size is one seed.
    """
    positions = parts.select("item_id", "passage", "words", F.posexplode(F.split("words", " ")).alias("at", "one"))
    rated = (positions.withColumn("word", F.crc32(F.col("one").cast("binary")))
             .join(counts, "word", "left").groupBy("item_id", "passage", "words")
             .agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("n", F.lit(1)).alias("n")))).alias("n")))  # at most PASSAGE positions a group

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for item, number, words, n in zip(*(batch.column(k).to_pylist() for k in range(4))):
                h = _hashes(words.encode().split())
                logs = np.log([x["n"] for x in n]) - np.log(max(total, 1))
                sizes = [s for s in SEED_SIZES if s <= len(h)] or [len(h)]
                grams = {s: _grams(h, s).view(np.int64) for s in sizes}
                for at in range(len(h) - sizes[0] + 1):
                    fit = [s for s in sizes if at + s <= len(h)]
                    size = next((s for s in fit if np.log(max(total, 1)) + logs[at: at + s].sum() <= np.log(EXPECTED)), fit[-1])
                    out.append((int(grams[size][at]), size, item, number, words))
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), batch.schema.field(0).type, pa.int32(), pa.string()))],
                                             names=["seed", "size", "item_id", "passage", "words"])

    return rated.mapInArrow(pick, f"seed bigint, size int, item_id {dict(parts.dtypes)['item_id']}, passage int, words string").distinct()


def cells(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Cells of documents that may hold a seed: ``doc_id, start, cell`` (words with context) and ``hits`` (seed hashes)."""
    bits = _bitmap(found, "seed")
    sizes = sorted(r["size"] for r in found.select("size").distinct().collect())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, texts, hits = [], [], [], []
            for doc, t in zip(batch.column(0), batch.column(1)):
                words = words_of(t.as_py())
                h = _hashes(words)
                at, seed = [], []
                for size in sizes:
                    g = _grams(h, size)
                    i = np.nonzero(_maybe(bits, g))[0]
                    at.append(i), seed.append(g[i].view(np.int64))
                at, seed = (np.concatenate(at), np.concatenate(seed)) if at else (np.zeros(0, int), np.zeros(0, int))
                for cell in np.unique(at // CELL):
                    start = max(0, int(cell) * CELL - 2 * PASSAGE)
                    ids.append(doc.as_py()), starts.append(start)
                    texts.append(b" ".join(words[start: (int(cell) + 1) * CELL + 2 * PASSAGE]).decode("utf-8", "replace"))
                    hits.append(np.unique(seed[at // CELL == cell]).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(starts, pa.int64()), pa.array(texts, pa.string()), pa.array(hits, pa.list_(pa.int64()))],
                                             names=["doc_id", "start", "cell", "hits"])

    picked = docs.select("doc_id", "text")
    return picked.mapInArrow(cut, f"doc_id {dict(picked.dtypes)['doc_id']}, start bigint, cell string, hits array<bigint>")


def align(a: list[str], b: list[str]) -> tuple[int, int, int, int, int]:
    """Best local alignment of two word lists: score, then first and last word of it in ``a`` and in ``b``.

    Of alignments with the same score the one that ends first in ``a``, then in ``b``. Nothing in common gives score 0 and -1s.
    """
    names: dict[str, int] = {}
    x, y = (np.array([names.setdefault(w, len(names)) for w in s], dtype=np.int64) for s in (a, b))

    def best(p: np.ndarray, q: np.ndarray) -> tuple[int, int, int]:
        slope = -GAP * np.arange(1, len(q) + 1)
        above, top = np.zeros(len(q) + 1, dtype=np.int64), (0, -1, -1)
        for i, w in enumerate(p):
            row = np.maximum(above[:-1] + np.where(q == w, MATCH, MISMATCH), np.maximum(above[1:] + GAP, 0))
            row = np.maximum.accumulate(row + slope) - slope
            j = int(row.argmax()) if len(row) else 0
            if len(row) and row[j] > top[0]:
                top = (int(row[j]), i, j)
            above = np.concatenate(([0], row))
        return top

    score, i, j = best(x, y)
    if score == 0:
        return 0, -1, -1, -1, -1
    _, di, dj = best(x[: i + 1][::-1], y[: j + 1][::-1])
    return score, i - di, i, j - dj, j


def aligner():
    """A vectorised function from passage and cell to the best alignment."""

    @F.pandas_udf("score double, item_first int, item_last int, first int, last int")
    def aligned(passage: pd.Series, cell: pd.Series) -> pd.DataFrame:
        rows = []
        for p, c in zip(passage, cell):
            a = p.split(" ")
            score, *ends = align(a, c.split(" "))
            rows.append((score / (MATCH * len(a)), *ends))
        out = pd.DataFrame(rows, columns=["score", "item_first", "item_last", "first", "last"])
        return out.astype({c: "float64" if c == "score" else "int32" for c in out.columns})

    return aligned


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs of document and benchmark item: ``doc_id, item_id, score, passage, first_word, last_word``.

    ``score`` is that of the best local alignment over the score of an exact copy of the
    passage, at least ``threshold``; one row per pair, its best place (then the first one).
    The words are positions in the document. Null and empty texts leak nothing, repeated rows
    count once, rows with a null id are reported under a null id. Only the named columns are read.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    parts = durable(passages(items))
    counts, total = word_counts(docs, parts)
    found = durable(seeds(parts, counts, total))
    held = durable(cells(docs, found).withColumn("place", F.xxhash64("doc_id", "start", "cell")))
    met = (held.select("place", F.explode("hits").alias("seed")).join(found.select("seed", "item_id", "passage", "words"), "seed")
           .select("place", "item_id", "passage", "words").distinct())
    pairs = met.join(held.select("doc_id", "start", "cell", "place"), "place")
    scored = pairs.withColumn("best", aligner()("words", "cell")).where(F.col("best.score") >= threshold)
    order = F.struct(-F.col("best.score"), F.col("start") + F.col("best.first"), F.col("passage"))
    return (scored.groupBy("doc_id", "item_id")
            .agg(F.min_by(F.struct(F.col("best.score").alias("score"), F.col("passage"), (F.col("start") + F.col("best.first")).alias("first_word"),
                                   (F.col("start") + F.col("best.last")).alias("last_word")), order).alias("top"))
            .select("doc_id", "item_id", "top.*"))


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` whose text holds no item; all columns as they are.

    What a row holds depends on its text alone, so texts are told apart by their digest and
    ids do not matter: rows without an id or with one that others share are judged by their own
    text, repeated rows stay or go together. Null and empty texts stay, as does everything
    where ``items`` is empty. The digests of leaking texts are written first, so they are
    broadcast only while Spark finds the table small enough.
    """
    digest = F.unhex(F.md5("text"))
    bad = written(leaks(docs.select(digest.alias("doc_id"), "text"), items, threshold).select(F.col("doc_id").alias("_leak")).distinct())
    return docs.join(bad, digest == F.col("_leak"), "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
