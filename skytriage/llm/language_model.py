"""Masked pseudo-likelihood of documents (operator 3).

The score of a document is the sum of the log-probabilities of its words, each given the words
on either side: log P(class | both sides) + log P(word | class). Words are classed: the most
frequent ones of the corpus are classes of their own, the others share classes by the hash of
their ending; how many classes there are follows the vocabulary (``classes_for``). A small
network predicts the class of a masked word from the classes of the two words on either side,
in two steps: P(group | sides) * P(class | group, sides), with about as many groups as a group
has classes. Both are softmax layers, so the products sum to one over all classes, and a word
costs about twice the root of the number of classes instead of that number.
The share of a word in its class comes from the counts of all words of the corpus: those of the
``KNOWN`` most frequent are sent to the tasks, the others stay in Spark and are joined by word.
Counting covers every document, and so does training: each task goes over its documents once,
and the weights are averaged by numbers of words.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytriage.llm.common import add_vectors, fold
from skytriage.llm.decontaminate import words_of
from skytriage.session import durable

#: Fewest classes; a quarter of the classes are endings.
CLASSES = 128
ENDING_SHARE = 4
#: Words with at least this count make the vocabulary that sets the number of classes.
SEEN = 5
#: Most frequent words, whose counts are sent to the tasks. No other word can have more than 1 / KNOWN of all
#: occurrences, so the join by word has no hot key.
KNOWN = 1 << 15
WINDOW = 2
HIDDEN = 24
BATCH = 4096
RATE = 0.08
#: The first round goes over one in so many documents, to give the second, over all, a common start.
WARM_UP = 16
#: Weights are summed over tasks in pieces of so many numbers, each a group of its own.
PIECE = 1 << 14
WORD_CACHE = 1 << 18
#: Distinct words that a task counts before it hands them on.
COUNTER = 1 << 18
EDGE = 0


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return rows

        for batch in batches:
            for t in batch.column(0):
                seen.update(words_of(t.as_py()))
                if len(seen) > COUNTER:
                    yield out()
        yield out()

    return docs.select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def classes_for(vocabulary: int) -> int:
    """Number of classes: the largest power of two up to the root of the vocabulary, from ``CLASSES`` to 65,536."""
    return min(max(CLASSES, 1 << max(0, vocabulary.bit_length() - 1) // 2), 1 << 16)


def letters(classes: int) -> np.dtype:
    """The type that holds a class."""
    return np.dtype(np.uint8 if classes <= 256 else "<u2")


class Codes(dict):
    """Code of a word in bytes: its rank among the known words or, for others, their number plus the class.

    Others are remembered up to ``WORD_CACHE`` words. ``kind`` gives the class of each code.
    """

    def __init__(self, known: list[str], classes: int):
        self.classes, self.endings = classes, classes // ENDING_SHARE
        self.own = {w.encode(): k for k, w in enumerate(known)}
        own = classes - self.endings - 1
        self.kind = np.array([k + 1 if k < own else self.ending(w) for k, w in enumerate(self.own)] + list(range(classes)), dtype=np.int64)
        super().__init__(self.own)

    def ending(self, word: bytes) -> int:
        return self.classes - self.endings + zlib.crc32(word[-2:]) % self.endings

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORD_CACHE + len(self.own):
            self.clear()
            self.update(self.own)
        got = self[word] = len(self.own) + self.ending(word)
        return got


def known_words(counts: DataFrame) -> list[tuple[str, int]]:
    """The most frequent words, then in alphabetical order, with their counts; the first of them are classes of their own."""
    least, words = 0, 0
    for r in sorted(counts.groupBy("n").count().collect(), key=lambda r: -r["n"]):
        least, words = r["n"], words + r["count"]
        if words >= KNOWN:
            break
    # Few more words than KNOWN are that frequent, so no task hands the driver a list of that length.
    return [(r["word"], r["n"]) for r in counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(KNOWN).collect()]


def class_sizes(counts: DataFrame, known: list[tuple[str, int]], classes: int) -> np.ndarray:
    """Occurrences of all words of each ending class; 1 for a class that is a word of its own."""
    endings = classes // ENDING_SHARE
    kind = F.lit(classes - endings) + F.crc32(F.expr("substring(cast(word AS binary), -2, 2)")) % endings
    out = np.ones(classes, dtype=np.int64)
    for r in counts.groupBy(kind.alias("kind")).agg(F.sum("n").alias("n")).collect():
        out[r["kind"]] = r["n"]
    codes = Codes([], classes)
    for word, n in known[: classes - endings - 1]:
        out[codes.ending(word.encode())] -= n
    return np.maximum(out, 1)


class Network:
    """Weights: a table per place of the window, hidden bias, matrix and bias of the groups, and those of the classes of each group.

    Class ``k`` is number ``k % size`` of group ``k // size``.
    """

    PLACES = tuple(k for k in range(-WINDOW, WINDOW + 1) if k)

    def __init__(self, flat: np.ndarray | None = None, classes: int = CLASSES):
        if flat is not None:
            classes = next(1 << k for k in range(1, 17) if self.length(1 << k) >= len(flat))
        self.classes, self.shapes = classes, self.layout(classes)
        self.size = self.shapes[4][2]
        if flat is None:
            rng = np.random.default_rng(11)
            self.parts = [rng.normal(0, 0.1, s).astype(np.float32) for s in self.shapes]
        else:
            self.parts, at = [], 0
            for s in self.shapes:
                n = int(np.prod(s))
                self.parts.append(flat[at: at + n].reshape(s).astype(np.float32))
                at += n
        self.squares = [np.full(s, 1e-2, dtype=np.float32) for s in self.shapes]

    @staticmethod
    def layout(classes: int) -> tuple[tuple[int, ...], ...]:
        """Shapes of the weights for a power of two of classes."""
        size = 1 << (classes.bit_length() - 1) // 2
        groups = classes // size
        return (2 * WINDOW, classes, HIDDEN), (HIDDEN,), (HIDDEN, groups), (groups,), (groups, HIDDEN, size), (groups, size)

    @classmethod
    def length(cls, classes: int) -> int:
        return sum(int(np.prod(s)) for s in cls.layout(classes))

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts]).astype(np.float64)

    def hidden(self, context: list[np.ndarray]) -> np.ndarray:
        tables, bias = self.parts[:2]
        z = np.tile(bias, (len(context[0]), 1))
        for k, ids in enumerate(context):
            z += tables[k][ids]
        return np.tanh(z, out=z)

    def by_group(self, target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
        """An order of the words in which those of one group follow each other, and the stretch of each group that occurs."""
        group = (target // self.size).astype(np.uint16)
        order = np.argsort(group, kind="stable")
        ends = np.cumsum(np.bincount(group, minlength=self.classes // self.size))
        return order, [(g, slice(a, b)) for g, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())) if b > a]

    def log_prob(self, context: list[np.ndarray], target: np.ndarray) -> np.ndarray:
        """Log-probability of the class of each word."""
        order, stretches = self.by_group(target)
        h, goal = self.hidden(context)[order], target[order]
        found = _log_softmax(h @ self.parts[2] + self.parts[3])[np.arange(len(goal)), goal // self.size]
        for g, s in stretches:
            found[s] += _log_softmax(h[s] @ self.parts[4][g] + self.parts[5][g])[np.arange(s.stop - s.start), goal[s] % self.size]
        out = np.empty_like(found)
        out[order] = found
        return out

    def learn(self, context: list[np.ndarray], target: np.ndarray) -> None:
        """One step of Adagrad on a batch; weights that no word of the batch uses stay as they are."""
        n = len(target)
        order, stretches = self.by_group(target)
        context, goal = [ids[order] for ids in context], target[order]
        h = self.hidden(context)
        g = _error(h @ self.parts[2] + self.parts[3], goal // self.size, n)
        dh = g @ self.parts[2].T
        for k, s in stretches:
            e = _error(h[s] @ self.parts[4][k] + self.parts[5][k], goal[s] % self.size, n)
            dh[s] += e @ self.parts[4][k].T
            self.step(4, k, h[s].T @ e)
            self.step(5, k, e.sum(axis=0))
        dz = dh * (1 - h * h)
        for k, ids in enumerate(context):
            ids = ids.astype(np.uint16)
            turn = np.argsort(ids, kind="stable")
            ids = ids[turn]
            first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
            self.step(0, (k, ids[first].astype(np.int64)), np.add.reduceat(dz[turn], first, axis=0))
        self.step(1, ..., dz.sum(axis=0))
        self.step(2, ..., h.T @ g)
        self.step(3, ..., g.sum(axis=0))

    def step(self, part: int, at, grad: np.ndarray) -> None:
        square = self.squares[part][at] + grad * grad
        self.squares[part][at] = square
        self.parts[part][at] -= RATE * grad / np.sqrt(square)

    @classmethod
    def context(cls, padded: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        return [padded[at + k] for k in cls.PLACES]


def _log_softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(axis=1, keepdims=True)
    logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
    return logits


def _error(logits: np.ndarray, goal: np.ndarray, n: int) -> np.ndarray:
    """Slope of the mean loss over ``n`` words by the logits."""
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    logits[np.arange(len(goal)), goal] -= 1
    logits /= n
    return logits


def _padded(documents: list[bytes], kind: np.dtype = letters(CLASSES)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all documents in a row with edges between them, the places of the words, and the document of each."""
    edge = np.full(WINDOW, EDGE, dtype=kind).tobytes()
    row = np.frombuffer(edge + edge.join(documents) + edge, dtype=kind).astype(np.int64)
    sizes = np.fromiter(map(len, documents), dtype=np.int64, count=len(documents)) // kind.itemsize
    starts = WINDOW + np.concatenate(([0], np.cumsum(sizes + WINDOW)[:-1])) if len(sizes) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(documents)), sizes)
    first = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else np.zeros(0, np.int64)
    return row, np.arange(len(owner)) - first[owner] + starts[owner], owner


def encode(docs: DataFrame, known: list[str], counts: list[int] | None = None, classes: int = CLASSES) -> DataFrame:
    """``row, doc_id, classes, log_count, rare``.

    A number of the row, the class of each word as ``letters`` in a row, the sum of the
    logarithms of ``counts`` over words that are known but no classes of their own, and the
    words that are not known.
    """
    own = classes - classes // ENDING_SHARE - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n = Codes(known, classes), 0
        logs = np.zeros(len(codes.kind))
        if counts:
            logs[own: len(known)] = np.log(counts[own:])
        first = TaskContext.get().partitionId() << 36
        for batch in batches:
            coded, sums, rare = [], [], []
            for t in batch.column(1):
                words = words_of(t.as_py())
                found = np.fromiter(map(codes.__getitem__, words), dtype=np.int64, count=len(words))
                coded.append(codes.kind[found].astype(letters(classes)).tobytes())
                sums.append(logs[found].sum())
                rare.append([words[k].decode() for k in np.flatnonzero(found >= len(known))])
            rows = np.arange(first + n, first + n + len(coded))
            n += len(coded)
            yield pa.RecordBatch.from_arrays([pa.array(rows), batch.column(0), pa.array(coded, pa.binary()), pa.array(sums, pa.float64()), pa.array(rare, pa.list_(pa.string()))],
                                             names=["row", "doc_id", "classes", "log_count", "rare"])

    return docs.select("doc_id", "text").mapInArrow(run, f"row bigint, doc_id {dict(docs.dtypes)['doc_id']}, classes binary, log_count double, rare array<string>")


def train_round(coded: DataFrame, start: np.ndarray) -> np.ndarray:
    """Average, by numbers of words, of the weights that each task reaches over its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, seen = Network(start), 0
        for batch in batches:
            row, at, _ = _padded(batch.column(0).to_pylist(), letters(net.classes))
            for k in range(0, len(at), BATCH):
                part = at[k: k + BATCH]
                net.learn(Network.context(row, part), row[part])
            seen += len(at)
        flat = np.append(net.flat() * seen, seen)
        pieces = [flat[k: k + PIECE].tobytes() for k in range(0, len(flat), PIECE)]
        task = [TaskContext.get().partitionId()] * len(pieces)
        yield pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(len(pieces))]), pa.array(task, pa.int32()), pa.array(pieces, pa.binary())], names=["name", "task", "vector"])

    got = add_vectors(coded.select("classes").mapInArrow(run, "name string, task int, vector binary")).collect()
    total = np.concatenate([np.zeros(0), *(np.frombuffer(r["vector"], dtype=np.float64) for r in sorted(got, key=lambda r: int(r["name"])))])
    return total[:-1] / total[-1] if len(total) and total[-1] > 0 else start


def log_probabilities(net: Network, documents: list[bytes], sizes: np.ndarray | None = None) -> np.ndarray:
    """Sum over the words of each document of the log-probability of their classes given both sides.

    With ``sizes``, less the logarithm of the size of each class.
    """
    row, at, owner = _padded(documents, letters(net.classes))
    less = np.zeros(net.classes) if sizes is None else np.log(sizes)
    out = np.zeros(len(documents))
    for k in range(0, len(at), BATCH):
        part = at[k: k + BATCH]
        logp = net.log_prob(Network.context(row, part), row[part])
        out += np.bincount(owner[k: k + BATCH], weights=logp.astype(np.float64) - less[row[part]], minlength=len(documents))
    return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, log_prob, mean_log_prob``.

    Null and empty texts, and texts of punctuation only, have no words, a sum of 0 and a null
    mean. Repeated rows and null ids keep their rows; other columns are not read. Weights are
    averaged over tasks, so the last digits depend on how the table is split into files.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counts = durable(word_counts(docs))
    classes = classes_for(counts.where(F.col("n") >= SEEN).count())
    known = known_words(counts)
    sizes = class_sizes(counts, known, classes)
    coded = durable(encode(docs, [w for w, _ in known], [n for _, n in known], classes))
    weights = train_round(coded.where(fold(F.col("doc_id"), WARM_UP) == 0), Network(classes=classes).flat())
    weights = train_round(coded, weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(weights)
        for batch in batches:
            documents = batch.column(2).to_pylist()
            sums = log_probabilities(net, documents, sizes) + batch.column(3).to_numpy()
            n = [len(d) // letters(classes).itemsize for d in documents]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sums)], names=["row", "doc_id", "n_words", "known"])

    scored = coded.select("row", "doc_id", "classes", "log_count").mapInArrow(run, f"row bigint, doc_id {dict(docs.dtypes)['doc_id']}, n_words bigint, known double")
    # A word that occurs once adds log 1.
    rare = (coded.select("row", F.explode("rare").alias("word")).join(counts.where(F.col("n") > 1), "word")
            .groupBy("row").agg(F.sum(F.log("n")).alias("rare")))
    total = F.col("known") + F.coalesce("rare", F.lit(0.0))
    return scored.join(rare, "row", "left").select("doc_id", "n_words", total.alias("log_prob"), F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("mean_log_prob"))
