"""Token counts by a two-tier lookup on the map side (operator 5).

Every task counts its own pre-tokens and hands in the most frequent ones, a list of fixed
length; their sums give the table of frequent pre-tokens with their lengths in tokens, which
is broadcast (``HEAD`` entries at most). In the second pass a pre-token is looked up there,
then in the worker's own cache; what neither knows is encoded by the library. Pre-tokens are
never shuffled, and which of them are in the table or cache does not change a count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytriage.llm.pretokens import PreTokens

#: Entries of the broadcast table, and pre-tokens that a task hands in.
HEAD = 1 << 15
TASK_HEAD = 1 << 12
#: Entries of a worker's cache, after which it starts anew, and of a task's counter, after which rare ones are dropped.
CACHE = 1 << 18
COUNTER = 1 << 18
LIMIT = 2048


def frequent(docs: DataFrame, path: str, head: int = HEAD) -> list[str]:
    """The pre-tokens with the largest sums over what tasks handed in, at most ``head``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, seen = PreTokens(path), Counter()
        for batch in batches:
            for t in batch.column(0):
                for kind, words in splitter.split(t.as_py() or ""):
                    if kind == "words":
                        seen.update(words)
                if len(seen) > COUNTER:
                    seen = Counter(dict(seen.most_common(COUNTER // 2)))
        top = seen.most_common(TASK_HEAD)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"])

    sums = docs.select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"] for r in sums.orderBy(F.desc("n"), "word").limit(head).collect()]


class Lengths:
    """Length in tokens of pre-tokens: the table, then the cache, then the library."""

    def __init__(self, splitter: PreTokens, head: dict[str, int]):
        self.splitter, self.head, self.known = splitter, head, dict(head)

    def encode(self, words: list[str]) -> list[int]:
        return [len(e.ids) for e in self.splitter.tokenizer.encode_batch(words, add_special_tokens=False)]

    def count(self, text: str) -> int:
        total = 0
        for kind, words in self.splitter.split(text):
            if kind == "special":
                total += 1
            elif kind == "letters":
                total += sum(self.encode([bytes(self.splitter.byte[c] for c in w).decode("utf-8", "replace") for w in words]))
            else:
                known = self.known
                new = [w for w in set(words) if w not in known]
                if new:
                    if len(known) + len(new) > len(self.head) + CACHE:
                        self.known = known = dict(self.head)
                        new = [w for w in set(words) if w not in known]
                    known.update(zip(new, self.encode(new)))
                total += sum(map(known.__getitem__, words))
        return total


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_bytes`` (UTF-8), ``n_tokens, over_limit`` (more than ``limit``).

    Null counts as the empty text, with no bytes and no tokens. Strings of special tokens in
    a text are one token each, as the library has them by default. Repeated rows and null ids
    keep their rows; other columns are not read.
    """
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    words = frequent(picked, path)
    table = list(zip(words, Lengths(PreTokens(path), {}).encode(words)))
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(PreTokens(path), dict(sent.value))
        for batch in batches:
            n_bytes, n_tokens = [], []
            for t in batch.column(1):
                text = t.as_py() or ""
                n_bytes.append(len(text.encode("utf-8", "replace")))
                n_tokens.append(lengths.count(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                                             names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return picked.mapInArrow(run, f"doc_id {dict(picked.dtypes)['doc_id']}, n_bytes bigint, n_tokens bigint, over_limit boolean")
