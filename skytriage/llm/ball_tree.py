"""Ranked lexical search as exact maximum inner product over ball trees (operator 13).

A document is the vector of its terms' saturated frequencies, an item that of its terms'
weights, and a score their inner product, in whole numbers. Only terms of the items have
coordinates, which changes no product and makes vectors short. Every task cuts the documents
it reads into blocks and builds a ball tree over each. The trees are searched best-first for
all items of a block of items, and a subtree whose bound is below the lowest of the item's
best scores so far is left out. Bounds are computed in doubles and raised by more than their
rounding error; what is reached is scored exactly at the leaves. Each task returns the best
of what it read, and the best of these are the result.

A ball over all terms bounds an item by everything else that documents hold, and prunes
nothing. So a node has its centroid c and one radius r_g for each group g of terms (those
that only one item has, and every other term by itself): no document below it scores an item
q more than q.c + sum of |q_g| r_g. Scaling a coordinate of all documents by the root of its
weight, and dividing that of the items by it, leaves products as they are and makes balls
tight where terms weigh little.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from skytriage.llm.byte_terms import LETTERS_AND_DIGITS, terms, text_bytes
from skytriage.session import durable

TOP = 50
#: Distinct terms of the items that are searched at a time, and items; an item with more terms is a block of its own.
VOCABULARY = 8192
ITEMS = 4096
#: Documents below a leaf, and numbers in the matrix of a tree.
LEAF = 16
CELLS = 1 << 22
#: Share by which a bound is raised, well above what sums of doubles can lose.
SLACK = 1e-9

_INDEX = "doc_id bigint, n bigint, ids binary, counts binary, held array<bigint>, documents bigint, occurrences bigint"
_FOUND = "item int, doc_id bigint, score bigint"


def _index(vocabulary: list[bytes]):
    """Per document its occurrences of the vocabulary; per task, at its end, documents per term, documents and occurrences."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: k for k, t in enumerate(vocabulary)}
        held, documents, occurrences = np.zeros(len(vocabulary), np.int64), 0, 0
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64())
        names = [c.split(" ")[0] for c in _INDEX.split(", ")]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                n, counts = 0, Counter()
                for words in terms(text_bytes(text), LETTERS_AND_DIGITS):
                    n += len(words)
                    counts.update(filter(number.__contains__, words))
                documents += n > 0
                occurrences += n
                if counts:
                    ids = np.fromiter(map(number.__getitem__, counts), np.int32, len(counts))
                    held[ids] += 1
                    rows.append((doc_id, n, ids.tobytes(), np.fromiter(counts.values(), np.int64, len(counts)).tobytes(), None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=names)
        last = (None, None, None, None, held.tolist(), documents, occurrences)
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(last, kinds)], names=names)

    return index


def groups_of(items: list[list[int]], terms_number: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the terms by group, and where each group starts in it.

    The terms that only one item has are a group; a term that several have is one by itself.
    """
    owners = Counter(t for its in items for t in its)
    group = np.arange(terms_number) + len(items)
    for k, its in enumerate(items):
        for t in its:
            if owners[t] == 1:
                group[t] = k
    order = np.argsort(group, kind="stable")
    return order, np.flatnonzero(np.diff(group[order], prepend=-1))


class Tree:
    """Ball tree over the rows of ``x``: rows ``order[a:b]`` of each node, its children, centroid and a radius per group of columns."""

    def __init__(self, x: np.ndarray, starts: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        self.spans: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        square = np.einsum("ij,ij->i", x, x)
        centroids, stack = [], [(0, len(x), -1, 0)]
        while stack:
            a, b, parent, side = stack.pop()
            here = len(self.spans)
            if parent >= 0:
                self.children[parent] = (here, -1) if not side else (self.children[parent][0], here)
            mine = self.order[a:b]
            rows = x[mine]
            centre = rows.mean(axis=0)
            self.spans.append((a, b))
            self.children.append(None)
            centroids.append(centre)
            if b - a > leaf:
                p = int((square[mine] - 2 * (rows @ centre)).argmax())
                q = int((square[mine] - 2 * (rows @ rows[p])).argmax())
                along = rows @ (rows[q] - rows[p])
                turn = np.argsort(along, kind="stable")
                middle = (square[mine[q]] - square[mine[p]]) / 2
                least = max(1, (b - a) // 8)
                cut = min(max(int((along < middle).sum()), least), b - a - least)
                self.order[a:b] = mine[turn]
                stack += [(a + cut, b, here, 1), (a, a + cut, here, 0)]
        self.centroids = np.array(centroids)
        self.radii = np.zeros((len(self.spans), len(starts)))
        # Children have larger numbers than their parents. A parent's ball holds those of its children.
        for node in range(len(self.spans) - 1, -1, -1):
            centre = self.centroids[node]
            if self.children[node]:
                for child in self.children[node]:
                    away = np.sqrt(np.add.reduceat((self.centroids[child] - centre) ** 2, starts))
                    np.maximum(self.radii[node], away + self.radii[child], out=self.radii[node])
            else:
                a, b = self.spans[node]
                self.radii[node] = np.sqrt(np.add.reduceat((x[self.order[a:b]] - centre) ** 2, starts, axis=1).max(axis=0))


class Best:
    """The best ``top`` (score, id) of an item; a smaller id wins a tie, no id comes last."""

    def __init__(self, top: int):
        self.top, self.heap = top, []

    def least(self) -> int:
        """The lowest score that can still enter."""
        return max(self.heap[0][0], 1) if len(self.heap) == self.top else 1

    def add(self, score: int, doc_id: int | None) -> None:
        entry = (score, doc_id is not None, -(doc_id or 0))
        if len(self.heap) < self.top:
            heapq.heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)


def search_tree(tree: Tree, exact: np.ndarray, ids: list[int | None], items: list[np.ndarray], weights: np.ndarray, bounds: np.ndarray, best: list[Best]) -> int:
    """Offer each item the documents of the tree that may be among its best; the number of leaves scored.

    ``exact`` has the whole-number vectors in the order of the tree, ``bounds`` a bound per node and item.
    """
    leaves = 0
    for k, its_terms in enumerate(items):
        mine, keep, w = bounds[:, k], best[k], weights[its_terms]
        heap = [(-mine[0], 0)]
        while heap and -heap[0][0] >= keep.least():
            node = heapq.heappop(heap)[1]
            below = tree.children[node]
            if below:
                for child in below:
                    if mine[child] >= keep.least():
                        heapq.heappush(heap, (-mine[child], child))
                continue
            leaves += 1
            a, b = tree.spans[node]
            scores = exact[a:b, its_terms].astype(np.int64) @ w
            for row in np.flatnonzero(scores >= keep.least()).tolist():
                keep.add(int(scores[row]), ids[tree.order[a + row]])
    return leaves


def saturated(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def _search(items: list[list[int]], weights: list[int], documents: int, occurrences: int, top: int, cells: int, leaf: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(2 * leaf, cells // max(len(weights), 1))
        # Columns in the order of the groups.
        column, starts = groups_of(items, len(weights))
        place = np.argsort(column)
        w = np.array(weights, np.int64)[column]
        root = np.sqrt(np.maximum(w, 1).astype(np.float64))
        its = [place[np.array(sorted(t), np.int64)] for t in items]
        queries = np.zeros((len(items), len(weights)))
        for k, t in enumerate(its):
            queries[k, t] = w[t] / root[t]
        lengths = np.sqrt(np.add.reduceat(queries * queries, starts, axis=1)) if len(weights) else queries
        best = [Best(top) for _ in items]
        held: list[tuple] = []

        def flush() -> None:
            if not held:
                return
            width = np.array([len(ids) for _, _, ids, _ in held])
            m = np.array([50 + 50 * n * documents // occurrences for _, n, _, _ in held], np.int64)
            exact = np.zeros((len(held), len(weights)), np.int32)
            exact[np.repeat(np.arange(len(held)), width), place[np.concatenate([ids for _, _, ids, _ in held])]] = saturated(
                np.concatenate([tf for _, _, _, tf in held]), np.repeat(m, width))
            tree = Tree(exact * root, starts, leaf)
            bounds = (tree.centroids @ queries.T + tree.radii @ lengths.T) * (1 + SLACK) + 1
            search_tree(tree, exact[tree.order], [doc_id for doc_id, *_ in held], its, w, bounds, best)
            held.clear()

        for batch in batches:
            for doc_id, n, ids, counts in zip(*(batch.column(c).to_pylist() for c in range(4))):
                held.append((doc_id, n, np.frombuffer(ids, np.int32), np.frombuffer(counts, np.int64)))
                if len(held) == size:
                    flush()
        flush()
        rows = [(k, -entry[2] if entry[1] else None, entry[0]) for k, b in enumerate(best) for entry in b.heap]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.int32(), pa.int64(), pa.int64()))], names=["item", "doc_id", "score"])

    return search


def _item_blocks(items: DataFrame, item_col: str, text_col: str, vocabulary: int, most: int) -> Iterator[tuple[list, list[set[bytes]]]]:
    """Ids and terms of items, so many at a time that their distinct terms and number stay bounded."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({w for words in terms(text_bytes(t), LETTERS_AND_DIGITS) for w in words}) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], names=["item_id", "terms"])

    named = items.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{text_col}`").alias("text"))
    kind = named.schema["item_id"].dataType.simpleString()
    ids, held, distinct = [], [], set()
    for row in named.mapInArrow(cut, f"item_id {kind}, terms array<binary>").toLocalIterator():
        mine = {bytes(t) for t in row["terms"]}
        if ids and (len(distinct | mine) > vocabulary or len(ids) == most):
            yield ids, held
            ids, held, distinct = [], [], set()
        ids.append(row["item_id"])
        held.append(mine)
        distinct |= mine
    if ids:
        yield ids, held


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
           top: int = TOP, vocabulary: int = VOCABULARY, most: int = ITEMS, cells: int = CELLS, leaf: int = LEAF) -> DataFrame:
    """The ``top`` documents of each item with a score above 0: ``item_id, rank, doc_id, score``.

    Items are taken in blocks of at most ``most`` items and ``vocabulary`` distinct terms, each
    searched against all documents. Null and blank texts have no terms and are found by no
    item; rows with the same id are ranked apart, a row without id after all others of its
    score; items that share an id are answered apart, one after the other under that id. An
    empty table of documents or items gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    wanted = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = items.schema[item_col].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    for ids, held in _item_blocks(items, item_col, item_text_col, vocabulary, most):
        words = sorted(set().union(*held))
        index = durable(wanted.mapInArrow(_index(words), _INDEX))
        totals = index.where("held IS NOT NULL")
        n, occurrences = totals.agg(F.sum("documents"), F.sum("occurrences")).first()
        if not n:
            continue
        df = {r["pos"]: r["df"] for r in totals.select(F.posexplode("held")).groupBy("pos").agg(F.sum("col").alias("df")).collect()}
        number = {t: k for k, t in enumerate(words)}
        job = _search([[number[t] for t in its] for its in held], [weight(n, df[k]) for k in range(len(words))], n, occurrences, top, cells, leaf)
        found = index.where("held IS NULL").select("doc_id", "n", "ids", "counts").mapInArrow(job, _FOUND)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        # One row per item of the block.
        names = spark.createDataFrame([Row(item=k, item_id=i) for k, i in enumerate(ids)], f"item int, item_id {kind}")
        out = out.unionByName(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
i AS (SELECT DISTINCT i, item_id, term FROM (SELECT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS i, * FROM benchmark))),
f AS (SELECT r, doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
s AS (SELECT r, count(*) AS n FROM d GROUP BY r),
t AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS l FROM s),
m AS (SELECT r, 100 - 50 + (50 * n * n_docs) // l AS m FROM s, t),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM f, t GROUP BY term, n_docs),
x AS (SELECT i, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
      FROM i JOIN f USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM x WHERE score > 0 QUALIFY rank <= 50
"""
