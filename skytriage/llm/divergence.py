"""Source divergence audit by single-pass in-memory indexing (operator 11).

Every task builds the postings of a block in memory: per language and source, the
occurrences of each term and the documents that hold it. When a block is full it is written
out as a run: its terms in order, cut by hash shard into parts of at most ``PART`` postings.
The parts of a shard meet sorted by their first term and are merged with a heap: a part is
opened when the merge reaches its first term, so what is held is the parts that overlap,
not the shard. The merge gives each term's occurrences per source; terms in fewer than
``MIN_DOCS`` documents of the language end there.

How far two sources diverge is a sum over all terms of the language, nearly all of which at
least one of the two lacks. With p the share of a term in a source, p0 that of a term it
lacks, and f the divergence of two shares, the sum over all V terms is

    V f(p0, q0) + (terms of the one, against q0) + (terms of the other, against p0)
    + (corrections for the terms that both hold)

where the two middle sums need only how many terms of a source occur how often. The
corrections are streamed from the merged terms, one batch at a time, and added per pair of
sources. All of it is whole-number arithmetic.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skytriage.llm.byte_terms import LETTERS, terms, text_bytes
from skytriage.session import durable

MIN_DOCS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
#: Postings (term of a source) after which a block is written out as a run, about 250 bytes each.
BLOCK = 600_000
#: Postings of a part of a run.
PART = 4096

_RUN = "shard int, lang string, first binary, terms binary, sizes binary, names array<string>, sources binary, counts binary, docs binary"
_TERM = "lang string, term string, total bigint, sources array<string>, counts array<bigint>"


class Block:
    """Postings of the documents read since the last run."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        self.size = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        counts, docs = self.groups.setdefault((lang, source), (Counter(), Counter()))
        before, held = len(counts), set()
        for words in terms(text, LETTERS):
            counts.update(words)
            held.update(words)
        docs.update(held)
        self.size += len(counts) - before

    def run(self, shards: int) -> Iterator[tuple]:
        """The block's parts, each sorted by term, as rows of ``_RUN``."""
        by_lang: dict[str, list[tuple[str, Counter, Counter]]] = {}
        for (lang, source), (counts, docs) in self.groups.items():
            by_lang.setdefault(lang, []).append((source, counts, docs))
        for lang, held in by_lang.items():
            yield from _parts(lang, held, shards)


def _parts(lang: str, held: list[tuple[str, Counter, Counter]], shards: int) -> Iterator[tuple]:
    words = list(chain.from_iterable(counts for _, counts, _ in held))
    if not words:
        return
    source = np.repeat(np.arange(len(held), dtype=np.int32), [len(counts) for _, counts, _ in held])
    n = np.fromiter(chain.from_iterable(counts.values() for _, counts, _ in held), np.int64, len(words))
    d = np.fromiter(chain.from_iterable(map(docs.__getitem__, counts) for _, counts, docs in held), np.int64, len(words))
    shard = np.fromiter(map(zlib.crc32, words, repeat(zlib.crc32(lang.encode()))), np.uint32, len(words)) % np.uint32(shards)
    order = pc.sort_indices(pa.array(words, pa.large_binary())).to_numpy()
    order = order[np.argsort(shard[order], kind="stable")]
    shard, source, n, d = shard[order], source[order], n[order], d[order]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(words)]])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        for at in range(a, b, PART):
            to = min(at + PART, b)
            there = [words[i] for i in order[at:to].tolist()]
            heads = [0] + [k for k in range(1, len(there)) if there[k] != there[k - 1]]
            used, local = np.unique(source[at:to], return_inverse=True)
            yield (int(shard[at]), lang, there[0], b" ".join([there[k] for k in heads]), np.diff([*heads, len(there)]).astype(np.int32).tobytes(),
                   [held[s][0] for s in used.tolist()], local.astype(np.int32).tobytes(), n[at:to].tobytes(), d[at:to].tobytes())


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _runs(shards: int, block_size: int):
    schema = pa.schema([("shard", pa.int32()), ("lang", pa.string()), *((c, pa.binary()) for c in ("first", "terms", "sizes")),
                        ("names", pa.list_(pa.string())), *((c, pa.binary()) for c in ("sources", "counts", "docs"))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        block = Block()
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                block.add(lang, source, text_bytes(text))
                if block.size >= block_size:
                    yield from block.run(shards)
                    block = Block()
        yield from block.run(shards)

    return lambda batches: _batches(rows(batches), schema, 256)


def merged(parts: Iterator[tuple], min_docs: int) -> Iterator[tuple]:
    """Rows of ``_TERM`` from parts sorted by (language, first term), by a heap of the open parts."""
    heap: list[tuple] = []
    serial = 0

    def advance(limit: bytes | None) -> Iterator[tuple]:
        while heap and (limit is None or heap[0][0] < limit):
            term, total, docs, held = heap[0][0], 0, 0, {}
            while heap and heap[0][0] == term:
                _, mark, k, at, part = heap[0]
                words, sizes, names, sources, counts, seen = part
                to = at + sizes[k]
                for i in range(at, to):
                    name = names[sources[i]]
                    held[name] = held.get(name, 0) + counts[i]
                    total += counts[i]
                    docs += seen[i]
                if k + 1 < len(words):
                    heapq.heapreplace(heap, (words[k + 1], mark, k + 1, to, part))
                else:
                    heapq.heappop(heap)
            if docs >= min_docs:
                names = sorted(held)
                yield lang, term.decode(), total, names, [held[s] for s in names]

    lang = None
    for its_lang, first, words, sizes, names, sources, counts, docs in parts:
        if its_lang != lang:
            yield from advance(None)
            lang = its_lang
        # What starts before this part is complete: no later part holds such a term.
        yield from advance(first)
        ints = [np.frombuffer(b, t).tolist() for b, t in ((sizes, np.int32), (sources, np.int32), (counts, np.int64), (docs, np.int64))]
        heapq.heappush(heap, (first, serial, 0, 0, (words.split(b" "), ints[0], names, *ints[1:])))
        serial += 1
    yield from advance(None)


def _merge(min_docs: int):
    schema = pa.schema([("lang", pa.string()), ("term", pa.string()), ("total", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield tuple(batch.column(c)[k].as_py() for c in range(batch.num_columns))

    return lambda batches: _batches(merged(rows(batches), min_docs), schema, 4096)


def frequencies(docs: DataFrame, shards: int | None = None, block_size: int = BLOCK, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang, term, total, sources, counts`` of every term in at least ``min_docs`` documents of its language.

    ``docs`` has ``lang, source, text`` without null languages or sources. ``shards`` is the
    session's number of shuffle partitions unless given. A term's parts meet in one task,
    one posting per run and source, however often it occurs.
    """
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = docs.select("lang", "source", "text").mapInArrow(_runs(shards, block_size), _RUN)
    placed = runs.repartitionById(shards, F.col("shard")).sortWithinPartitions("lang", "first")
    return placed.select("lang", "first", "terms", "sizes", "names", "sources", "counts", "docs").mapInArrow(_merge(min_docs), _TERM)


def share(n: Column, total: Column) -> Column:
    """1 + floor(10^9 (n + 1) / total), exact while ``total`` is below 9 * 10^15 (three steps of a long division)."""
    total = F.greatest(total, F.lit(1).cast("bigint"))
    out, rest = F.lit(1).cast("bigint"), n + 1
    for step in (1_000_000, 1000, 1):
        rest = rest * 1000
        out = out + F.call_function("div", rest, total) * step
        rest = rest % total
    return out


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch and ordered pair of sources, what the terms that both hold add to the sums of single sources.

    Rows (lang, term, source, p, p0) come sorted by (lang, term); the last term of a batch
    is kept for the next one, since it may go on there.
    """
    held: pa.Table | None = None

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        langs, group = (np.asarray(t.column(c).combine_chunks().dictionary_encode().indices) for c in (0, 1))
        start = np.concatenate([[True], (np.diff(langs) != 0) | (np.diff(group) != 0)])
        first = np.flatnonzero(start)
        size = np.diff([*first, len(start)])
        rest = np.repeat(first + size, size) - np.arange(len(start))  # rows of the term from this one on
        names = t.column(2).combine_chunks().dictionary_encode()
        source, p, p0 = np.asarray(names.indices).astype(np.int64), np.asarray(t.column(3)), np.asarray(t.column(4))
        keys, values, width = [], [], len(names.dictionary)
        for k in range(1, int(size.max())):
            i = np.flatnonzero(rest > k)
            for a, b in ((i, i + k), (i + k, i)):
                f = lambda x, y: (x - y) * (x - y) // y
                keys.append((langs[a].astype(np.int64) * width + source[a]) * width + source[b])
                values.append(f(p[a], p[b]) - f(p[a], p0[b]) - f(p0[a], p[b]) + f(p0[a], p0[b]))
        if not keys:
            return
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, at, np.concatenate(values))
        lang_names = t.column(0).combine_chunks().dictionary_encode().dictionary
        yield pa.RecordBatch.from_arrays([lang_names.take(pa.array(key // (width * width))), names.dictionary.take(pa.array(key // width % width)),
                                          names.dictionary.take(pa.array(key % width)), pa.array(total)], names=["lang", "source", "item", "value"])

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]) if held is not None else t
        if not t.num_rows:
            continue
        last = t.num_rows - 1
        lang, term = t.column(0)[last].as_py(), t.column(1)[last].as_py()
        whole = t.num_rows - int(np.asarray(pc.and_(pc.equal(t.column(0), lang), pc.equal(t.column(1), term))).sum())
        if whole:
            yield from pairs(t.slice(0, whole))
        held = t.slice(whole)
    if held is not None and held.num_rows:
        yield from pairs(held)


def divergence(docs: DataFrame, top: int = TOP_TERMS, shards: int | None = None, block_size: int = BLOCK, min_docs: int = MIN_DOCS) -> DataFrame:
    """How sources of a language differ: ``lang, source, part, item, value, rank``.

    Part ``pair`` has every other source of the language with the divergence summed over all
    kept terms; part ``term`` the ``top`` terms that are more frequent in the source than in
    its language. Ranks start at 1, larger values first, equal ones by item (bytes).
    Null text, lang and source count as empty; a repeated row is a document of its own; a
    source without terms has its pairs; a language without kept terms has pairs of value 0
    and no terms; an empty table gives no rows. Texts are read whole, a megabyte at a time; a
    task holds one block and the distinct terms of one document. Other columns are not read.
    """
    docs = docs.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    found = durable(frequencies(docs, shards, block_size, min_docs))
    held = found.select("lang", "term", "total", F.size("sources").alias("width"), F.explode(F.arrays_zip("sources", "counts")).alias("x")).select(
        "lang", "term", "total", "width", F.col("x.sources").alias("source"), F.col("x.counts").alias("n"))
    in_lang = found.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    in_source = held.groupBy("lang", "source").agg(F.sum("n").alias("source_n"))
    groups = docs.select("lang", "source").distinct().join(in_source, ["lang", "source"], "left").join(in_lang, "lang", "left").na.fill(0)
    size = F.col("source_n") + F.col("v")
    groups = durable(groups.withColumn("p0", share(F.lit(0).cast("bigint"), size)).withColumn("size", size).withColumn("lang_size", F.col("lang_n") + F.col("v")))

    terms_p = held.join(groups, ["lang", "source"]).select("lang", "source", "term", "width", "p0", "lang_size", "total", share(F.col("n"), F.col("size")).alias("p"))
    own = terms_p.withColumn("q", share(F.col("total"), F.col("lang_size"))).where(F.col("p") > F.col("q")).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))

    shared = terms_p.where(F.col("width") > 1).select("lang", "term", "source", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term")
    corrections = shared.mapInArrow(_corrections, "lang string, source string, item string, value bigint")
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    often = held.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("h")).join(groups, ["lang", "source"])
    p, q, p0, q0 = share(F.col("n"), F.col("size")), F.col("q"), F.col("p0"), F.col("q0")
    often = often.select("lang", "source", "h", "p0", p.alias("q")).join(other, "lang").where(F.col("source") != F.col("item"))
    singles = often.select("lang", F.inline(F.array(
        F.struct(F.col("source"), F.col("item"), (F.col("h") * (gap(q, q0) - gap(p0, q0))).alias("value")),
        F.struct(F.col("item").alias("source"), F.col("source").alias("item"), (F.col("h") * (gap(q0, q) - gap(q0, p0))).alias("value")))))
    pairs = groups.select("lang", "source", "v", "p0").join(other, "lang").where(F.col("source") != F.col("item"))
    floor = pairs.select("lang", "source", "item", (F.col("v") * gap(p0, q0)).alias("value"))
    summed = floor.unionByName(singles).unionByName(corrections).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    def best(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
        return rows.withColumn("rank", F.row_number().over(order))

    pair = best(summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value"))
    return pair.unionByName(best(own).where(F.col("rank") <= top))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM t GROUP BY ALL),
k AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY ALL HAVING sum(docs) >= 3),
v AS (SELECT lang, count(*) AS v, CAST(sum(total) AS BIGINT) AS lang_n FROM k GROUP BY ALL),
n AS (SELECT lang, source, CAST(sum(n) AS BIGINT) AS source_n FROM c JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(lang_n, 0) AS lang_n, coalesce(source_n, 0) AS source_n
      FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang) LEFT JOIN n USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
             1 + 1000000000 * (coalesce(c.n, 0) + 1) // (g.source_n + g.v) AS p, 1 + 1000000000 * (k.total + 1) // (g.lang_n + g.v) AS q
      FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM o QUALIFY part = 'pair' OR rank <= 200
"""
