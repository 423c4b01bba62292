"""Document fingerprints by context-triggered piecewise hashing (operator 12).

A rolling hash over ``WINDOW`` bytes ends a piece wherever its low ``level`` bits are zero,
so a piece is 2^level bytes on average and an edit changes only the pieces it touches; what
goes on for ``LONGEST`` times that (a word repeated) is cut every so many bytes. The
block size of a text is the largest at which windows end at least ``PIECES`` pieces, of the
three from a quarter of its length over ``PIECES`` upwards (the smallest if none does). A fingerprint has the block size and one signature, a
list of 16-bit hashes of whole pieces, for it and for each of the next two sizes, which
makes texts comparable whose block sizes are at most two steps apart. Likeness is one minus
the edit distance (insertions and deletions) over the sum of lengths, at the finest size
that both have; texts without a common size are unlike.

The edited text of a document needs the document that follows it in the order of ids. Rows
are dealt to blocks of that order by bounds known beforehand, and the first document of each
block also goes to the block before it, so each task reads its block once, in order. Texts
are compressed on the way.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 8
#: Pieces that a text should have at its block size, and bits of the smallest block size.
PIECES = 32
FINEST = 2
#: Block sizes with a signature in a fingerprint.
LEVELS = 3
#: A text that repeats itself may end a piece at every repeat; beyond so many pieces every second (fourth, ...) end counts.
CROWDED = 16 * PIECES
#: Longest piece, as a multiple of the block size; a longer stretch without an end is cut there.
LONGEST = 4
#: Bytes whose rolling hashes are computed at a time.
SPAN = 1 << 20

_M1, _M2, _M4 = (np.uint32(pow(0x2C1B3C6D, k, 1 << 32)) for k in (1, 2, 4))


def _ends(data: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces end for the lowest ``level`` bits (offset after the last byte), and how many low bits are zero there."""
    ends, depths = [], []
    for at in range(0, len(data) - WINDOW + 1, SPAN):
        x = data[at: at + SPAN + WINDOW - 1].astype(np.uint32)
        x = x[1:] + _M1 * x[:-1]
        x = x[2:] + _M2 * x[:-2]
        x = x[4:] + _M4 * x[:-4]
        x *= np.uint32(0x9E3779B1)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        hit = np.flatnonzero((x & np.uint32((1 << level) - 1)) == 0)
        low = x[hit].astype(np.int64) | 1 << 32
        ends.append(hit + at + WINDOW)
        depths.append(np.log2((low & -low).astype(np.float64)).astype(np.int64))
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(ends), np.concatenate(depths)) if ends else (none, none)


def _cuts(size: int, ends: np.ndarray, longest: int) -> list[int]:
    """Offsets of piece borders: 0, ``ends`` with further cuts every ``longest`` bytes from the last end, ``size``."""
    cuts = [0, *ends.tolist()]
    if not ends.size or cuts[-1] < size:
        cuts.append(size)
    if max(np.diff(cuts), default=0) <= longest:
        return cuts
    return [*(x for a, b in zip(cuts, cuts[1:]) for x in range(a, b, longest)), size]


def _signature(data: memoryview, ends: np.ndarray, longest: int) -> str:
    cuts = _cuts(len(data), ends, longest)
    hashes = np.array([xxhash.xxh3_64_intdigest(data[a:b]) & 0xFFFF for a, b in zip(cuts, cuts[1:])], dtype=">u2")
    return hashes.tobytes().hex()


def fingerprint(data: bytes) -> str:
    """``level:signature:signature:signature`` of UTF-8 bytes; equal bytes have equal fingerprints."""
    view = np.frombuffer(data, np.uint8)
    coarsest = max(FINEST, (len(data) // PIECES).bit_length() - 1)
    level = max(FINEST, coarsest - 2)
    ends, depths = _ends(view, level)
    if len(ends) >= PIECES:
        level = min(int(np.partition(depths, -PIECES)[-PIECES]), coarsest)
    parts = []
    for k in range(level, level + LEVELS):
        mine = ends[depths >= k]
        step = 1
        while len(mine) > step * CROWDED:
            step *= 2
        parts.append(_signature(memoryview(data), mine[::step], LONGEST * step << k))
    return ":".join([str(level), *parts])


def _common(s: list[int], t: list[int]) -> int:
    """Length of the longest common subsequence, one bit per element of ``s``."""
    where: dict[int, int] = {}
    for k, x in enumerate(s):
        where[x] = where.get(x, 0) | 1 << k
    ones = (1 << len(s)) - 1
    open_bits = ones
    for y in t:
        hit = where.get(y)
        if hit:
            u = open_bits & hit
            open_bits = ((open_bits + u) | (open_bits - u)) & ones
    return len(s) - open_bits.bit_count()


def likeness(a: str, b: str) -> float:
    """0 to 1: how much of two fingerprints agrees in order at the finest block size that both have."""
    if a == b:
        return 1.0
    (x, *xs), (y, *ys) = a.split(":"), b.split(":")
    at = max(int(x), int(y))
    if at >= min(int(x), int(y)) + LEVELS:
        return 0.0
    s, t = (np.frombuffer(bytes.fromhex(p), ">u2").tolist() for p in (xs[at - int(x)], ys[at - int(y)]))
    return 2 * _common(s, t) / (len(s) + len(t))


_PLACED = "block int, guest int, absent boolean, down bigint, tie bigint, doc_id bigint, n_chars bigint, fingerprint string, packed binary"
_OUT = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _place(bounds: list[tuple[bool, int, int]]):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            rows = []
            for absent, down, tie, doc_id, text in zip(*(batch.column(c).to_pylist() for c in range(5))):
                key = (absent, down, tie)
                block = bisect_right(bounds, key) - 1
                data = text.encode()
                row = (absent, down, tie, doc_id, len(text), fingerprint(data), pack(data))
                rows.append((block, 0, *row))
                if bounds[block] == key:
                    rows.append(((block - 1) % len(bounds), 1, *row))
            kinds = (pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            names = [c.split(" ")[0] for c in _PLACED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 9, kinds)], names=names)

    return place


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document with the one after it; the rows of a block come in order, the guest at the end."""
    last = None
    unpack = zstandard.ZstdDecompressor().decompress
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = [c.split(" ")[0] for c in _OUT.split(", ")]
    for batch in batches:
        out = []
        for guest, doc_id, n, mark, packed in zip(*(batch.column(c).to_pylist() for c in range(5))):
            text = unpack(packed).decode()
            if last is not None:
                its_id, its_n, its_mark, its_text = last
                edited = (its_text[: its_n - its_n // 2] + text[: its_n // 2]).encode()
                new = fingerprint(edited)
                out.append((its_id, its_n, hashlib.sha256(edited).hexdigest(), its_mark, new, likeness(its_mark, new), likeness(its_mark, mark)))
            last = None if guest else (doc_id, n, mark, text)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 7, kinds)], names=names)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The next document has the next smaller id, rows without an id come last, rows with the
    same id in the order of a hash of their texts, and the first follows the last; in a table
    of one row it is the row itself. A null text is empty; an empty text has one empty piece.
    Repeated rows follow each other and each has its own result. An empty table gives no rows.
    Other columns are not read. A task holds two texts at a time besides Spark's batches.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    doc_id = F.col(f"`{id_col}`").cast("bigint")
    keyed = docs.select(doc_id.isNull().alias("absent"), F.coalesce(F.bitwise_not(doc_id), F.lit(0)).cast("bigint").alias("down"), F.xxhash64(text).alias("tie"),
                        doc_id.alias("doc_id"), text.alias("text"))
    # One row per block of the order: their number is that of shuffle partitions, whatever the table.
    order = ["absent", "down", "tie"]
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = keyed.select(*order).repartitionByRange(blocks, *order).groupBy(F.spark_partition_id()).agg(F.min(F.struct(*order)).alias("x")).collect()
    bounds = sorted(tuple(r["x"]) for r in first)
    if not bounds:
        return spark.createDataFrame([], _OUT)
    placed = keyed.mapInArrow(_place(bounds), _PLACED).repartitionById(len(bounds), F.col("block")).sortWithinPartitions("guest", *order)
    return placed.select("guest", "doc_id", "n_chars", "fingerprint", "packed").mapInArrow(_follow, _OUT)
