"""Near duplicates by SimHash fingerprints that meet under Golay-code keys (operator 8).

A fingerprint of 64 bits is cut into segments of 22, 21 and 21 bits. If two fingerprints
differ in at most three bits, at least two of the three segments differ in at most one bit
each: three differences cannot put two into two segments. For each of the three pairs of
segments a fingerprint is stored under the codeword indices of both segments (one key), and
looked up under every combination of nearby indices (28 keys on average). ``golay`` shows
that words one flip apart meet under such keys, so no link is missed; what meets is verified
by counting differing bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytriage.llm.common import attach, components
from skytriage.llm.fingerprint import fingerprints
from skytriage.llm.golay import near_keys, own_key
from skytriage.session import durable

MAX_BITS = 3
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Stored fingerprints per key up to which they are joined row by row; more are compared in tiles.
KEY_LIMIT = 512


def _segments(fps: np.ndarray) -> list[np.ndarray]:
    bits = fps.view(np.uint64)
    return [(bits >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        own = [own_key(s) for s in _segments(fps)]
        keys = np.concatenate([pair << 24 | own[i] << 12 | own[j] for pair, (i, j) in enumerate(PAIRS)])
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(np.tile(fps, 3))], names=["key", "fp"])


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        near = [near_keys(s) for s in _segments(fps)]
        for pair, (i, j) in enumerate(PAIRS):
            both = near[i][1][:, :, None] & near[j][1][:, None, :]
            keys = pair << 24 | near[i][0][:, :, None] << 12 | near[j][0][:, None, :]
            row = np.nonzero(both)[0]
            yield pa.RecordBatch.from_arrays([pa.array(keys[both].astype(np.int32)), pa.array(fps[row])], names=["key", "other"])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what ``a`` and ``b`` links join, no more of them than there are ends."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        p, q = top(x), top(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
    pairs = [(x, top(x)) for x in parent if top(x) != x]
    return np.array([x for x, _ in pairs], dtype=np.int64), np.array([y for _, y in pairs], dtype=np.int64)


def _tile(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """A forest of the links between two tiles of a crowded key."""
    x, y = left["fp"].to_numpy(np.int64), right["other"].to_numpy(np.int64)
    found: list[np.ndarray] = []
    for at in range(0, len(x), 1024):
        part = x[at: at + 1024]
        for to in range(0, len(y), 4096):
            i, j = np.nonzero(np.bitwise_count(part[:, None].view(np.uint64) ^ y[None, to: to + 4096].view(np.uint64)) <= MAX_BITS)
            a, b = _forest(part[i], y[to: to + 4096][j])
            found.append(np.stack([a, b]))
    a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), dtype=np.int64)
    a, b = _forest(a, b)
    return pd.DataFrame({"a": a, "b": b})


def links(distinct: DataFrame, key_limit: int = KEY_LIMIT) -> DataFrame:
    """Links ``a, b`` among the rows of ``fp`` (each value once) that connect all within three bits.

    Keys with more than ``key_limit`` stored fingerprints are compared in tiles of about that
    size, each of which returns a forest of its links instead of all pairs.
    """
    stored = distinct.select("fp").mapInArrow(_stored, "key int, fp bigint")
    asked = distinct.select("fp").mapInArrow(_looked_up, "key int, other bigint")
    crowded = durable(stored.groupBy("key").count().where(F.col("count") > key_limit)
                      .select("key", F.ceil(F.col("count") / key_limit).cast("int").alias("tiles")))
    within = (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= MAX_BITS) & (F.col("fp") != F.col("other"))
    if crowded.isEmpty():
        return stored.join(asked, "key").where(within).select(F.col("fp").alias("a"), F.col("other").alias("b"))
    plain = stored.join(crowded, "key", "left_anti").join(asked, "key").where(within).select(F.col("fp").alias("a"), F.col("other").alias("b"))
    left = (stored.join(crowded, "key").withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
            .withColumn("side", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))))
    right = (asked.join(crowded, "key").withColumn("side", F.pmod(F.xxhash64("other"), F.col("tiles")).cast("int"))
             .withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))))
    tiled = (left.groupBy("key", "tile", "side").cogroup(right.groupBy("key", "tile", "side"))
             .applyInPandas(_tile, "a bigint, b bigint"))
    return plain.unionByName(tiled)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_limit: int = KEY_LIMIT) -> DataFrame:
    """Per row of ``docs``: ``doc_id, fp, component_id, copies``.

    ``component_id`` is the smallest id reachable by links of at most three differing bits
    and ``copies`` the number of rows with the same fingerprint. Null and blank texts share
    fingerprint zero and are linked like any other. Rows with the same id stay apart as rows;
    a null id keeps its row and is smallest only where no other id is in reach. Other columns
    of ``docs``, whatever their names, are not read. An empty table gives no rows.
    """
    marked = durable(fingerprints(docs, id_col, text_col))
    groups = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")))
    labels = components(links(groups, key_limit))
    named = groups.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    mapping = durable(named.join(lowest, "component").select("fp", "component_id", "copies"))
    return attach(marked, mapping, "fp", "copies").select("doc_id", "fp", "component_id", "copies")


def fingerprint_hex(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
