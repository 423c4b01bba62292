"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skytriage.session import durable, ensure_checkpoint_dir

#: A key is hot when it holds at least this share of the rows; there are at most its inverse of them.
HOT_SHARE = 1 / 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder, so that a join with it is planned by its real size."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def fold(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % F.lit(parts)


def attach(rows: DataFrame, mapping: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` with the columns of ``mapping`` (one row per ``key``) joined on, hot keys split.

    ``size`` is the column of ``mapping`` with the number of rows of its key. Keys with at
    least ``HOT_SHARE`` of all rows, of which there can be no more than 1 / HOT_SHARE, are
    broadcast and joined where the rows are; the others meet in a shuffle in which no key
    holds more than that share. Rows with a null key or one that is not in ``mapping`` are lost.
    """
    total = mapping.agg(F.sum(size)).first()[0] or 0
    limit = max(total * HOT_SHARE, 1000)
    hot = F.broadcast(mapping.where(F.col(size) >= limit))
    near = rows.join(hot, key)
    far = rows.join(F.broadcast(mapping.where(F.col(size) >= limit).select(key)), key, "left_anti").join(mapping.where(F.col(size) < limit), key)
    return near.unionByName(far)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Label the ends of ``edges`` with the smallest end that links lead to: ``node, component``.

    Rounds of two steps (every node points its larger neighbours, then its smaller ones, at
    the smallest node it sees) until the edges are stars; each round is written to the
    checkpoint folder. Ends are never gathered in one group: sums per node combine before
    the shuffle and the join splits a node with many links. Loops and nulls are ignored.
    """
    u, v = F.col("u"), F.col("v")
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where((u != v) & F.col(a).isNotNull() & F.col(b).isNotNull())
    e = durable(e.distinct())
    seen = None
    while True:
        both = e.unionByName(e.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where(v > u).join(low, "u").select(v.alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(v.alias("u"), F.col("m").alias("v")).where(u != v).unionByName(low.select("u", F.col("m").alias("v")))
        e = durable(small.distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(v.alias("node"), v.alias("component")).distinct())


def add_vectors(parts: DataFrame, kind: str = "float64", spread: int = 32) -> DataFrame:
    """Sums of the vectors in ``parts`` (name string, task int, vector binary of ``kind``) by name: ``name, vector``.

    Added in two steps, first within classes of ``task``, so that no group holds a vector of
    every task. Callers cut long vectors into pieces of their own name.
    """
    import numpy as np
    import pyarrow as pa

    def add(rows: pa.Table) -> pa.Table:
        total = None
        for v in rows.column("vector"):
            x = np.frombuffer(v.as_py(), dtype=kind)
            total = x.copy() if total is None else total + x
        return pa.table({"name": [rows.column("name")[0].as_py()], "task": pa.array([0], pa.int32()), "vector": [total.tobytes()]})

    shape = "name string, task int, vector binary"
    some = parts.select("name", (F.col("task") % spread).cast("int").alias("task"), "vector").groupBy("name", "task").applyInArrow(add, shape)
    return some.groupBy("name").applyInArrow(add, shape).select("name", "vector")
