"""Sharding by extendible hashing under a byte limit (operator 1).

A document belongs to the bucket named by the first bits of the hash of its key. Starting
from one bucket for all, a bucket over the limit is split on the next bit, and only such a
bucket, until every shard fits. The directory is found on sums of bytes per hash prefix:
one pass adds them up for every prefix length down to a depth at which buckets are a small
fraction of the limit, and only prefixes still too large there go one pass deeper.

Rows that agree in key and text cannot be told apart by any bit. If copies of one row alone
exceed the limit, their bucket goes on in overflow pages of as many copies as fit. A single
row larger than the limit is a shard of its own, marked oversized.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytriage.session import durable

MAX_BYTES = 16 << 20
HASH_BITS = 60
#: Further bits per pass below the depth at which an average bucket would just fit.
SLACK_BITS = 5
#: Copies of one row that a task writes at once.
RUN = 4096


def prefix(depth: Column) -> Column:
    """The first ``depth`` bits of ``hash``, as a number; 0 for depth 0."""
    return F.call_function("shiftright", F.col("hash"), (F.lit(HASH_BITS) - depth).cast("int"))


def directory(groups: DataFrame, limit: int) -> DataFrame:
    """Buckets ``hash_prefix, depth`` that cover all hashes, none over ``limit`` that can be split.

    ``groups`` has ``hash, bytes, rows``, one row or more per hash.
    """
    groups = groups.select("hash", "bytes", "rows")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    bits = min(HASH_BITS, max(0, math.ceil(math.log2(max(1, total / max(1, limit))))) + SLACK_BITS)
    done, at, left = None, 0, groups
    while True:
        deep = min(HASH_BITS, at + bits)
        # Sums at the deepest level first, so that the levels are added up over few rows.
        fine = (left.groupBy(prefix(F.lit(deep)).alias("p"))
                .agg(F.sum("bytes").alias("bytes"), F.min("hash").alias("low"), F.max("hash").alias("high")))
        level = fine.withColumn("depth", F.explode(F.sequence(F.lit(at), F.lit(deep))))
        sums = (level.groupBy("depth", F.call_function("shiftright", F.col("p"), (F.lit(deep) - F.col("depth")).cast("int")).alias("p"))
                .agg(F.sum("bytes").alias("bytes"), F.min("low").alias("low"), F.max("high").alias("high")))
        sums = durable(sums.withColumn("splits", (F.col("bytes") > limit) & (F.col("low") != F.col("high"))))
        above = sums.where("splits").select((F.col("depth") + 1).alias("depth"), F.col("p").alias("q"))
        node = sums.withColumn("q", F.call_function("shiftright", F.col("p"), F.lit(1)))
        reached = node.join(above, ["depth", "q"], "left_semi").unionByName(node.where(F.col("depth") == at))
        leaf = reached.where(~F.col("splits")).select(F.col("p").alias("hash_prefix"), "depth")
        done = leaf if done is None else done.unionByName(leaf)
        open_ = sums.where(F.col("splits") & (F.col("depth") == deep)).select("p")
        if deep == HASH_BITS or open_.isEmpty():
            return durable(done)
        left = durable(left.withColumn("p", prefix(F.lit(deep))).join(open_, "p", "left_semi").drop("p"))
        at = deep


def assign(docs: DataFrame, limit: int = MAX_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_bytes, hash, shard_id, depth, page, shard_bytes, shard_rows, oversized``.

    ``shard_id`` is the prefix in binary digits, with ``+page`` from the second overflow page
    on. The hash is taken from id and text, so rows of one id spread; a null id counts as the
    empty text there, a null text as empty (0 bytes). An empty table has no shards.
    """
    n_bytes = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("bigint")
    key = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    rows = docs.select(F.col(id_col).alias("doc_id"), n_bytes.alias("n_bytes"), F.conv(F.substring(key, 1, HASH_BITS // 4), 16, 10).cast("bigint").alias("hash"))
    groups = durable(rows.groupBy("doc_id", "hash", "n_bytes").agg(F.count(F.lit(1)).alias("copies")))
    sized = groups.select("hash", (F.col("n_bytes") * F.col("copies")).alias("bytes"), F.col("copies").alias("rows"))
    buckets = directory(sized, limit)
    depths = sorted(r["depth"] for r in buckets.select("depth").distinct().collect())
    found = None
    for d in depths:
        part = (groups.withColumn("hash_prefix", prefix(F.lit(d))).join(buckets.where(F.col("depth") == d), "hash_prefix"))
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = groups.withColumns({"hash_prefix": F.lit(0).cast("bigint"), "depth": F.lit(0)})
    sums = found.groupBy("hash_prefix", "depth").agg(F.sum(F.col("n_bytes") * F.col("copies")).alias("total_bytes"), F.sum("copies").alias("total_rows"))
    placed = found.join(sums, ["hash_prefix", "depth"])
    over = F.col("total_bytes") > limit
    fit = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("n_bytes"), F.lit(1)))).cast("bigint")
    placed = placed.withColumn("fit", F.when(over, fit))
    few = placed.where(F.col("copies") <= RUN).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    runs = (placed.where(F.col("copies") > RUN).withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / RUN))))
            .repartition("hash", "run"))
    many = runs.withColumn("copy", F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("copies"), (F.col("run") + 1) * RUN) - 1))).drop("run")
    every = few.unionByName(many).withColumn("page", F.coalesce(F.floor(F.col("copy") / F.col("fit")), F.lit(0)).cast("int"))
    name = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.conv(F.col("hash_prefix").cast("string"), 10, 2), F.col("depth"), F.lit("0")))
    held = F.least(F.col("fit"), F.col("copies") - F.col("page") * F.col("fit"))
    return every.select(
        "doc_id", "n_bytes", "hash", F.when(F.col("page") > 0, F.concat(name, F.lit("+"), F.col("page").cast("string"))).otherwise(name).alias("shard_id"),
        F.col("depth").cast("int").alias("depth"), "page",
        F.when(F.col("fit").isNotNull(), held * F.col("n_bytes")).otherwise(F.col("total_bytes")).cast("bigint").alias("shard_bytes"),
        F.when(F.col("fit").isNotNull(), held).otherwise(F.col("total_rows")).cast("bigint").alias("shard_rows"),
        (F.col("n_bytes") > limit).alias("oversized"))


def write_shards(docs: DataFrame, path: str, limit: int = MAX_BYTES) -> None:
    """Write ``doc_id, text`` with one folder per shard under ``path``; copies of a row are written as often as they occur."""
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    texts = docs.select("text", F.conv(F.substring(key, 1, HASH_BITS // 4), 16, 10).cast("bigint").alias("hash")).dropDuplicates(["hash"])
    placed = assign(docs, limit).select("doc_id", "hash", "shard_id").join(texts, "hash").drop("hash")
    placed.repartition("shard_id").write.partitionBy("shard_id").parquet(path)


ORACLE_SQL = f"""
WITH RECURSIVE h AS (
  SELECT doc_id, COALESCE(strlen(text), 0) AS n_bytes,
         CAST('0x' || substr(md5(COALESCE(CAST(doc_id AS VARCHAR), '') || ':' || md5(COALESCE(text, ''))), 1, {HASH_BITS // 4}) AS BIGINT) AS hash
  FROM documents),
s AS (
  SELECT doc_id, n_bytes, hash, 0 AS depth FROM h
  UNION ALL
  SELECT doc_id, n_bytes, hash, depth + 1 FROM (
    SELECT *, SUM(n_bytes) OVER w AS total, MIN(hash) OVER w AS low, MAX(hash) OVER w AS high
    FROM s WINDOW w AS (PARTITION BY hash >> ({HASH_BITS} - depth))) t
  WHERE total > {MAX_BYTES} AND low <> high),
f AS (
  SELECT doc_id, n_bytes, hash, depth FROM (
    SELECT *, MAX(depth) OVER (PARTITION BY hash) AS deepest FROM s) t WHERE depth = deepest)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, hash,
       CASE depth WHEN 0 THEN '' ELSE lpad(bin(hash >> ({HASH_BITS} - depth)), CAST(depth AS INTEGER), '0') END AS shard_id,
       CAST(depth AS INTEGER) AS depth, 0 AS page,
       CAST(SUM(n_bytes) OVER b AS BIGINT) AS shard_bytes, COUNT(*) OVER b AS shard_rows, n_bytes > {MAX_BYTES} AS oversized
FROM f WINDOW b AS (PARTITION BY depth, hash >> ({HASH_BITS} - depth))
"""
