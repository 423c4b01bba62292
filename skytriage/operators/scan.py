"""Running sums and maxima over an order, without putting a whole key in one task.

A plain window sends every row of a key to one task. Here the rows are range
partitioned by (keys, order), so a key holding a third of the table is spread over
many blocks; each block is scanned on its own and then shifted by what the earlier
(or later) blocks of the same key contribute.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skytriage.session import durable

BLOCK = "_block"


def split_by_size(df: DataFrame, keys: list[str], limit: int) -> tuple[DataFrame, DataFrame | None]:
    """(groups of at most ``limit`` rows, larger groups or None when there are none).

    One counting pass with map-side combine. There are at most rows/limit large keys;
    how the two filters are joined is left to the size checks of adaptive execution.
    """
    heavy = df.groupBy(*keys).count().where(F.col("count") > limit).select(*keys)
    if heavy.isEmpty():
        return df, None
    heavy = durable(heavy)
    return df.join(heavy, keys, "left_anti"), df.join(heavy, keys, "left_semi")


def with_blocks(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows range partitioned by ``order`` and tagged with their block number.

    ``order`` must be total. The result is written to the checkpoint folder, since
    block numbers have to stay the same however often the rows are read again.
    """
    return durable(df.repartitionByRange(*order).withColumn(BLOCK, F.spark_partition_id()))


def _carry(df: DataFrame, keys: list[str], aggs: list[Column], shifted: list[Column],
           following: bool) -> DataFrame:
    """Per (key, block), the combined totals of the key's other blocks on one side.

    Only keys that reach into another block need a row. Where the blocks were cut along
    the keys that is at most two rows per block, whatever the number of keys. Where they
    were cut along something else (the evaluation ranks once for all its cells) it is
    blocks times keys, and such keys must be few. Either way the size is bounded by the
    number of partitions, not by the data, so it is safe to broadcast.
    """
    totals = df.groupBy(*keys, BLOCK).agg(*aggs)
    side = Window.partitionBy(*keys).orderBy(F.desc(BLOCK) if following else F.asc(BLOCK))
    before = side.rowsBetween(Window.unboundedPreceding, -1)
    return (
        totals.withColumn("_seen", F.count("*").over(before))
        .select(*keys, BLOCK, "_seen", *[c.over(before).alias(n) for c, n in shifted])
        .where("_seen > 0").drop("_seen")
    )


def prefix_scan(df: DataFrame, keys: list[str], order: list[Column],
                sums: dict[str, Column] | None = None,
                maxes: dict[str, Column] | None = None) -> DataFrame:
    """Inclusive running sums and maxima per key over rows from :func:`with_blocks`."""
    sums, maxes = sums or {}, maxes or {}
    local = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = df.select("*", *[e.alias(f"_v_{n}") for n, e in (sums | maxes).items()])
    aggs = [F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums]
    aggs += [F.max(f"_v_{n}").alias(f"_t_{n}") for n in maxes]
    shifted = [(F.sum(f"_t_{n}"), f"_c_{n}") for n in sums]
    shifted += [(F.max(f"_t_{n}"), f"_c_{n}") for n in maxes]
    carry = _carry(inner, keys, aggs, shifted, following=False)
    scanned = inner
    for n in sums:
        scanned = scanned.withColumn(n, F.sum(f"_v_{n}").over(local))
    for n in maxes:
        scanned = scanned.withColumn(n, F.max(f"_v_{n}").over(local))
    joined = scanned.join(F.broadcast(carry), [*keys, BLOCK], "left")
    for n in sums:
        joined = joined.withColumn(n, F.col(n) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)))
    for n in maxes:
        joined = joined.withColumn(n, F.greatest(F.col(n), F.col(f"_c_{n}")))
    return joined.drop(*[f"_{p}_{n}" for p in "vc" for n in (sums | maxes)])


def suffix_max(df: DataFrame, keys: list[str], position: str, name: str, value: Column) -> DataFrame:
    """Inclusive maximum over this row and all later rows of the key.

    Runs backwards from the end, because a frame that ends in UNBOUNDED FOLLOWING is
    evaluated anew for every row.
    """
    local = Window.partitionBy(*keys, BLOCK).orderBy(F.desc(position)).rowsBetween(Window.unboundedPreceding, 0)
    inner = df.withColumn("_v", value)
    carry = _carry(inner, keys, [F.max("_v").alias("_t")], [(F.max("_t"), "_c")], following=True)
    return (
        inner.withColumn(name, F.max("_v").over(local))
        .join(F.broadcast(carry), [*keys, BLOCK], "left")
        .withColumn(name, F.greatest(F.col(name), F.col("_c")))
        .drop("_v", "_c")
    )


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """Zero-based position of every row within its key; keys may be of any size."""
    blocked = with_blocks(df, [*[F.col(k) for k in keys], *order])
    out = prefix_scan(blocked, keys, order, sums={name: F.lit(1).cast("long")})
    return out.withColumn(name, F.col(name) - 1).drop(BLOCK)


def order_statistic(df: DataFrame, keys: list[str], value: str, pick: dict[str, Column]) -> DataFrame:
    """Exact order statistics per key, for keys of any size.

    ``pick`` maps an output name to the zero-based rank wanted, written in terms of the
    column ``n`` (rows of the key). Equal values are counted first, so copies of one
    value cost one row.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_w"))
    blocked = with_blocks(counted, [*[F.col(k) for k in keys], F.col(value)])
    scanned = prefix_scan(blocked, keys, [F.col(value)], sums={"_upto": F.col("_w")})
    totals = blocked.groupBy(*keys).agg(F.sum("_w").alias("n"))
    joined = scanned.join(totals, keys)
    hits = [
        F.max(F.when((rank >= F.col("_upto") - F.col("_w")) & (rank < F.col("_upto")), F.col(value))).alias(name)
        for name, rank in pick.items()
    ]
    return joined.groupBy(*keys).agg(F.first("n").alias("n"), *hits)


def medians(df: DataFrame, keys: list[str], value: str, name: str, limit: int = 1_000_000) -> DataFrame:
    """Exact interpolated median per key. Keys above ``limit`` rows use the block scan."""
    small, large = split_by_size(df, keys, limit)
    out = small.groupBy(*keys).agg(F.expr(f"percentile({value}, 0.5D)").alias(name))
    if large is None:
        return out
    n = F.col("n")
    picked = order_statistic(large, keys, value, {
        "_lo": F.floor((n - 1) / 2), "_hi": F.floor(n / 2)})
    return out.unionByName(picked.select(*keys, ((F.col("_lo") + F.col("_hi")) / 2).alias(name)))
