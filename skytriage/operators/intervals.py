"""Band counts without pairing every row with every band.

A range of whole numbers is cut into a few aligned blocks (powers of a base). A block is an
equi-join key, and whatever is asked of it (its first ten rows) is aggregated per block
before the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skytriage.operators.scan import prefix_scan, with_blocks
from skytriage.session import durable


def block_key(block: Column, level: int) -> Column:
    """One number per (level, block), cheaper to hash and sort than a pair."""
    return block * 64 + level


def aligned_blocks(low: Column, high: Column, bits: int, levels: int) -> Column:
    """Keys of the aligned blocks that exactly cover the whole numbers [low, high).

    A block of level j holds 2^(bits*j) numbers starting at a multiple of that. ``low``
    and ``high`` should be plain columns: they are referred to many times.
    """
    base = 1 << bits

    def ends(j: int) -> tuple[Column, Column]:
        if j == 0:
            return low, high
        unit = float(base**j)
        return F.ceil(low / unit).cast("long"), F.floor(high / unit).cast("long")

    none = F.array().cast("array<bigint>")

    def numbers(a: Column, b: Column) -> Column:
        return F.when(a < b, F.sequence(a, b - 1)).otherwise(none)

    def tagged(j: int):
        return lambda x: block_key(x, j)

    parts = []
    for j in range(levels):
        a, b = ends(j)
        if j == levels - 1:
            blocks = numbers(a, b)
        else:
            up_a, up_b = ends(j + 1)
            blocks = F.when(up_a < up_b, F.concat(numbers(a, up_a * base), numbers(up_b * base, b))).otherwise(numbers(a, b))
        parts.append(F.transform(blocks, tagged(j)))
    return F.concat(*parts)


_BAND_BITS, _BAND_LEVELS = 2, 20


def band_matches(asked: DataFrame, rows: DataFrame, key: str, value: str, tolerance: float, order: str,
                 payload: list[str], first: int = 10) -> DataFrame:
    """``asked`` with ``match_count``, how many ``rows`` of the key have a value within
    ``tolerance``, and ``matches``, the first few of them by ``order``.

    Counts are differences of positions in one sort, so they cost nothing per match. The
    first few come from aligned blocks of positions, each reduced to its own first few. They
    are looked up once per pair of positions, of which there are about two per stored row
    however many sizes are asked for, by position alone; what is shown of a row is added last.
    """
    probe = asked.select(key, F.col(value).alias("_p")).distinct()
    sides = F.array(
        F.struct((F.col("_p") - tolerance).alias("_v"), F.lit(0).alias("_side")),
        F.struct((F.col("_p") + tolerance).alias("_v"), F.lit(2).alias("_side")))
    stored = rows.select(key, F.col(value).alias("_v"), F.lit(1).alias("_side"), F.lit(None).cast("double").alias("_p"),
                         F.col(order).alias("_order"), F.struct(*payload).alias("_row"))
    both = stored.unionByName(probe.select(key, "_p", F.inline(sides)), allowMissingColumns=True)
    order_by = [F.col("_v"), F.col("_side"), F.col("_p"), F.col("_order")]
    blocked = with_blocks(both, [F.col(key), *order_by])
    placed = prefix_scan(blocked, [key], order_by, sums={"_before": (F.col("_side") == 1).cast("long")})
    # Positions are read by three plans and a tie may be broken otherwise in each: written once.
    placed = durable(placed.select(key, "_side", "_p", "_order", "_row", "_before"))
    ends = placed.where("_side <> 1").groupBy(key, "_p").agg(
        F.max(F.when(F.col("_side") == 0, F.col("_before"))).alias("_l"),
        F.max(F.when(F.col("_side") == 2, F.col("_before"))).alias("_r"))
    at = placed.where("_side = 1").withColumn("_pos", F.col("_before") - 1)
    levels = F.array(*[block_key(F.shiftright("_pos", _BAND_BITS * j), j) for j in range(_BAND_LEVELS)])
    w = Window.partitionBy(key, "_b").orderBy("_order", "_pos")
    # The ranking filter cuts every block to its first few rows before the shuffle.
    heads = at.select(key, "_order", "_pos", F.explode_outer(levels).alias("_b")).withColumn(
        "_n", F.row_number().over(w)).where(F.col("_n") <= first).groupBy(key, "_b").agg(
        F.collect_list(F.struct("_order", "_pos")).alias("_h"))
    bands = ends.where("_l < _r").select(key, "_l", "_r").distinct()
    wanted = bands.select(key, "_l", "_r", F.explode_outer(aligned_blocks(F.col("_l"), F.col("_r"), _BAND_BITS, _BAND_LEVELS)).alias("_b"))
    firsts = wanted.join(heads, [key, "_b"]).groupBy(key, "_l", "_r").agg(
        F.slice(F.sort_array(F.flatten(F.collect_list("_h"))), 1, first).alias("_m"))
    lists = firsts.select(key, "_l", "_r", F.explode_outer(F.col("_m._pos")).alias("_pos")).join(at.select(key, "_pos", "_order", "_row"), [key, "_pos"]).groupBy(key, "_l", "_r").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_order", "_pos", "_row"))), lambda m: m["_row"]).alias("matches"))
    ends = ends.select(F.col(key).alias("_key"), "_p", "_l", "_r")
    out = asked.join(ends, (asked[key] == F.col("_key")) & (asked[value] == F.col("_p")), "left").drop("_key", "_p")
    # The lists go to the rows that asked last, so they are moved once.
    lists = lists.withColumnsRenamed({key: "_key", "_l": "_from", "_r": "_to"})
    return out.join(lists, (out[key] == F.col("_key")) & (out["_l"] == F.col("_from")) & (out["_r"] == F.col("_to")), "left").withColumns({
        "match_count": F.coalesce(F.col("_r") - F.col("_l"), F.lit(0)), "matches": F.coalesce("matches", F.array())}).drop("_key", "_from", "_to", "_l", "_r")
