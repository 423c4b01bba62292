"""First active interval at every moment, by one sweep over the intervals and one as-of lookup.

The ends of all intervals are cut into blocks of their order by (key, time). An interval
goes to the block it starts in, to the block it ends in, and to the blocks between as one
minimum per block: what covers a block whole matters only if no other such interval comes
before it. So a block needs its own intervals and at most one more, whatever is active
around it, and is swept alone, with the active intervals in a heap that forgets the ended
ones when they come up. The sweep leaves disjoint pieces, each with its first interval, and
a moment looks up the last piece that begins before it.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from skytriage.operators.scan import prefix_scan, with_blocks
from skytriage.session import durable

_FAR = (1 << 63) - 1


def _places(bounds: list[tuple]):
    """Rows ``block, until, key, begin, end, row``: the interval in its first and in its last block; a third row, with the
    last of the blocks between in ``until``, stands for all of these."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, begins, ends = (batch.column(k).to_pylist() for k in range(3))
            block, until, begin, end, take = [], [], [], [], []
            for i, (key, s, e) in enumerate(zip(keys, begins, ends)):
                first, last = (bisect_right(bounds, (key, t)) - 1 for t in (s, e))
                found = [(first, None, s, e)]
                if last > first:
                    found.append((last, None, bounds[last][1], e))
                if last > first + 1:
                    found.append((first + 1, last - 1, 0, 0))
                for a, b, x, y in found:
                    block.append(a)
                    until.append(b)
                    begin.append(x)
                    end.append(y)
                    take.append(i)
            rows = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(until, pa.int32()), batch.column(0).take(rows), pa.array(begin, pa.int64()),
                                              pa.array(end, pa.int64()), batch.column(3).take(rows)], names=["block", "until", "key", "begin", "end", "row"])

    return place


def _pieces_of(intervals: Iterator[tuple], limit: int) -> Iterator[tuple[int, dict | None]]:
    """(time, first active row or None) where that changes, from one key's (begin, end, row) by begin; nothing at or after ``limit``.

    ``row`` has the order as its first field; a null order comes first.
    """
    heap: list[tuple] = []
    pending: tuple[int, dict | None] | None = None
    shown: object = ()  # like no row: the first piece is named even if it is empty, since one of the block before may end here

    def put(t: int, row: dict | None) -> Iterator[tuple[int, dict | None]]:
        nonlocal pending, shown
        if pending is not None and pending[0] < t:
            if pending[1] != shown:
                shown = pending[1]
                yield pending
        pending = (t, row)

    def expire(now: int) -> Iterator[tuple[int, dict | None]]:
        while heap and heap[0][2] <= now:
            t = heap[0][2]
            while heap and heap[0][2] <= t:
                heapq.heappop(heap)
            if t >= limit:
                return
            yield from put(t, heap[0][3] if heap else None)

    for serial, (begin, end, row) in enumerate(intervals):
        yield from expire(begin)
        order = next(iter(row.values()))
        heapq.heappush(heap, ((order is not None, order), serial, end, row))
        yield from put(begin, heap[0][3])
    yield from expire(_FAR)
    yield from put(_FAR, None)


def _sweep(bounds: list[tuple]):
    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            block, key = held[0][0], held[0][1]
            after = bounds[block + 1] if block + 1 < len(bounds) else None
            limit = after[1] if after and after[0] == key else _FAR
            found = list(_pieces_of(((b, e, r) for _, _, b, e, r in held), limit))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([key] * len(found), kinds[0]), pa.array([t for t, _ in found], pa.int64()), pa.array([r for _, r in found], kinds[1])],
                                              names=["key", "begin", "row"])

        for batch in batches:
            kinds = (batch.column(1).type, batch.column(4).type)
            for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if held and (held[0][0], held[0][1]) != (row[0], row[1]):
                    yield out()
                held.append(row)
        if held:
            yield out()

    return sweep


def disjoint_pieces(intervals: DataFrame, key: str, order: str, payload: list[str], blocks: int | None = None) -> DataFrame:
    """``key, begin, row``: from ``begin`` (microseconds) on, ``row`` is the first interval of ``key``, or null for none.

    ``intervals`` has ``key, starts_at, ends_at`` (both included); those without a key or an
    end, or that end before they start, cover nothing. A piece is named again where a block
    begins. Orders should differ within a key; of equal ones any counts. ``row`` has ``_order`` and the payload.
    """
    row = F.struct(F.col(order).alias("_order"), *payload)
    begin, end = (F.unix_micros(F.col(c).cast("timestamp")) for c in ("starts_at", "ends_at"))
    spans = intervals.where(F.col(key).isNotNull() & (F.col("ends_at") >= F.col("starts_at"))).select(F.col(key).alias("key"), begin.alias("begin"), (end + 1).alias("end"), row.alias("row"))
    spark = intervals.sparkSession
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ends = spans.select("key", F.explode(F.array("begin", "end")).alias("t"))
    # One row per block: as many as there are shuffle partitions, whatever the table.
    firsts = ends.repartitionByRange(blocks, "key", "t").groupBy(F.spark_partition_id()).agg(F.min(F.struct("key", "t")).alias("x")).collect()
    bounds = sorted(tuple(r["x"]) for r in firsts)
    fields = {f.name: f for f in spans.schema.fields}
    own = [StructField("key", fields["key"].dataType), StructField("begin", LongType()), StructField("end", LongType()), StructField("row", fields["row"].dataType)]
    placed = durable(spans.mapInArrow(_places(bounds), StructType([StructField("block", IntegerType()), StructField("until", IntegerType()), *own])))
    inner = placed.where("until IS NULL").select("block", "key", "begin", "end", "row")
    # Blocks between the first and the last: two overlapping ranges of a power of two blocks, so blocks x log(blocks) minima at most.
    over = placed.where("until IS NOT NULL")
    level = F.floor(F.log2(F.col("until") - F.col("block") + 1)).cast("int")
    ranges = over.select("key", "row", level.alias("level"), F.explode(F.array_distinct(F.array(F.col("block"), F.col("until") + 1 - F.call_function("shiftleft", F.lit(1), level)))).alias("from"))
    least = ranges.groupBy("key", "level", "from").agg(F.min("row").alias("row"))
    limits = spark.createDataFrame([(k, *b, bounds[k + 1][1] if k + 1 < len(bounds) else _FAR) for k, b in enumerate(bounds)],
                                   StructType([StructField("block", IntegerType()), own[0], StructField("begin", LongType()), StructField("end", LongType())]))
    whole = least.select("key", "row", F.explode(F.sequence("from", F.col("from") + F.call_function("shiftleft", F.lit(1), F.col("level")) - 1)).alias("block")).groupBy("key", "block").agg(
        F.min("row").alias("row")).join(limits, ["key", "block"]).select("block", "key", "begin", "end", "row")
    dealt = inner.unionByName(whole).repartitionById(max(len(bounds), 1), F.col("block")).sortWithinPartitions("key", "begin")
    return dealt.mapInArrow(_sweep(bounds), StructType([own[0], own[1], own[3]])).withColumnRenamed("key", key)


def first_covering(points: DataFrame, intervals: DataFrame, key: str, at: str, order: str, payload: list[str], blocks: int | None = None) -> DataFrame:
    """``points`` with the payload of the first interval, by ``order``, that covers (key, at); nulls where none does.

    Every row of ``points`` comes back once. Rows and pieces meet in one sort by (key, time)
    in blocks, so neither a key nor a moment has to fit a task.
    """
    pieces = disjoint_pieces(intervals, key, order, payload, blocks)
    row = F.struct(*(F.col(f"`{c}`") for c in points.columns))
    asked = points.select(F.col(key).alias("_k"), F.unix_micros(F.col(at).cast("timestamp")).alias("_t"), F.lit(1).alias("_side"), F.xxhash64(row).alias("_tie"), row.alias("_point"))
    known = pieces.select(F.col(key).alias("_k"), F.col("begin").alias("_t"), F.lit(0).alias("_side"), F.lit(0).cast("bigint").alias("_tie"),
                          F.struct("begin", "row").alias("_piece"))
    sort = [F.col(c) for c in ("_t", "_side", "_tie")]
    both = with_blocks(asked.unionByName(known, allowMissingColumns=True), [F.col("_k"), *sort])
    found = prefix_scan(both, ["_k"], sort, maxes={"_last": F.col("_piece")}).where("_side = 1")
    return found.select("_point.*", *(F.when(F.col("_t").isNotNull(), F.col(f"_last.row.{p}")).alias(p) for p in payload))
