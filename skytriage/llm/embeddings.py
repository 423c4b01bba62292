"""Near-duplicate vectors by PCA-ordered, tiled comparison (operator 7).

Vectors are scaled to length one, copies are merged, and all are turned to the axes of their
principal components, those of largest variance first. Sorted along the first axis they are
packed into tiles. Two tiles whose boxes over the leading axes are too far apart for any link
are not compared. In the others products over the leading axes are accumulated first: what the
rest can add is at most the product of both suffix norms, and a pair is dropped as soon as
that cannot reach the threshold. A comparison returns numbers of links per vector and a
forest of its links, never all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytriage.llm.common import add_vectors, attach, components
from skytriage.llm.simhash import _forest
from skytriage.session import durable

THRESHOLD = 0.9
TILE = 8192
#: Long vectors make tiles of fewer rows, of about so many bytes.
TILE_BYTES = 1 << 24
#: Leading axes whose ranges make the box of a tile.
BOX = 8
#: Mean square of the suffix norms at which the first products are cut.
FIRST_CUT = 0.65
ROUNDING = 1e-9


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a usable vector: id, key (digest of the unit vector), the vector scaled by a power of two."""
    for batch in batches:
        keys, scaled = [], []
        for at, v in enumerate(batch.column(1).to_pylist()):
            if v is None or any(x is None for x in v):
                keys.append(None), scaled.append(None)
                continue
            x = np.array(v, dtype=np.float64)
            top = np.abs(x).max() if len(x) else 0.0
            if not np.isfinite(top) or top == 0:
                keys.append(None), scaled.append(None)
                continue
            x = np.ldexp(x, -int(np.frexp(top)[1])) + 0.0
            keys.append(hashlib.md5((x / np.sqrt(x @ x)).tobytes()).hexdigest()), scaled.append(x.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.string()), pa.array(scaled, pa.binary())], names=["vec_id", "key", "vector"])


def _units(rows: list[bytes] | bytes, d: int) -> np.ndarray:
    x = np.frombuffer(rows if isinstance(rows, bytes) else b"".join(rows), dtype=np.float64).reshape(-1, d)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        by: dict[int, list] = {}
        for u in batch.column(0).to_pylist():
            by.setdefault(len(u) // 8, []).append(u)
        for d, rows in by.items():
            x = _units(rows, d)
            part = np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
            sums[d] = sums[d] + part if d in sums else part
    task = TaskContext.get().partitionId()
    for d, s in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([str(d)]), pa.array([task], pa.int32()), pa.array([s.tobytes()], pa.binary())], names=["name", "task", "vector"])


def axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Per dimension of vectors, the principal axes of all of them (columns), largest variance first."""
    out = {}
    for r in add_vectors(vectors.select("vector").mapInArrow(_moments, "name string, task int, vector binary")).collect():
        d, s = int(r["name"]), np.frombuffer(r["vector"], dtype=np.float64)
        mean = s[1: d + 1] / s[0]
        out[d] = np.linalg.eigh(s[d + 1:].reshape(d, d) / s[0] - np.outer(mean, mean))[1][:, ::-1].copy()
    return out


def _packer(turn: dict[int, np.ndarray]):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        task, made = TaskContext.get().partitionId(), 0

        def tile(d: int) -> pa.RecordBatch:
            nonlocal made
            rows = held.pop(d)
            y = _units([r[2] for r in rows], d) @ turn[d]
            box = np.zeros((2, BOX))
            box[0, : min(d, BOX)], box[1, : min(d, BOX)] = y[:, :BOX].min(axis=0), y[:, :BOX].max(axis=0)
            made += 1
            return pa.RecordBatch.from_arrays([
                pa.array([task << 32 | made], pa.int64()), pa.array([d], pa.int32()), pa.array([box[0].tolist()], pa.list_(pa.float64())), pa.array([box[1].tolist()], pa.list_(pa.float64())),
                pa.array([np.array([r[0] for r in rows], np.int64).tobytes()], pa.binary()), pa.array([np.array([r[1] for r in rows], np.int64).tobytes()], pa.binary()), pa.array([b"".join(r[2] for r in rows)], pa.binary())],
                names=["tile", "dim", "low", "high", "reps", "copies", "matrix"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(3))):
                d = len(row[2]) // 8
                held.setdefault(d, []).append(row)
                if len(held[d]) >= min(TILE, max(64, TILE_BYTES // (8 * d))):
                    yield tile(d)
        for d in list(held):
            yield tile(d)

    return pack


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with that of ``b``: sums in extended precision, rounded to double at the end."""
    a, b = a.astype(np.longdouble), b.astype(np.longdouble)
    return ((a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))).astype(np.float64)


def linked(a: np.ndarray, b: np.ndarray, threshold: float, originals: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of ``a`` and ``b`` (unit vectors on the same ordered axes) with a product of at least ``threshold``.

    Where ``originals`` are given, what turning the axes may have moved across the threshold is decided on them.
    """
    d = a.shape[1]
    rest = [np.sqrt(np.maximum(0, np.cumsum(m[:, ::-1] ** 2, axis=1)[:, ::-1])) for m in (a, b)]
    rest = [np.concatenate([r, np.zeros((len(r), 1))], axis=1) for r in rest]
    energy = (rest[0] ** 2).mean(axis=0)
    first = int(np.argmax(energy <= FIRST_CUT)) or d
    cuts = sorted({min(d, first), min(d, first + (d - first) // 3), d})
    for at in range(0, len(a), 512):
        for to in range(0, len(b), 4096):
            x, y = a[at: at + 512], b[to: to + 4096]
            p = x[:, : cuts[0]] @ y[:, : cuts[0]].T
            i, j = np.nonzero(p + np.outer(rest[0][at: at + 512, cuts[0]], rest[1][to: to + 4096, cuts[0]]) >= threshold - ROUNDING)
            got, done = p[i, j], cuts[0]
            for cut in cuts[1:]:
                step = np.empty(len(i))
                for k in range(0, len(i), 1 << 16):
                    step[k: k + (1 << 16)] = np.einsum("ij,ij->i", x[i[k: k + (1 << 16)], done:cut], y[j[k: k + (1 << 16)], done:cut])
                got, done = got + step, cut
                keep = got + rest[0][at + i, cut] * rest[1][to + j, cut] >= threshold - ROUNDING
                i, j, got = i[keep], j[keep], got[keep]
            keep = got >= threshold
            if originals is not None:
                close = np.flatnonzero(np.abs(got - threshold) <= ROUNDING)
                for k in range(0, len(close), 4096):
                    at_once = close[k: k + 4096]
                    keep[at_once] = cosines(originals[0][at + i[at_once]], originals[1][to + j[at_once]]) >= threshold
            yield at + i[keep], to + j[keep]


def _comparer(threshold: float, turn: dict[int, np.ndarray]):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                same = batch.column(0)[k].as_py() == batch.column(1)[k].as_py()
                d = batch.column(2)[k].as_py()
                reps, copies, matrix = zip(*(tuple(np.frombuffer(batch.column(c + side)[k].as_buffer(), dtype=t) for c, t in ((3, np.int64), (5, np.int64), (7, np.float64))) for side in (0, 1)))
                rows = tuple(m.reshape(-1, d) for m in matrix)
                a, b = (_units(m.tobytes(), d) @ turn[d] for m in rows)
                n = [np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)]
                ends: list[np.ndarray] = []
                for i, j in linked(a, b, threshold, rows):
                    if same:
                        i, j = i[i < j], j[i < j]
                    np.add.at(n[0], i, copies[1][j])
                    np.add.at(n[1], j, copies[0][i])
                    ends.append(np.stack(_forest(reps[0][i], reps[1][j])))
                edges = np.concatenate(ends, axis=1) if ends else np.zeros((2, 0), np.int64)
                edges = _forest(edges[0], edges[1])
                rep, count = np.concatenate(reps), np.concatenate(n)
                rep, count = rep[count > 0], count[count > 0]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([edges[0], rep])), pa.array(edges[1].tolist() + [None] * len(rep), pa.int64()), pa.array([0] * len(edges[0]) + count.tolist(), pa.int64())], names=["a", "b", "n"])

    return compare


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row of ``vectors``: ``vec_id, n_links, component_id, kept``.

    Links join rows whose cosine, in double precision, is at least ``threshold`` (above 0); products that
    come within ``ROUNDING`` of it are decided on the vectors as they were given.
    ``n_links`` counts the other rows linked directly, copies included; ``component_id`` is the smallest
    id reachable and ``kept`` says whether that is the row's own. Vectors that are null, empty
    or zero or hold a null or non-finite component, and vectors of different length, are not
    linked. Rows that repeat an id stay rows; with a null id and no other in reach
    ``component_id`` is null and ``kept`` false. Other columns are not read.
    """
    picked = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    kind = dict(picked.dtypes)["vec_id"]
    rows = durable(picked.mapInArrow(_clean, f"vec_id {kind}, key string, vector binary"))
    usable = rows.where(F.col("key").isNotNull())
    reps = durable(usable.groupBy("key").agg(F.first("vector").alias("vector"), F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
                   .withColumn("rep", F.monotonically_increasing_id()))
    turn = axes(reps)
    total = reps.count()

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = {d: m[:, 0] for d, m in turn.items()}
        for batch in batches:
            u = batch.column(2).to_pylist()
            y = [float(_units(x, len(x) // 8)[0] @ lead[len(x) // 8]) for x in u]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(y, pa.float64())], names=["rep", "copies", "vector", "y"])

    tiles = max(1, -(-total // TILE))
    placed = reps.select("rep", "copies", "vector").mapInArrow(leading, "rep bigint, copies bigint, vector binary, y double")
    packed = durable(placed.repartitionByRange(tiles, "y").coalesce(tiles).select("rep", "copies", "vector")
                     .mapInArrow(_packer(turn), "tile bigint, dim int, low array<double>, high array<double>, reps binary, copies binary, matrix binary"))
    # Two unit vectors with that cosine are at most this far apart, along every axis too.
    far = float(np.sqrt(max(0.0, 2 - 2 * threshold)) + ROUNDING)
    boxes = packed.select("tile", "dim", "low", "high")
    a = boxes.select(F.col("tile").alias("left"), "dim", "low", "high", F.explode(F.sequence(F.floor(F.col("low")[0] / far), F.floor(F.col("high")[0] / far))).alias("bin"))
    b = boxes.select(F.col("tile").alias("right"), "dim", F.col("low").alias("low2"), F.col("high").alias("high2"),
                     F.explode(F.sequence(F.floor(F.col("low")[0] / far) - 1, F.floor(F.col("high")[0] / far) + 1)).alias("bin"))
    gap = F.aggregate(F.zip_with(F.zip_with("low", "high2", lambda x, y: x - y), F.zip_with("low2", "high", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0))),
                      F.lit(0.0), lambda s, x: s + x * x)
    pairs = a.join(b, ["dim", "bin"]).where((F.col("left") <= F.col("right")) & (gap <= far * far)).select("left", "right").distinct()
    one = packed.select(F.col("tile").alias("left"), "dim", F.col("reps").alias("reps1"), F.col("copies").alias("copies1"), F.col("matrix").alias("matrix1"))
    two = packed.select(F.col("tile").alias("right"), F.col("reps").alias("reps2"), F.col("copies").alias("copies2"), F.col("matrix").alias("matrix2"))
    met = (pairs.join(one, "left").join(two, "right").select("left", "right", "dim", "reps1", "reps2", "copies1", "copies2", "matrix1", "matrix2"))
    found = durable(met.mapInArrow(_comparer(threshold, turn), "a bigint, b bigint, n bigint"))
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    labels = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    named = (reps.select("rep", "key", "first_id", "copies").join(labels, "rep", "left").join(counts, "rep", "left")
             .withColumn("component", F.coalesce("component", "rep")))
    lowest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    mapping = durable(named.join(lowest, "component").select("key", "component_id", "copies", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    good = attach(usable.select("vec_id", "key"), mapping, "key", "copies").select("vec_id", "n_links", "component_id")
    bad = rows.where(F.col("key").isNull()).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(bad).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
