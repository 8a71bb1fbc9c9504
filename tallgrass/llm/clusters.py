"""Centroid clustering (Lloyd's rounds) with heap-ordered bounds, exact in integers.

For a vector, let u be the distance to its centroid and l that to the nearest other one. While l - u is more than its
centroid's drift since then, plus the largest drift of the others, its centroid stays the only nearest one. Every
cluster keeps a heap of these gaps, offset by the drift accumulated when they were pushed, so that nothing is updated
when centroids move: a round pops the entries whose gap the accumulated drift has reached, scans those vectors again
exactly and pushes them anew. All others are left alone.

Vectors are dealt in blocks of BLOCK rows; a block has its own heaps, one per cluster. Blocks lie in a table bucketed by
block that is written once, and heaps in a small one per round that is bucketed alike, so that rounds join them without a
shuffle. A round gives the sums of those vectors that changed their cluster, reduced in every task; the driver holds
centroids only (k times the dimensions). Tables lie in the shared folder, so that a lost executor repeats its tasks.

Bounds are floats with a margin far above their rounding; distances and sums are integers. An entry that is popped
without need costs a scan and changes nothing.

Defined cases: vectors of another number of components, or with a null, NaN or infinite one, are dropped; components
beyond 2^27 in size count as 2^27, since their distances would not fit a long; repeated rows are vectors of their own;
equal distances go to the smaller number; an inertia that is no long is null; fewer vectors than k make fewer centroids; an empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.shared import folder
from .common import saved, sliced

#: Vectors of a block; and blocks of a bucket, of which there are some at least for parallel work and as many as Spark allows.
BLOCK, IN_BUCKET = 4096, 64
LEAST_BUCKETS, MOST_BUCKETS = 24, 100_000
#: Largest component; and the size below which matrix products of floats are exact.
LARGEST, EXACT = 2**27, 2**20
#: Margin of bounds relative to their terms; roundings are a millionth of it.
MARGIN = 1e-9


def kept(vectors: DataFrame, dims: int, vec: str) -> Column:
    """Whether a vector has exactly dims components, none of them null or not finite."""
    plain = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vec) == dims) & plain, F.lit(False))


def integers(vec: str, scale: int) -> Column:
    """floor(scale * x) of every component."""
    bound = F.lit(float(LARGEST))
    return F.transform(vec, lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, -bound), bound)).cast("long"))


def bucketed(df: DataFrame, n: int, kind: str) -> tuple[DataFrame, str]:
    """Cuts the lineage with a table in the shared folder that is bucketed by column block; the table and its name."""
    name = f"tallgrass_{kind}_{uuid.uuid4().hex}"
    df.write.bucketBy(n, "block").option("path", folder(df.sparkSession, name)).saveAsTable(name)
    return df.sparkSession.table(name), name


def blocks(points: DataFrame) -> DataFrame:
    """(block, ids, x): rows (id, x) in blocks, numbered by the task that reads them; x in the least exact integer type."""
    kind = to_arrow_type(points.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, parts, n = TaskContext.get().partitionId() << 32, [], [], 0

        def built() -> pa.RecordBatch:
            x = np.concatenate(parts)
            size = int(np.abs(x).max(initial=0))
            x = x.astype(np.int16 if size < 2**15 else np.int32)
            listed = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.concat_arrays(ids).cast(kind))
            return pa.RecordBatch.from_arrays([pa.array([number]), listed, pa.array([x.tobytes()])], names=["block", "ids", "x"])

        for b in sliced(batches, BLOCK):
            ids.append(b.column(0))
            parts.append(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
            n += b.num_rows
            if n >= BLOCK:
                yield built()
                number, ids, parts, n = number + 1, [], [], 0
        if n:
            yield built()

    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(points.schema["id"].dataType)), T.StructField("x", T.BinaryType())])
    return points.select("id", "x").mapInArrow(run, schema)


def matrix(x: bytes, n: int, dims: int) -> np.ndarray:
    """The n vectors of a block."""
    return np.frombuffer(x, np.int16 if len(x) == 2 * n * dims else np.int32).reshape(n, dims)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of every vector to every centroid."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((x.astype(np.int64) - c) ** 2).sum(1) for c in centroids], axis=1)


class Block:
    """Assignments of a block's vectors, and a heap of gaps per cluster."""

    def __init__(self, x: np.ndarray, k: int, state: bytes | None = None):
        self.x = x
        if state is None:
            self.of, self.heaps = np.full(len(x), -1, np.int32), [[] for _ in range(k)]
            return
        n = len(x)
        sizes, self.of = np.frombuffer(state, np.int32, k), np.frombuffer(state, np.int32, n, 4 * k).copy()
        rows = np.frombuffer(state, np.int32, n, 4 * (k + n)).tolist()
        keys, at, self.heaps = np.frombuffer(state, np.float64, n, 4 * (k + 2 * n)).tolist(), 0, []
        for size in sizes.tolist():
            self.heaps.append([*zip(keys[at : at + size], rows[at : at + size], strict=True)])
            at += size

    def state(self) -> bytes:
        """Heaps as they lie, which are heaps again when read."""
        entries = [e for heap in self.heaps for e in heap]
        keys, rows = np.array([e[0] for e in entries], np.float64), np.array([e[1] for e in entries], np.int32)
        return np.array([*map(len, self.heaps)], np.int32).tobytes() + self.of.tobytes() + rows.tobytes() + keys.tobytes()

    def expired(self, drift: np.ndarray) -> np.ndarray:
        """Pops the vectors whose gap is reached; all of them in the first round."""
        if len(self.of) and self.of[0] < 0:
            return np.arange(len(self.of))
        out = []
        for heap, reached in zip(self.heaps, drift.tolist(), strict=True):
            while heap and heap[0][0] <= reached:
                out.append(heappop(heap)[1])
        return np.array(out, np.int64)

    def round(self, centroids: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Assigns expired vectors anew: (change of sums per cluster, change of counts, vectors scanned)."""
        k, dims = centroids.shape
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        rows = self.expired(drift)
        if not len(rows):
            return sums, counts, 0
        d = distances(self.x[rows], centroids)
        first = d.argmin(1)  # of equal ones the smallest number
        u = np.sqrt(d[np.arange(len(rows)), first].astype(np.float64))
        if k > 1:
            d[np.arange(len(rows)), first] = np.iinfo(np.int64).max
            low = np.sqrt(d.min(1).astype(np.float64))
        else:
            low = np.full(len(rows), math.inf)
        at = drift[first]
        keys = low - u + at - MARGIN * (np.where(np.isinf(low), 0, low) + u + at + 1)
        before = self.of[rows]
        moved = before != first
        np.add.at(sums, first[moved], self.x[rows[moved]].astype(np.int64))
        np.add.at(counts, first[moved], 1)
        gone = moved & (before >= 0)
        np.subtract.at(sums, before[gone], self.x[rows[gone]].astype(np.int64))
        np.subtract.at(counts, before[gone], 1)
        self.of[rows] = first
        if len(rows) == len(self.of):
            for c in range(k):
                mine = first == c
                self.heaps[c] = [*zip(keys[mine].tolist(), rows[mine].tolist(), strict=True)]
                heapify(self.heaps[c])
        else:
            for key, row, c in zip(keys.tolist(), rows.tolist(), first.tolist(), strict=True):
                heappush(self.heaps[c], (key, row))
        return sums, counts, len(rows)


def starts(points: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes, in their order."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    rows = points.select(F.sha2(name, 256).alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([row.x for row in rows], np.int64)


def stepped(rows: DataFrame, centroids: np.ndarray, drift: np.ndarray) -> DataFrame:
    """(block, state, sums, counts, scanned) of one round over rows (block, ids, x[, state])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "state", "sums", "counts", "scanned"]
        for b in sliced(batches, 1):
            row = b.to_pydict()
            block = Block(matrix(row["x"][0], len(row["ids"][0]), centroids.shape[1]), len(centroids), row.get("state", [None])[0])
            sums, counts, scanned = block.round(centroids, drift)
            yield pa.RecordBatch.from_pydict(dict(zip(names, ([row["block"][0]], [block.state()], [sums.tobytes()], [counts.tobytes()], [scanned]), strict=True)))

    return rows.mapInArrow(run, "block long, state binary, sums binary, counts binary, scanned long")


def changes(state: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Change of the sums and counts of all clusters, and vectors scanned: k rows of each task are added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, scanned = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), 0
        for b in sliced(batches, 16):
            for s, c, n in zip(*(b.column(i) for i in range(3)), strict=True):
                sums += np.frombuffer(s.as_py(), np.int64).reshape(k, dims)
                counts += np.frombuffer(c.as_py(), np.int64)
                scanned += n.as_py()
        scans = [scanned] + [0] * (k - 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(sums.tolist(), pa.list_(pa.int64())), pa.array(counts), pa.array(scans, pa.int64())], names=["cluster", "sums", "n", "scanned"])

    parts = state.select("sums", "counts", "scanned").mapInArrow(run, "cluster int, sums array<long>, n long, scanned long")
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("scanned").alias("scanned"), *(F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(dims))).collect()
    sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
    for row in rows:
        counts[row.cluster] = row.n
        sums[row.cluster] = [row[f"s{i}"] for i in range(dims)]
    return sums, counts, sum(row.scanned for row in rows)


def assigned(rows: DataFrame, centroids: np.ndarray, drift: np.ndarray, kind: T.DataType) -> DataFrame:
    """(id, cluster, distance) after the last round."""
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            row = b.to_pydict()
            ids = b.column(b.schema.names.index("ids")).flatten().cast(arrow)
            block = Block(matrix(row["x"][0], len(ids), centroids.shape[1]), len(centroids), row.get("state", [None])[0])
            block.round(centroids, drift)
            distance = ((block.x.astype(np.int64) - centroids[block.of]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(block.of), pa.array(distance)], names=["id", "cluster", "distance"])

    return rows.mapInArrow(run, T.StructType([T.StructField("id", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]))


def clustered(
    vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2, vec_id: str = "vec_id", vec: str = "embedding", scans: list[int] | None = None
) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of every kept vector. See the module.

    Each of `rounds` rounds assigns every vector and then moves the centroids to the floors of their vectors' means;
    then vectors are assigned once more. `scans` receives the number of vectors that each of these scans.
    """
    spark = vectors.sparkSession
    points = vectors.where(kept(vectors, dims, vec)).select(F.col(vec_id).alias("id"), integers(vec, scale).alias("x"))
    kind = points.schema["id"].dataType
    centroids = starts(points, k, seed)
    k = len(centroids)
    if not k:
        none = [T.StructField(vec_id, kind), T.StructField("cluster", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("distance", "cluster_inertia", "inertia")), T.StructField("centroid_sha256", T.StringType())]
        return spark.createDataFrame([], T.StructType(none))
    n_blocks = -(-points.count() // BLOCK)
    buckets = min(max(-(-n_blocks // IN_BUCKET), min(n_blocks, LEAST_BUCKETS)), MOST_BUCKETS)
    fixed, name = bucketed(blocks(points).repartition(buckets, "block"), buckets, "blocks")
    rows, names = fixed, [name]
    drift, sums, counts = np.zeros(k), np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
    for _ in range(rounds):
        state, name = bucketed(stepped(rows, centroids, drift), buckets, "bounds")
        names.append(name)
        more, n, scanned = changes(state, k, dims)
        sums, counts = sums + more, counts + n
        if scans is not None:
            scans.append(scanned)
        now = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)
        way = np.sqrt(((now - centroids).astype(np.float64) ** 2).sum(1))
        others = np.array([np.delete(way, c).max(initial=0) for c in range(k)])
        drift, centroids = drift + way + others, now
        rows = fixed.join(state.select("block", "state"), "block")
    found = saved(assigned(rows, centroids, drift, kind), "clusters")
    for name in names:
        spark.sql(f"DROP TABLE {name}")
    inertia = dict(found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    total = sum(map(int, inertia.values()))
    fits = lambda n: n if n < 2**63 else None
    of_cluster = spark.createDataFrame([(c, fits(int(i)), fits(total), digests[c]) for c, i in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.withColumnRenamed("id", vec_id).join(F.broadcast(of_cluster), "cluster").select(vec_id, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
