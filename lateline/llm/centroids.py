"""Exact k-means over blocks of a space-filling curve with zone maps.

Vectors become integers, get a key on a Hilbert curve through the cells of a grid over all
dimensions, and are dealt by ranges of that key, so that a block of ``BLOCK`` consecutive vectors
is a small region. A block stores its vectors as one binary matrix and its zone map: the smallest
and largest value per dimension. For a block and the centroids of a round the box gives a least
and a greatest possible distance to each centroid; a centroid whose least distance exceeds the
smallest greatest one is nearest to no vector of the block. Only the candidates that remain are
compared, all vectors of the block at once, in exact integer arithmetic.

Vectors, sums and distances stay on the executors. A round brings one row per centroid and
dimension to the driver; the centroids themselves (k x dimensions integers) go to every task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lateline.session import materialize

BLOCK = 256
#: Bits of a grid cell per dimension, and the width of the grid in standard deviations.
CELL_BITS, SPREAD = 3, 2.0
#: The largest integer of a component: 64 squared differences of such ones still fit a long.
LARGEST = 189_812_531
#: The largest long.
MOST = 2**63 - 1

BLOCKS = "width int, ids array<{id}>, lo binary, hi binary, vectors binary"


def integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, held within ``LARGEST``."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(vectors * scale), -LARGEST, LARGEST).astype(np.int64)


def kept_vectors(table: DataFrame, dims: int) -> DataFrame:
    """vec_id and embedding (array of doubles) of the rows with ``dims`` finite components."""
    v = F.col("embedding").cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return table.select("vec_id", v.alias("embedding")).filter(
        (F.size("embedding") == dims) & F.forall("embedding", finite))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def moments(vectors: DataFrame, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation per dimension, from one partial row per task and dimension.

    They place the grid of the curve and so decide on speed alone.
    """
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares = 0, np.zeros(dims), np.zeros(dims)
        for batch in batches:
            x = integers(_matrix(batch.column(0), dims), scale).astype(np.float64)
            n, total, squares = n + len(x), total + x.sum(axis=0), squares + (x * x).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"dim": np.arange(dims), "n": np.full(dims, n),
                                              "total": total, "squares": squares})

    rows = (vectors.select("embedding").mapInArrow(partial, "dim long, n long, total double, squares double")
            .groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").alias("t"), F.sum("squares").alias("s"))
            .orderBy("dim").collect())
    if not rows:
        return np.zeros(dims), np.ones(dims)
    n = np.array([float(r["n"]) for r in rows])
    mean = np.array([r["t"] for r in rows]) / n
    return mean, np.sqrt(np.maximum(np.array([r["s"] for r in rows]) / n - mean * mean, 0.0))


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Keys (rows of bytes, in curve order) of grid cells; a cell has ``bits`` bits per dimension.

    Level by level from the coarsest bit: the quadrant is written out, then the axes are reflected or
    exchanged with the first one so that the curve through the quadrant joins up with its
    neighbours; at the end quadrant numbers go from Gray code to curve order.
    """
    x = cells.astype(np.uint32).copy()
    n, dims = x.shape
    for level in range(bits - 1, 0, -1):
        bit, low = np.uint32(1 << level), np.uint32((1 << level) - 1)
        for d in range(dims):
            upper = (x[:, d] & bit) != 0
            swap = np.where(upper, np.uint32(0), (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] ^= np.where(upper, low, swap)
            if d:
                x[:, d] ^= swap
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    turn = np.zeros(n, np.uint32)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[:, -1] >> np.uint32(level)) & 1, np.uint32((1 << level) - 1), np.uint32(0))
    x ^= turn[:, None]
    levels = np.arange(bits - 1, -1, -1, dtype=np.uint32)
    planes = (x[:, None, :] >> levels[None, :, None]) & np.uint32(1)
    return np.packbits(planes.reshape(n, bits * dims).astype(np.uint8), axis=1)


def _packed(x: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """Width in bytes, box and vectors of a block, in the narrowest integers that hold them."""
    lo, hi = x.min(axis=0), x.max(axis=0)
    width = next(w for w in (1, 2, 4) if -(1 << 8 * w - 1) <= lo.min() and hi.max() < 1 << 8 * w - 1)
    return width, *(a.astype(f"<i{width}").tobytes() for a in (lo, hi, x))


def _unpacked(raw: bytes, width: int, dims: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{width}").reshape(-1, dims).astype(np.int64)


def blocks(vectors: DataFrame, dims: int, scale: int, block: int = BLOCK) -> DataFrame:
    """The vectors in blocks along the curve, one row per block with its zone map.

    Ranges are of (key, row), so that a vector that many rows repeat spreads over many tasks.
    """
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    mean, spread = moments(vectors, dims, scale)
    cells = 1 << CELL_BITS
    step = np.maximum(2 * SPREAD * spread / cells, 1e-9)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(_matrix(batch.column("embedding"), dims), scale)
            cell = np.clip((x - mean) / step + cells // 2, 0, cells - 1)
            keys = hilbert_keys(cell, CELL_BITS)
            rows = x.astype("<i4")
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("row"),
                 pa.array([k.tobytes() for k in keys], pa.binary()),
                 pa.array([r.tobytes() for r in rows], pa.binary())], ["vec_id", "row", "key", "vector"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, raw = [], []

        def flush():
            width, lo, hi, packed = _packed(_unpacked(b"".join(raw), 4, dims))
            return pa.RecordBatch.from_arrays(
                [pa.array([width], pa.int32()), pa.array([ids], pa.list_(kind)), pa.array([lo], pa.binary()),
                 pa.array([hi], pa.binary()), pa.array([packed], pa.binary())],
                ["width", "ids", "lo", "hi", "vectors"])

        for batch in batches:
            kind = batch.column("vec_id").type
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("vector").to_pylist()):
                ids.append(i)
                raw.append(v)
                if len(ids) == block:
                    yield flush()
                    ids, raw = [], []
        if ids:
            yield flush()

    placed = materialize(
        vectors.withColumn("row", F.monotonically_increasing_id())
        .mapInArrow(keyed, f"vec_id {id_type}, row long, key binary, vector binary"), "curve-keys")
    ranged = placed.repartitionByRange("key", "row").sortWithinPartitions("key", "row")
    return materialize(ranged.select("vec_id", "vector").mapInArrow(cut, BLOCKS.format(id=id_type)),
                       "curve-blocks")


def candidates(lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that can be nearest to a vector inside the box, ascending."""
    below, above = lo - centroids, centroids - hi
    nearest = np.maximum(np.maximum(below, above), 0)
    farthest = np.maximum(np.abs(below), np.abs(above))
    least, most = (nearest * nearest).sum(axis=1), (farthest * farthest).sum(axis=1)
    return np.flatnonzero(least <= most.min())


def assign(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number on ties) and squared distance of a block's vectors."""
    best = np.zeros(len(x), np.int64)
    least = np.full(len(x), MOST, np.int64)
    for c in candidates(lo, hi, centroids):
        away = x - centroids[c]
        distance = (away * away).sum(axis=1)
        nearer = distance < least
        best[nearer], least[nearer] = c, distance[nearer]
    return best, least


def _block_rows(batches: Iterator[pa.RecordBatch], dims: int):
    for batch in batches:
        for width, ids, lo, hi, raw in zip(*(batch.column(c) for c in ("width", "ids", "lo", "hi", "vectors"))):
            w = width.as_py()
            yield (ids.values, _unpacked(raw.as_py(), w, dims),
                   _unpacked(lo.as_py(), w, dims)[0], _unpacked(hi.as_py(), w, dims)[0])


def next_centroids(stored: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The exact floored mean of every centroid's vectors; a centroid without vectors stays."""
    k, dims = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for _, x, lo, hi in _block_rows(batches, dims):
            best, _ = assign(x, lo, hi, centroids)
            count += np.bincount(best, minlength=k)
            for c in np.unique(best):
                total[c] += x[best == c].sum(axis=0)
        hit = np.flatnonzero(count)
        if len(hit):
            yield pa.RecordBatch.from_pydict({
                "cluster": np.repeat(hit, dims), "dim": np.tile(np.arange(dims), len(hit)),
                "total": total[hit].ravel(), "n": np.repeat(count[hit], dims)})

    rows = (stored.mapInArrow(sums, "cluster long, dim long, total long, n long").groupBy("cluster", "dim")
            .agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect())
    out = centroids.copy()
    for r in rows:
        out[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
    return out


def assignments(stored: DataFrame, centroids: np.ndarray, id_type: str) -> DataFrame:
    """vec_id, cluster and distance of every stored vector."""
    dims = centroids.shape[1]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, lo, hi in _block_rows(batches, dims):
            best, least = assign(x, lo, hi, centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(best.astype(np.int32)), pa.array(least)],
                                             ["vec_id", "cluster", "distance"])

    return stored.mapInArrow(nearest, f"vec_id {id_type}, cluster int, distance long")


def first_centroids(vectors: DataFrame, k: int, scale: int, seed: str) -> np.ndarray:
    """The vectors of the ``k`` smallest hashes of "seed:vec_id", in hash order; ties by components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(key.alias("h"), "embedding").orderBy("h", "embedding").limit(k).collect()
    return np.array([integers(np.array(r["embedding"]), scale) for r in rows])


def cluster(table: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64,
            seed: str = "1", block: int = BLOCK) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid of each kept vector.

    Rows whose embedding is null, has another length or holds a null or non-finite component are
    left out; with none left the result is empty. With fewer than ``k`` vectors each is a
    centroid. A null vec_id hashes as an empty string and keeps its row; rows that repeat a
    vec_id or a vector are vectors of their own, so that equal centroids can arise (the smaller
    number takes all). Components beyond ``LARGEST`` after scaling count as ``LARGEST``, and sums of
    distances beyond a long as the largest long. Columns besides vec_id and embedding are ignored.
    """
    id_type = table.schema["vec_id"].dataType.simpleString()
    vectors = kept_vectors(table, dims)
    centroids = first_centroids(vectors, k, scale, seed)
    if not len(centroids):
        return table.sparkSession.createDataFrame(
            [], f"vec_id {id_type}, cluster int, distance long, cluster_inertia long, inertia long, "
                "centroid_sha256 string, centroid array<long>")
    stored = blocks(vectors, dims, scale, block)
    for _ in range(rounds):
        centroids = next_centroids(stored, centroids)
    found = materialize(assignments(stored, centroids, id_type), "clusters")
    sums = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    # One row per centroid: its sum of distances, digest and components.
    text = [",".join(map(str, c)) for c in centroids.tolist()]
    facts = [F.struct(F.lit(min(sums.get(c, 0), MOST)).cast("long").alias("i"),
                      F.lit(hashlib.sha256(t.encode()).hexdigest()).alias("h"),
                      F.lit(t).alias("t")) for c, t in enumerate(text)]
    own = F.element_at(F.array(*facts), F.col("cluster") + 1)
    return found.select(
        "vec_id", "cluster", "distance", own["i"].alias("cluster_inertia"),
        F.lit(min(sum(sums.values()), MOST)).cast("long").alias("inertia"), own["h"].alias("centroid_sha256"),
        F.split(own["t"], ",").cast("array<long>").alias("centroid"))
