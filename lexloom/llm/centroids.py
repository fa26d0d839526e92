"""Centroid clustering of integer vectors, exact.

Float32 products of vectors and centroids give a score for each pair together with an interval that surely holds the exact value:
a sum of d products errs by at most gamma(d) times the product of the norms, whatever the order of summation. A centroid whose
interval lies above the upper end of another cannot be nearest. Where one is left, it is the nearest; where several intervals
overlap, their exact integer distances decide, the smallest number winning a tie.

A round reads the vectors once. Tasks sum the members of each cluster, Spark adds these sums, and the driver divides them: k rows
of d numbers, whatever the input. Vectors are a table in the shared folder, and a round's centroids go out with its tasks.

Edge cases: vectors that are null, of another length, hold a null or a non-finite component, or one beyond +-2**19 (its squares leave 64
bits) are left out; a null vec_id cannot start a centroid; rows that repeat a vec_id are vectors of their own, and of these the one
with the smaller components starts a centroid first; fewer kept vectors than k give as many centroids; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import map_arrow
from lexloom.session import materialise

#: Vectors whose products are made at once, and the greatest component that keeps distances in 64 bits.
BLOCK, MOST = 8192, 1 << 27
#: Unit roundoff of float32.
_U = 2.0**-24


def matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list column that are whole finite vectors of dims numbers, as numbers of rows and a float64 matrix."""
    flat = column.flatten()
    sizes = np.diff(column.offsets.to_numpy())
    null = column.is_null().to_numpy(zero_copy_only=False)
    sizes = np.where(null, 0, sizes)
    ends = np.cumsum(sizes)
    values = np.nan_to_num(np.asarray(flat.cast(pa.float64()).fill_null(float("nan"))), nan=np.inf, posinf=np.inf, neginf=np.inf)
    rows = np.flatnonzero(sizes == dims)
    held = values[(ends[rows] - dims)[:, None] + np.arange(dims)] if len(rows) else np.zeros((0, dims))
    whole = np.isfinite(held).all(axis=1)
    return rows[whole], held[whole]


def _integers(dims: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held = matrix(b.column(1), dims)
            held = np.floor(np.minimum(np.abs(held), MOST) * np.sign(held) * scale)
            fits = (np.abs(held) <= MOST).all(axis=1)
            ids = b.column(0).take(pa.array(rows[fits]))
            packed = held[fits].astype("<i4")
            yield pa.RecordBatch.from_arrays([ids, pa.array([r.tobytes() for r in packed], pa.binary())], names=["vec_id", "vec"])

    return run


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of x the nearest centroid, ties to the smaller number, and how many rows needed exact distances."""
    d = x.shape[1]
    x64, c64 = x.astype(np.float64), centroids.astype(np.float64)
    norm_x, norm_c = np.sqrt((x64 * x64).sum(1)) * (1 + 1e-12), np.sqrt((c64 * c64).sum(1)) * (1 + 1e-12)
    # score: |c|^2 - 2 x.c; the product errs by rounding both inputs, d products and their sum
    gamma = (d + 4) * _U / (1 - (d + 4) * _U)
    product = x.astype(np.float32) @ centroids.astype(np.float32).T
    score = (c64 * c64).sum(1) - 2.0 * product.astype(np.float64)
    error = 2.0 * gamma * norm_x[:, None] * norm_c + 1e-9 * (norm_c * norm_c + norm_x[:, None] * norm_c) + 1e-30
    can = score - error <= (score + error).min(axis=1)[:, None]
    out = can.argmax(axis=1)
    several = np.flatnonzero(can.sum(axis=1) > 1)
    row, k = np.nonzero(can[several])
    gap = x[several[row]].astype(np.int64) - centroids[k]
    exact = np.full((len(several), len(centroids)), np.iinfo(np.int64).max)
    exact[row, k] = (gap * gap).sum(axis=1)
    out[several] = exact.argmin(axis=1)
    return out, several


def _rows(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)


def _sums(centroids: np.ndarray):
    """Members and component sums of each cluster over the rows of a task."""
    k, d = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                x = _rows(b.column(0).slice(at, BLOCK), d)
                to, _ = nearest(x, centroids)
                order = np.argsort(to, kind="stable")
                held, first = np.unique(to[order], return_index=True)
                count[held] += np.diff(np.append(first, len(order)))
                total[held] += np.add.reduceat(x[order], first, axis=0)
        some = np.flatnonzero(count)
        columns = [pa.array(some, pa.int32()), pa.array(count[some]), *(pa.array(total[some, j]) for j in range(d))]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", *(f"s{j}" for j in range(d))])

    return run


def _assigned(centroids: np.ndarray):
    d = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                x = _rows(part.column(1), d)
                to, _ = nearest(x, centroids)
                gap = x - centroids[to]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(to, pa.int32()), pa.array((gap * gap).sum(axis=1))], names=["vec_id", "cluster", "distance"])

    return run


def _start(vectors: DataFrame, k: int, dims: int, seed: int) -> np.ndarray:
    """The k vectors whose ids have the smallest digests, k rows at the driver."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.where("vec_id is not null").withColumn("digest", digest)
    components = F.col("vec")
    rows = first.orderBy("digest", components).limit(k).collect()
    # equal digests are repeated ids: by their components
    held = sorted((r["digest"], np.frombuffer(bytes(r["vec"]), "<i4").tolist()) for r in rows)
    return np.array([v for _, v in held], np.int64).reshape(-1, dims)


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of the vectors(vec_id, embedding) that are whole.

    Components are floor(scale * x). Centroids are the componentwise floor of the mean of their members, rounds times over; one
    without members stays. Distances are squared and to the last centroids.
    """
    ids = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    kept = materialise(map_arrow(ids, _integers(dims, scale), "vec_id long, vec binary"), "vectors")
    centroids = _start(kept, k, dims, seed)
    schema = "cluster int, n long, " + ", ".join(f"s{j} long" for j in range(dims))
    for _ in range(rounds if len(centroids) else 0):
        sums = map_arrow(kept.select("vec"), _sums(centroids), schema).groupBy("cluster").agg(*(F.sum(c).alias(c) for c in ("n", *(f"s{j}" for j in range(dims)))))
        moved = centroids.copy()
        for r in sums.collect():
            moved[r["cluster"]] = [r[f"s{j}"] // r["n"] for j in range(dims)]
        centroids = moved
    if not len(centroids):
        centroids = np.zeros((1, dims), np.int64)
    to = materialise(map_arrow(kept, _assigned(centroids), "vec_id long, cluster int, distance long"), "assigned")
    inertia = {r["cluster"]: r["d"] for r in to.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = to.sparkSession.createDataFrame([(j, inertia.get(j), sum(inertia.values()), s) for j, s in enumerate(names)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return to.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
