"""Clusters of vectors around integer centroids, with distances by bit-plane popcounts.

Each component becomes an integer. Bit ``i`` of all 64 components of a vector is
one 64-bit word, its plane ``i``; the last plane carries the sign (two's
complement). The dot product of a vector and a centroid is the sum over all
pairs of planes of their weights' product times ``popcount(plane & plane)``, and
squared distances follow from it exactly. A vector is written once, as its planes
(eight words for components of unit vectors) and its squared length.

Each round is one pass over the planes: tasks add up the members of every
centroid, again plane by plane, and only 64 sums per centroid leave a task; the driver sees the
centroids (16 by 64 numbers) and nothing else. No row is shuffled.

Defined results: vectors that are null, have another number of components than
64, or hold a null or non-finite one, are left out; repeated rows and repeated
ids are rows of their own; rows with a null id belong to a cluster as any other
and start a centroid only where there are fewer rows with an id than centroids;
equal ids start centroids in the order of their squared lengths and planes; fewer vectors than
centroids give fewer centroids, an empty table an empty result; a component of
more than 2**27 after scaling is an error, as its distances may not fit a
long. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import map_batches, map_task
from millrace.llm.vectors import scaled_floor, whole_vectors
from millrace.session import cut_lineage

WIDTH = 64
MOST = 1 << 27


def planes_of(ints: np.ndarray) -> np.ndarray:
    """Bit planes of integer vectors of 64 components: one row of words per vector, as many as the largest number needs."""
    reach = max(int(ints.max(initial=0)), -int(ints.min(initial=0)) - 1)
    bits = reach.bit_length() + 1
    planes = [np.packbits((ints >> i & 1).astype(np.uint8), axis=1, bitorder="little").view(np.uint64)[:, 0] for i in range(bits)]
    return np.stack(planes, axis=1)


def weights(bits: int) -> np.ndarray:
    """Value of each plane's bits; those of the last one are negative."""
    w = np.left_shift(np.int64(1), np.arange(bits, dtype=np.int64))
    w[-1] = -w[-1]
    return w


def dots(planes: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact dot products of all vectors with all centroids, both as planes."""
    out = np.zeros((len(planes), len(centroids)), np.int64)
    for i, a in enumerate(weights(planes.shape[1]).tolist()):
        for j, b in enumerate(weights(centroids.shape[1]).tolist()):
            out += np.bitwise_count(planes[:, i, None] & centroids[None, :, j]).astype(np.int64) * (a * b)
    return out


def squared_lengths(planes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(planes), np.int64)
    w = weights(planes.shape[1]).tolist()
    for i, a in enumerate(w):
        out += np.bitwise_count(planes[:, i]).astype(np.int64) * (a * a)
        for j in range(i):
            out += np.bitwise_count(planes[:, i] & planes[:, j]).astype(np.int64) * (2 * a * w[j])
    return out


def member_sums(planes: np.ndarray, cluster: np.ndarray, k: int) -> np.ndarray:
    """Componentwise sums of the vectors of each cluster, from counts of set bits."""
    member = np.zeros((k, len(planes)))
    member[cluster, np.arange(len(planes))] = 1
    out = np.zeros((k, WIDTH), np.int64)
    for i, w in enumerate(weights(planes.shape[1]).tolist()):
        bits = np.unpackbits(np.ascontiguousarray(planes[:, i]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out += (member @ bits).astype(np.int64) * w  # counts of rows: exact
    return out


def nearest(planes: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smaller one on ties) and the squared distance to it."""
    theirs = planes_of(centroids)
    distances = norms[:, None] - 2 * dots(planes, theirs) + squared_lengths(theirs)[None, :]
    best = distances.argmin(axis=1)
    return best, distances[np.arange(len(best)), best]


def _words(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and planes, one pair per number of planes (it may differ between the tasks that wrote them)."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for bits in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == bits)
        yield rows, column.take(pa.array(rows)).flatten().to_numpy().view(np.uint64).reshape(len(rows), bits)


def _pack(scale: float):
    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for rows, matrix in whole_vectors(batch.column("vector")):
            if matrix.shape[1] == WIDTH:
                planes = planes_of(scaled_floor(matrix, scale, MOST))
                words = pa.ListArray.from_arrays(pa.array(np.arange(len(planes) + 1) * planes.shape[1], pa.int32()), pa.array(planes.view(np.int64).ravel()))
                yield {"id": batch.column("id").take(pa.array(rows)), "planes": words, "norm": squared_lengths(planes)}

    return run


def _sum_members(centroids: np.ndarray):
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        totals, counts = np.zeros((k, WIDTH), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            norms = batch.column("norm").to_numpy()
            for rows, planes in _words(batch.column("planes")):
                best, _ = nearest(planes, norms[rows], centroids)
                totals += member_sums(planes, best, k)
                counts += np.bincount(best, minlength=k)
        used = np.flatnonzero(counts)
        yield {
            "cluster": np.repeat(used, WIDTH), "place": np.tile(np.arange(WIDTH), len(used)), "total": totals[used].ravel(), "n": np.repeat(counts[used], WIDTH),
        }

    return run


def _assign(centroids: np.ndarray):
    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        norms = batch.column("norm").to_numpy()
        for rows, planes in _words(batch.column("planes")):
            best, distance = nearest(planes, norms[rows], centroids)
            yield {"id": batch.column("id").take(pa.array(rows)), "cluster": best, "distance": distance}

    return run


def _integers(planes: list[int]) -> list[int]:
    words = np.array([planes], np.int64).view(np.uint64)
    return member_sums(words, np.zeros(1, np.int64), 1)[0].tolist()


def first_centroids(packed: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors whose seeded ids have the smallest hash."""
    sign = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    starts = packed.select(sign.alias("sign"), "norm", "planes").orderBy(F.col("sign").asc_nulls_last(), "norm", "planes").limit(k).collect()
    return np.array([_integers(r.planes) for r in starts], np.int64).reshape(len(starts), WIDTH)


def moved_centroids(packed: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floored mean of each centroid's vectors; a centroid without any stays."""
    partial = map_task(packed.select("planes", "norm"), _sum_members(centroids), "cluster int, place int, total long, n long")
    sums = partial.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in sums.collect():  # one row per centroid and component
        out[r.cluster, r.place] = int(r.total) // r.n
    return out


def cluster_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3, scale: float = 64.0, seed: int = 1,
) -> DataFrame:
    """``id, cluster, distance, cluster_inertia, inertia, centroid`` of every vector of 64 finite components.

    ``distance`` is the squared distance to the final ``centroid``; inertias are its sums over the cluster and over all.
    """
    spark = df.sparkSession
    picked = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    packed = cut_lineage(map_batches(picked, _pack(scale), "id long, planes array<long>, norm long"))
    centroids = first_centroids(packed, k, seed)
    if not len(centroids):
        return packed.selectExpr("id", "0 AS cluster", "norm AS distance", "norm AS cluster_inertia", "norm AS inertia", "planes AS centroid")
    for _ in range(rounds):
        centroids = moved_centroids(packed, centroids)
    assigned = cut_lineage(map_batches(packed, _assign(centroids), "id long, cluster int, distance long"))
    sums = {r.cluster: int(r.total) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    total = sum(sums.values())
    final = [(c, sums[c], total, centroids[c].tolist()) for c in sorted(sums)]
    return assigned.join(spark.createDataFrame(final, "cluster int, cluster_inertia long, inertia long, centroid array<long>"), "cluster").select(
        "id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"
    )
