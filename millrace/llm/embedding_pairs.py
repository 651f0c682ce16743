"""Near-duplicate vectors: all pairs with a cosine of at least a threshold.

Equal vectors are one class. The second moments of the unit vectors give their
principal axes; vectors are dealt to tiles in order of their first
coordinate, so a tile meets only tiles within reach. Two tiles are compared by
leading coordinates first: the product so far plus the product of the norms of
what is left bounds the cosine, and pairs (and whole tiles) that cannot reach the
threshold stop there. What remains is accumulated to the end in double
precision; products within 1e-9 of the threshold are computed again from the
vectors as given. A comparison of tiles returns counts per vector and a forest
of links, never its pairs.

Vectors of different lengths have no cosine; each length has axes and tiles of its own.

The work is quadratic where vectors are spread evenly; each vector travels once for every eighth
tile within reach.

Defined results: vectors that are null, zero, hold null or non-finite
components link with nothing and are kept; vectors link with those of their own length;
equal vectors link with each other; a null id links with nothing and has no component; rows
with equal ids stay and share a component; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import map_task
from millrace.llm.components import connected_components, forest
from millrace.session import cut_lineage

TILE = 4096
SUBTILE = 1024
TILES_A_TASK = 8
SLACK = 1e-9
SPARSE = 0.02


def is_comparable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow of squares
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    total = None
    for batch in batches:
        if batch.num_rows:
            u = unit(_matrix(batch.column("vector")))
            total = u.T @ u if total is None else total + u.T @ u
    if total is not None:
        yield {"part": [int(np.abs(total).sum() * 1e6) % 32], "moments": [total.tobytes()]}


def _sum_moments(key: tuple, group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b) for b in group["moments"].to_pylist())
    return pa.table({"moments": pa.array([total.tobytes()], pa.binary())})


def principal_axes(vectors: DataFrame, size: int) -> np.ndarray:
    """Orthogonal axes as columns, in order of their share of the second moments: ``size`` squared numbers, summed in the tasks."""
    parts = map_task(vectors.select("vector"), _moments, "part int, moments binary").groupBy("part").applyInArrow(_sum_moments, "moments binary").collect()
    total = sum((np.frombuffer(r.moments).reshape(size, size) for r in parts), np.zeros((size, size)))
    return np.linalg.eigh(total)[1][:, ::-1].copy()


def _project(axis: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            first = unit(_matrix(batch.column("vector"))) @ axis if batch.num_rows else np.zeros(0)
            yield {c: batch.column(c) for c in ("node", "key", "weight", "vector")} | {"first": first}

    return run


def _tile(cuts, reach: float):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        first = group["first"].to_numpy()
        group = group.take(pa.array(np.argsort(first, kind="stable")))
        last = int(np.searchsorted(cuts.value, first.max() + reach, side="right"))
        vectors = group["vector"].combine_chunks()
        vectors = vectors.flatten() if isinstance(vectors, pa.Array) else pa.concat_arrays([c.flatten() for c in vectors.chunks])
        return pa.table({
            "tile": pa.array([key[0].as_py()], pa.int64()), "last": pa.array([last], pa.int64()),
            **{c: pa.array([group[c].to_numpy().astype(np.int64).tobytes()], pa.binary()) for c in ("node", "key", "weight")},
            "vectors": pa.array([vectors.to_numpy(zero_copy_only=False).astype(np.float64).tobytes()], pa.binary()),
        })

    return run


def near_pairs(x: np.ndarray, y: np.ndarray, threshold: float, steps: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of unit vectors ``x`` and ``y`` (in principal coordinates) whose cosine may reach the threshold, and the cosine."""
    least = threshold - SLACK
    rows, cols = np.arange(len(x)), np.arange(len(y))
    done, block = 0, np.zeros((len(x), len(y)))
    pairs = None
    for upto in [*steps, x.shape[1]]:
        rest_x, rest_y = (np.sqrt(np.einsum("ij,ij->i", v[:, upto:], v[:, upto:])) for v in (x, y))
        if pairs is None:
            block += x[rows, done:upto] @ y[cols, done:upto].T
            open_ = block + np.outer(rest_x[rows], rest_y[cols]) >= least
            found = np.count_nonzero(open_)
            if not found:
                return rows[:0], cols[:0], np.zeros(0)
            if found <= SPARSE * open_.size or upto == x.shape[1]:
                i, j = np.nonzero(open_)
                pairs = rows[i], cols[j], block[i, j]
            else:
                keep_rows, keep_cols = open_.any(axis=1), open_.any(axis=0)
                rows, cols, block = rows[keep_rows], cols[keep_cols], block[np.ix_(keep_rows, keep_cols)]
        else:
            i, j, sums = pairs
            sums = sums + np.einsum("ij,ij->i", x[i, done:upto], y[j, done:upto])
            open_ = sums + rest_x[i] * rest_y[j] >= least
            pairs = i[open_], j[open_], sums[open_]
        done = upto
    return pairs


def compare_tiles(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of linked rows, part by part; of a tile with itself each pair once."""
    size = x.shape[1]
    steps = [s for s in (size // 8, size // 4, size // 2) if s]
    units = [unit(x), unit(y)]
    px, py = (u @ axes for u in units)
    for a in range(0, len(x), SUBTILE):
        for b in range(a if same else 0, len(y), SUBTILE):
            i, j, cosine = near_pairs(px[a : a + SUBTILE], py[b : b + SUBTILE], threshold, steps)
            i, j = i + a, j + b
            if same:
                once = i < j
                i, j, cosine = i[once], j[once], cosine[once]
            close = np.flatnonzero(np.abs(cosine - threshold) <= 2 * SLACK)
            if len(close):
                p, q = x[i[close]], y[j[close]]
                cosine[close] = np.einsum("ij,ij->i", p, q) / (np.linalg.norm(p, axis=1) * np.linalg.norm(q, axis=1))
            linked = cosine >= threshold
            yield i[linked], j[linked]


def _compare(axes, threshold: float):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        tiles = []
        for r in group.select(["side", "tile", "node", "key", "weight", "vectors"]).to_pylist():
            node, own, weight = (np.frombuffer(r[c], np.int64) for c in ("node", "key", "weight"))
            tiles.append((r["side"], r["tile"], node, own, weight, np.frombuffer(r["vectors"]).reshape(len(node), -1)))
        left = next(t for t in tiles if t[0] == 0)
        out = {c: [np.zeros(0, np.int64)] for c in ("a", "b", "n")}

        def add(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> None:
            for name, value in zip(out, (a, b, n)):
                out[name].append(value)

        counts = np.zeros(len(left[2]), np.int64)
        for right in sorted((t for t in tiles if t[0] == 1), key=lambda t: t[1]):
            same = right[1] == left[1]
            others = np.zeros(len(right[2]), np.int64)
            highs, lows = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for i, j in compare_tiles(left[5], right[5], axes.value, threshold, same):
                counts += np.bincount(i, weights=right[4][j], minlength=len(counts)).astype(np.int64)
                others += np.bincount(j, weights=left[4][i], minlength=len(others)).astype(np.int64)
                a, b = left[2][i], right[2][j]
                highs, lows = forest(np.concatenate([highs, np.maximum(a, b)[a != b]]), np.concatenate([lows, np.minimum(a, b)[a != b]]))
            add(highs, lows, np.full(len(highs), -1))
            hit = others > 0
            add(right[2][hit], right[3][hit], others[hit])
        hit = counts > 0
        add(left[2][hit], left[3][hit], counts[hit])
        return pa.table({c: pa.array(np.concatenate(v)) for c, v in out.items()})

    return run


def _links(classes: DataFrame, size: int, total: int, threshold: float) -> DataFrame:
    """``a, b, n`` of classes of one length: forests of links with ``n`` -1, else key and number of links of a node."""
    spark = classes.sparkSession
    axes = principal_axes(classes, size)
    placed = cut_lineage(map_task(classes.select("node", "key", "weight", "vector"), _project(axes[:, 0]), "node long, key long, weight long, vector array<double>, first double"))
    tiles = -(-total // TILE)
    shares = [k / tiles for k in range(1, tiles)]
    cuts = placed.agg(F.percentile_approx("first", shares, 10000).alias("cuts")).first().cuts if shares else []
    cuts = spark.sparkContext.broadcast(np.array(cuts, np.float64))
    tile = F.lit(0).cast("long") if not shares else F.size(F.filter(F.array(*map(F.lit, cuts.value.tolist())), lambda c: c < F.col("first"))).cast("long")
    # unit vectors further apart than this along any axis are below the threshold
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
    tiled = cut_lineage(
        placed.withColumn("tile", tile).groupBy("tile")
        .applyInArrow(_tile(cuts, reach), "tile long, last long, node binary, key binary, weight binary, vectors binary")
    )
    partners = tiled.select(F.col("tile").alias("of"), F.explode(F.sequence("tile", "last")).alias("tile"))
    of = F.struct("of", F.floor(F.col("tile") / TILES_A_TASK).alias("part")).alias("task")
    right = tiled.join(partners, "tile").select(of, F.lit(1).alias("side"), "tile", "node", "key", "weight", "vectors")
    left = partners.select(of, F.col("of").alias("tile")).distinct().join(tiled, "tile").select("task", F.lit(0).alias("side"), "tile", "node", "key", "weight", "vectors")
    return cut_lineage(left.union(right).groupBy("task").applyInArrow(_compare(spark.sparkContext.broadcast(axes), threshold), "a long, b long, n long"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """``id, n_links, component_id, kept`` of every row."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    usable = rows.where(F.col("id").isNotNull() & is_comparable(F.col("vector"))).withColumn("key", F.xxhash64("vector"))
    classes = cut_lineage(usable.groupBy("key", "vector").agg(F.min("id").alias("node"), F.count("*").alias("weight")))
    length = F.size("vector").alias("length")
    found = spark.createDataFrame([], "a long, b long, n long")
    for r in classes.groupBy(length).agg(F.count("*").alias("n")).orderBy("length").collect():
        found = found.union(_links(classes.where(F.size("vector") == r.length), r.length, r.n, threshold))
    counts = found.where("n >= 0").groupBy(F.col("a").alias("node"), F.col("b").alias("key")).agg(F.sum("n").alias("n"))
    linked = cut_lineage(classes.join(counts, ["node", "key"], "left").select("key", "vector", "node", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    members = usable.select("id", "key", "vector").join(linked, ["key", "vector"]).select("id", "node", "key", "n_links")
    members = cut_lineage(members)
    same = members.where("id <> node").select(F.col("id").alias("a"), F.col("node").alias("b"))
    components = cut_lineage(connected_components(found.where("n < 0").select("a", "b").union(same)))
    # each row again with its own links: rows that are not comparable have none
    rest = rows.where(~(F.col("id").isNotNull() & is_comparable(F.col("vector")))).select("id", F.lit(0).cast("long").alias("n_links"))
    every = members.select("id", "n_links").union(rest)
    out = every.join(components.select(F.col("node").alias("id"), "component"), "id", "left").select("id", "n_links", F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
