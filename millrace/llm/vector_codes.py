"""Compression of vectors to one code per part, with distances by per-dimension value dictionaries.

Components become integers and vectors are cut into equal parts; each part has a codebook of
a few entries, moved towards its members for some rounds.

Vectors are written once, in blocks: per dimension the distinct integers of the block
(its dictionary) and, for each vector, the number of its integer therein, two bytes. In
every pass a block tabulates the squared differences of each distinct integer to all entries,
dimension by dimension; the distances of a part are then gathered by the dictionary
numbers and added up. A dictionary never spans more than a block, so it is bounded
however many values a dimension has.

A round sends one sum per entry and component out of each task; the driver holds the
codebooks (per vector length 16 vectors), nothing that grows with the rows.

Defined results: vectors that are null or hold a null or non-finite component
are left out; vectors of different lengths have codebooks of their own;
a length that cannot be cut into equal parts gives a null code and error and counts in no
sum; repeated rows and ids are rows of their own, and equal ids start entries in the
order of their components; null ids start entries last; fewer vectors than entries give
fewer entries; an empty table gives an empty result; integers so large
that squared distances do not fit a long are an error. Columns other than the named ones are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.batches import map_batches, map_task
from millrace.llm.vectors import scaled_floor, whole_vectors
from millrace.operators.skew import spread_join
from millrace.session import cut_lineage

BLOCK_NUMBERS = 1 << 21
BLOCK_ROWS = 1 << 16
OUT_ROWS = 20_000
BLOCK = (
    "dim int, n int, ids array<long>, labels array<string>, values array<long>, sizes array<int>, numbers binary,"
    " starts array<struct<id:long,vector:array<long>>>"
)

Codebooks = dict[int, np.ndarray]  # by vector length: parts x entries x components


def dictionaries(ints: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Per dimension the distinct integers, and for each vector their numbers (one row per dimension)."""
    values, numbers = [], np.zeros(ints.shape[::-1], np.uint16)
    for d in range(ints.shape[1]):
        distinct, numbers[d] = np.unique(ints[:, d], return_inverse=True)
        values.append(distinct)
    return values, numbers


def nearest_entries(values: list[np.ndarray], numbers: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (the lower one on ties) and its squared distance, of one part of all vectors of a block."""
    total = np.zeros((numbers.shape[1], len(entries)), np.int64)
    for distinct, number, entry in zip(values, numbers, entries.T):
        total += ((distinct[:, None] - entry[None, :]) ** 2)[number]
    best = total.argmin(axis=1)
    return best, total[np.arange(len(best)), best]


def _block(dim: int, ids: list, labels: list, ints: np.ndarray, entries: int) -> dict:
    values, numbers = dictionaries(ints)
    chosen = heapq.nsmallest(entries, range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, ints[i].tolist()))
    return {
        "dim": [dim], "n": [len(ids)], "ids": [ids], "labels": [labels], "values": [np.concatenate([*values, np.zeros(0, np.int64)])],
        "sizes": [[len(v) for v in values]], "numbers": [numbers.tobytes()], "starts": [[{"id": ids[i], "vector": ints[i].tolist()} for i in chosen]],
    }


def _pack(scale: float, entries: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: dict[int, list[tuple[list, list, np.ndarray]]] = {}
        size = 0

        def flush() -> Iterator[dict]:
            for dim, parts in held.items():
                ids, labels = ([x for p in parts for x in p[k]] for k in (0, 1))
                ints = np.concatenate([p[2] for p in parts])
                step = max(1, min(BLOCK_ROWS, BLOCK_NUMBERS // max(dim, 1)))
                for a in range(0, len(ids), step):
                    yield _block(dim, ids[a : a + step], labels[a : a + step], ints[a : a + step], entries)
            held.clear()

        for batch in batches:
            for rows, matrix in whole_vectors(batch.column("vector")):
                dim = matrix.shape[1]
                ints = scaled_floor(matrix, scale, isqrt((1 << 62) // max(dim, 1)) // 2)
                picked = pa.array(rows)
                held.setdefault(dim, []).append((batch.column("id").take(picked).to_pylist(), batch.column("label").take(picked).to_pylist(), ints))
                size += ints.size + len(rows)
            if size >= BLOCK_NUMBERS:
                yield from flush()
                size = 0
        yield from flush()

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[np.ndarray], np.ndarray]]:
    for batch in batches:
        for row in range(batch.num_rows):
            one = {name: batch.column(name)[row] for name in batch.schema.names}
            dim, n = one["dim"].as_py(), one["n"].as_py()
            ends = np.cumsum(one["sizes"].values.to_numpy(zero_copy_only=False))
            values = np.split(one["values"].values.to_numpy(zero_copy_only=False), ends[:-1]) if dim else []
            yield one, values, np.frombuffer(one["numbers"].as_py(), np.uint16).reshape(dim, n)


def _sum_parts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        books: Codebooks = shared.value
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for one, values, numbers in _blocks(batches):
            dim = one["dim"].as_py()
            if dim not in books:
                continue
            parts, entries, width = books[dim].shape
            totals, counts = sums.setdefault(dim, (np.zeros(books[dim].shape, np.int64), np.zeros((parts, entries), np.int64)))
            for p in range(parts):
                cut = slice(p * width, (p + 1) * width)
                best, _ = nearest_entries(values[cut], numbers[cut], books[dim][p])
                counts[p] += np.bincount(best, minlength=entries)
                for d in range(width):
                    # sums of at most 2**16 numbers below 2**31: exact in double
                    of_entry = np.bincount(best, weights=values[p * width + d][numbers[p * width + d]], minlength=entries)
                    totals[p, :, d] += of_entry.astype(np.int64)
        for dim, (totals, counts) in sums.items():
            part, entry, place = (x.ravel() for x in np.indices(totals.shape))
            yield {"dim": [dim] * len(part), "part": part, "entry": entry, "place": place, "total": totals.ravel(), "n": counts[part, entry]}

    return run


def _encode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        books: Codebooks = shared.value
        for one, values, numbers in _blocks(batches):
            dim, n = one["dim"].as_py(), one["n"].as_py()
            ids, labels = one["ids"].values, one["labels"].values
            if dim in books:
                parts, _, width = books[dim].shape
                found = [nearest_entries(values[c], numbers[c], books[dim][p]) for p in range(parts) for c in [slice(p * width, (p + 1) * width)]]
                codes, errors = np.stack([f[0] for f in found], axis=1).astype(np.int32), np.sum([f[1] for f in found], axis=0)
            for a in range(0, n, OUT_ROWS):
                rows = min(OUT_ROWS, n - a)
                out = {"id": ids.slice(a, rows), "label": labels.slice(a, rows), "dim": [dim] * rows, "codes": [None] * rows, "error": [None] * rows}
                if dim in books:
                    offsets = pa.array(np.arange(rows + 1) * parts, pa.int32())
                    out |= {"codes": pa.ListArray.from_arrays(offsets, pa.array(codes[a : a + rows].ravel())), "error": errors[a : a + rows]}
                yield out

    return run


def first_codebooks(blocks: DataFrame, parts: int, entries: int) -> Codebooks:
    """Parts of the vectors with the smallest ids, per vector length."""
    rank = F.row_number().over(Window.partitionBy("dim").orderBy(F.col("s.id").asc_nulls_last(), "s.vector"))
    starts = blocks.where(F.col("dim") % parts == 0).select("dim", F.explode("starts").alias("s")).select("dim", "s.vector", rank.alias("rank"))
    found: dict[int, list] = {}
    for r in starts.where(F.col("rank") <= entries).orderBy("dim", "rank").collect():  # the codebooks themselves
        found.setdefault(r.dim, []).append(r.vector)
    return {dim: np.array(rows, np.int64).reshape(len(rows), parts, dim // parts).transpose(1, 0, 2) for dim, rows in found.items()}


def moved_codebooks(blocks: DataFrame, books: Codebooks) -> Codebooks:
    """Floored mean of each entry's parts; an entry without any stays."""
    shared = blocks.sparkSession.sparkContext.broadcast(books)
    partial = map_task(blocks.select("dim", "n", "values", "sizes", "numbers"), _sum_parts(shared), "dim int, part int, entry int, place int, total long, n long")
    sums = partial.groupBy("dim", "part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).where("n > 0")
    out = {dim: book.copy() for dim, book in books.items()}
    for r in sums.collect():
        out[r.dim][r.part, r.entry, r.place] = int(r.total) // r.n
    return out


def compress_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0,
) -> tuple[DataFrame, DataFrame]:
    """``(codes, codebooks)``: ``id, label, dim, codes, error`` of every vector, and ``dim, codebooks`` (by part and entry) per vector length.

    ``codes`` has an entry number per part, ``error`` the squared distances to these entries in all.
    """
    spark = df.sparkSession
    picked = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("vector"))
    blocks = cut_lineage(map_task(picked, _pack(scale, entries), BLOCK))
    books = first_codebooks(blocks, parts, entries)
    for _ in range(rounds):
        books = moved_codebooks(blocks, books)
    shared = spark.sparkContext.broadcast(books)
    codes = cut_lineage(map_task(blocks.drop("starts"), _encode(shared), "id long, label string, dim int, codes array<int>, error long"))
    rows = [(dim, book.tolist()) for dim, book in books.items()]
    return codes, spark.createDataFrame(rows, "dim int, codebooks array<array<array<long>>>")


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``: the error summed over equal labels, null ones together; rows without an error have none."""
    keyed = codes.where("error IS NOT NULL").withColumn("_none", F.col("label").isNull()).withColumn("_label", F.coalesce("label", F.lit("")))
    sums = cut_lineage(keyed.groupBy("_none", "_label").agg(F.sum("error").alias("label_error")))
    joined = spread_join(keyed, sums, ["_none", "_label"], ["id"]).select(*codes.columns, "label_error")
    return joined.unionByName(codes.where("error IS NULL").withColumn("label_error", F.lit(None).cast("long")))
