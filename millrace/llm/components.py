"""Connected components of a graph of links, by alternating star contraction.

Every round maps the links of each node to the smallest node it knows (large
star, then small star) until nothing changes; links are reduced to a forest
inside each task before they are shuffled. Each round is written to the shared
folder, so lineage stays short. Nothing is collected: the driver sees one
number per round. The links of a node with very many of them are never
gathered: minima are aggregates with a map-side part, and the join that hands
them back spreads a hot node as any skewed join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import map_task
from millrace.session import cut_lineage


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star links ``(node, smallest node of its tree)`` with the same components as the given links."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))
    for x, y in zip(places[: len(a)].tolist(), places[len(a) :].tolist()):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    for x in range(len(parent)):
        parent[x] = parent[parent[x]]  # parents are smaller, so theirs are final
    root = np.array(parent, np.int64)
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    high, low = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
        high, low = forest(np.concatenate([high, a]), np.concatenate([low, b]))
        if len(high) > 2_000_000:  # the forest of a task stays bounded
            yield {"a": pa.array(high), "b": pa.array(low)}
            high, low = high[:0], low[:0]
    yield {"a": pa.array(high), "b": pa.array(low)}


def contract(links: DataFrame) -> DataFrame:
    """Links of each task reduced to stars ``a -> b``, ``b`` smaller."""
    return map_task(links.select("a", "b"), _local_forest, "a long, b long").where("a > b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node in ``links`` (columns ``a``, ``b``); the component is its smallest node."""
    stars = cut_lineage(contract(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))))
    before = None
    while True:
        # large star: all larger neighbours of a node go to the smallest of its neighbourhood
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        large = stars.select(F.col("b").alias("n"), F.col("a").alias("other")).join(least.withColumnRenamed("a", "n"), "n").select(F.col("other").alias("a"), F.col("least").alias("b"))
        # small star: a node and its smaller neighbours go to the smallest of them
        large = large.where("a > b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(small_least, "a").select(F.explode(F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("l")).select("l.*")
        stars = cut_lineage(small.where("a > b").distinct())
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = now
