"""Joins of many facts to one row per key, where keys may be very hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import cut_lineage

ROWS_PER_SLICE = 1_000_000


def hot_keys(facts: DataFrame, on: Sequence[str], rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Every key with more than ``rows_per_slice`` rows, and the slices it needs.

    There are at most as many as slices in all, so they are few beside the
    facts. They are written once and never collected: their size decides how
    they are joined.
    """
    counted = facts.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows_per_slice)
    return cut_lineage(counted.select(*on, F.ceil(F.col("_n") / rows_per_slice).cast("int").alias("_slices")))


def spread_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Join on ``on`` with the facts of every hot key spread over several tasks.

    The slice of a fact is a hash of ``spread_by``, so it does not change when
    a task is repeated. The rows of ``lookup`` that have a hot key are copied,
    one per slice; no others are. A later aggregation by ``on`` combines per
    slice before it shuffles.
    """
    hot = hot_keys(facts, on, rows_per_slice)
    slices = F.coalesce("_slices", F.lit(1))
    spread = (
        facts.join(hot, list(on), "left")
        .withColumn("_slice", F.pmod(F.xxhash64(*spread_by), slices).cast("int"))
        .drop("_slices")
    )
    copies = (
        lookup.join(hot, list(on), "left")
        .withColumn("_slice", F.explode(F.sequence(F.lit(0), slices - 1)))
        .drop("_slices")
    )
    return spread.join(copies, [*on, "_slice"], how).drop("_slice")
