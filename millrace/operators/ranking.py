"""Row numbers that scale with one hot group.

A window over a group would sort a hot group in one task. Here rows are range
partitioned by group and order, whatever their values look like: Spark samples
the bounds, and a last random key parts rows that are equal in all others. A
row's place inside its partition is fixed by writing the sorted rows once; the
size of a group in the partitions before is added to it. Only counts per group and
partition are summed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import cut_lineage

PLACE_BITS = 33  # fixed value: the bits below the partition in monotonically_increasing_id


def numbered(
    df: DataFrame,
    group_by: Sequence[str],
    order_by: str,
    out: str,
    ties: Sequence[str] = (),
    descending: bool = False,
    start: int = 1,
) -> DataFrame:
    """Add ``out`` = position of the row in its group by ``order_by``, ``ties``.

    The rows are sorted and written to the shared folder here, so each row has
    one number however often the result is read. Rows equal in ``order_by`` and ``ties``
    are numbered in any order. No groups: positions in the whole table.
    """
    order = F.col(order_by).desc() if descending else F.col(order_by).asc()
    keys = [*group_by, order, *ties, "_mix"]
    placed = cut_lineage(
        df.withColumn("_mix", F.rand(17)).repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id()).drop("_mix")
    )
    # one struct key: NULL group values match
    key = F.struct(*group_by, F.shiftright("_at", PLACE_BITS).alias("_part"))
    runs = placed.groupBy(key.alias("_key")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = (
        Window.partitionBy(*[F.col(f"_key.`{g}`") for g in group_by])
        .orderBy("_key._part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    shift = runs.select("_key", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return (
        placed.withColumn("_key", key)
        .join(shift, "_key")
        .withColumn(out, (F.col("_at") + F.col("_shift") + start).cast("long"))
        .drop("_key", "_at", "_shift")
    )


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The newest whole row per key, combined on the map side before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, "_row.*").select(*df.columns)
