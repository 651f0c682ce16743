"""Layers of configuration: the latest value per path, and lists put together.

A configuration is a table of leaves ``(layer, seq, path, value)``. Later
``(layer, seq)`` wins, so argument rows carry the highest layer, injected rows
the next, and files follow in list order with the last file above the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.skew import spread_join
from millrace.session import cut_lineage


def prefixes(path: Column, separator: str) -> Column:
    """The proper ancestors of a path, NULL for a top-level one."""
    parts = F.split(path, "\\Q" + separator + "\\E")
    steps = F.sequence(F.lit(1), F.size(parts) - 1)
    return F.when(F.size(parts) > 1, F.transform(steps, lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator)))


def unshadowed(latest: DataFrame, separator: str, solid: Column | None = None) -> DataFrame:
    """Drop paths overwritten as a whole by a later write above or below them.

    A scalar set later at an ancestor replaces the subtree; a leaf set later
    below a scalar turns it into an object. Both rules meet only at paths that
    are a leaf and an ancestor at once, so those, mostly few, are found first.
    Rows that are not ``solid`` stand for a subtree: they neither replace leaves below them nor give way to them.
    """
    nothing = F.lit(None).cast(latest.schema["at"].dataType)
    climbs = latest.select("path", "at", F.explode(prefixes(F.col("path"), separator)).alias("above"))
    scalars = latest if solid is None else latest.where(solid)
    both = (
        scalars.select(F.col("path").alias("above"), F.col("at").alias("own_at"), nothing.alias("below_at"))
        .unionByName(climbs.select("above", nothing.alias("own_at"), F.col("at").alias("below_at")))
        .groupBy("above")
        .agg(F.max("own_at").alias("own_at"), F.max("below_at").alias("below_at"))
        .where("own_at IS NOT NULL AND below_at IS NOT NULL")
    )
    overridden = both.where("below_at > own_at").select(F.col("above").alias("path"))
    cut_off = climbs.join(both.select("above", "own_at"), "above").where("own_at > at").select("path").distinct()
    return latest.join(overridden.unionByName(cut_off), "path", "left_anti")


def layered_latest(leaves: DataFrame) -> DataFrame:
    """``path, value, at`` of the last leaf per path, by ``at``."""
    return leaves.groupBy("path").agg(F.max_by("value", "at").alias("value"), F.max("at").alias("at"))


def layered_resolve(leaves: DataFrame, separator: str = ".") -> DataFrame:
    """The value of each path once all layers are merged. NULL counts as unset.

    The layers are read once: the latest leaf per path is written to the shared
    folder, and conflicts are looked for among those.
    """
    latest = layered_latest(leaves.where(F.col("value").isNotNull()).withColumn("at", F.struct("layer", "seq")))
    return unshadowed(cut_lineage(latest), separator).select("path", "value", F.col("at.layer").alias("layer"))


def layered_lists(entries: DataFrame, separator: str = ".") -> DataFrame:
    """Elements of each list path: those of its last ``set`` and of the appends after it.

    ``entries`` holds ``(layer, seq, path, values array, op)`` with op ``set`` or
    ``append``. Elements come as rows ordered by (layer, seq, pos), so a list
    fed by very many appends is never gathered into one row or task.
    """
    at = F.struct("layer", "seq")
    last = entries.groupBy("path").agg(
        F.max(at).alias("at"), F.max(F.when(F.col("op") == "set", at)).alias("set_at")
    )
    kept = unshadowed(cut_lineage(last), separator).select("path", "set_at")
    return (
        spread_join(entries.withColumn("_at", at), kept, ["path"], ["layer", "seq"])
        .where(F.col("set_at").isNull() | (F.col("_at") >= F.col("set_at")))
        .select("path", "layer", "seq", F.posexplode("values").alias("pos", "value"))
    )
