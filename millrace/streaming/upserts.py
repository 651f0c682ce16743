"""Streaming upserts: one reduced delta per micro-batch, merged when read, and folded into a base now and then."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.hooks import BatchHandler
from millrace.operators.ranking import latest_by
from millrace.sources.versions import VersionLog
from millrace.sources.writers import open_uri

Prepare = Callable[[DataFrame], DataFrame]
MOST_DELTAS = 32


def _state(spark: SparkSession, path: str) -> tuple[int, str | None, int]:
    """Number of the version, its base folder, and the last micro-batch that the base holds."""
    number, names = VersionLog(spark, f"{path}/versions").current()
    return number, names.get("base"), int(names.get("upto", -1))


def delta_writer(
    path: str, keys: Sequence[str], order: Sequence[str], prepare: Prepare | None = None, most_deltas: int = MOST_DELTAS
) -> BatchHandler:
    """A handler that writes the latest row per key of a micro-batch to its own folder.

    A repeated micro-batch replaces the same folder, or is skipped if the base holds it already, so
    a failure in between changes nothing. Whenever half of ``most_deltas`` have come since the
    base was made, they are merged with it into a new one, to which a version then points; the deltas of the base before stay
    for its readers until the next time. So there are never more than ``most_deltas`` of them, and two bases.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        _, _, upto = _state(spark, path)
        if batch_id <= upto:
            return
        rows = batch if prepare is None else prepare(batch)
        latest_by(rows, keys, order).write.mode("overwrite").parquet(f"{path}/deltas/batch_id={batch_id}")
        if batch_id - upto >= max(1, most_deltas // 2):
            compact(spark, path, keys, order, batch_id)

    return write


def current_rows(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The latest row per key over the base and the deltas since."""
    _, base, upto = _state(spark, path)
    try:
        rows = spark.read.parquet(f"{path}/deltas").where(F.col("batch_id") > upto).drop("batch_id")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND" or base is None:
            raise
        rows = None
    if base is not None:
        whole = spark.read.parquet(f"{path}/bases/{base}")
        rows = whole if rows is None else whole.unionByName(rows)
    return latest_by(rows, keys, order)


def compact(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str], batch_id: int) -> None:
    """Write the merged rows up to a micro-batch as a new base, point to it, and delete what the base before has merged."""
    number, before, merged = _state(spark, path)
    base = f"{batch_id}-{uuid.uuid4().hex[:12]}"
    current_rows(spark, path, keys, order).write.parquet(f"{path}/bases/{base}")
    VersionLog(spark, f"{path}/versions").commit(number + 1, {"base": base, "upto": str(batch_id)})
    system, place = open_uri(path)
    for folder in system.get_file_info(fs.FileSelector(f"{place}/deltas")):
        name, _, value = folder.base_name.partition("=")
        if name == "batch_id" and int(value) <= merged:
            system.delete_dir(folder.path)
    for folder in system.get_file_info(fs.FileSelector(f"{place}/bases")):
        if folder.type == fs.FileType.Directory and folder.base_name not in (base, before):
            system.delete_dir(folder.path)
