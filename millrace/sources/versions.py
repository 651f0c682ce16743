"""Versions of a small table of names and folders, switched at once.

Each version is one file, which Spark's committer renames into place, so a reader
sees it as a whole or not at all; the highest number counts. It works on any store
that Spark writes to. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "name string, value string, version long"


class VersionLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _rows(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def current(self) -> tuple[int, dict[str, str]]:
        """Number and names of the newest version; 0 and none before the first."""
        rows = self._rows()
        number = rows.agg(F.max("version")).first()[0] if rows is not None else None
        if number is None:
            return 0, {}
        return number, {r["name"]: r["value"] for r in rows.where(F.col("version") == number).collect()}

    def commit(self, number: int, names: Mapping[str, str]) -> None:
        """Write version ``number``, one more than the newest; nothing is visible of it until it is whole."""
        rows = self.spark.createDataFrame(sorted(names.items()), "name string, value string").coalesce(1)
        rows.write.mode("overwrite").parquet(f"{self.path}/version={number}")

    def values(self, newest: int) -> set[str]:
        """All values of the ``newest`` latest versions."""
        rows = self._rows()
        if rows is None:
            return set()
        number, _ = self.current()
        return {r["value"] for r in rows.where(F.col("version") > number - newest).select("value").distinct().collect()}
