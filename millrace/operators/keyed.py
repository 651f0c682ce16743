"""Keyed tables: scans, upserts, write batches, deletes, and table lifecycle."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.constants import SCAN_LIMIT
from millrace.hooks import Predicate, as_condition
from millrace.operators.ranking import latest_by, numbered
from millrace.session import cut_lineage
from millrace.sources.versions import VersionLog
from millrace.sources.writers import open_uri

BUCKET = "bucket__"


# -- reading -------------------------------------------------------------------

def scan_where(table: DataFrame, where: Predicate | None = None) -> DataFrame:
    """All rows, or those a predicate accepts; the filter reaches the file scan."""
    return table if where is None else table.where(as_condition(where))


def scan_limit(table: DataFrame, keys: Sequence[str], limit: int = SCAN_LIMIT) -> DataFrame:
    """The first rows by primary key: each task keeps ``limit`` rows at most."""
    return table.orderBy(*keys).limit(limit)


# -- writing -------------------------------------------------------------------

def upsert_by_key(
    table: DataFrame,
    updates: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] = ("write_ts",),
) -> DataFrame:
    """Insert or replace by primary key; the row latest by ``order`` wins.

    ``table`` has one row per key already, so only the updates are reduced; the
    table itself is shuffled and sorted once, by the join.
    """
    old = table.withColumn("_here", F.lit(True)).alias("old")
    new = latest_by(updates, keys, order).withColumn("_here", F.lit(True)).alias("new")
    old_at, new_at = F.struct(*[f"old.{c}" for c in order]), F.struct(*[f"new.{c}" for c in order])
    takes_new = F.col("new._here").isNotNull() & (F.col("old._here").isNull() | (new_at >= old_at))
    values = [
        F.when(takes_new, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)
        for c in table.columns
        if c not in keys
    ]
    return old.join(new, list(keys), "full").select(*keys, *values).select(*table.columns)


def upsert_columns(
    table: DataFrame,
    updates: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] = ("write_ts",),
) -> DataFrame:
    """Upsert that leaves a column as it was where an update does not supply it."""
    rows = table.unionByName(updates, allowMissingColumns=True)
    newest = F.struct(*order)
    values = [c for c in rows.columns if c not in keys]
    merged = [F.max_by(c, F.when(F.col(c).isNotNull(), newest)).alias(c) for c in values]
    return rows.groupBy(*keys).agg(*merged).select(*rows.columns)


def assign_batches(rows: DataFrame, batch_size: int, arrival: str, writer: Sequence[str] = ()) -> DataFrame:
    """Number the flush batch of each row: ``batch_size`` rows each, the tail included."""
    placed = numbered(rows, writer, arrival, "_place", start=0)
    return placed.withColumn("batch_no", F.floor(F.col("_place") / batch_size)).drop("_place")


def write_batches(rows: DataFrame, path: str, batch_size: int, mode: str = "append") -> None:
    """Write files of at most ``batch_size`` rows, each task flushing its own tail."""
    rows.write.mode(mode).option("maxRecordsPerFile", batch_size).parquet(path)


def delete_by_key(table: DataFrame, deleted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that remain once the given primary keys are gone.

    A key deleted very often is first reduced to one, since a join cannot split
    the side it looks up.
    """
    return table.join(deleted.select(*keys).distinct(), list(keys), "left_anti")


# -- lifecycle -----------------------------------------------------------------

def list_keyspaces(spark: SparkSession) -> list[str]:
    return [d.name for d in spark.catalog.listDatabases()]


def create_keyspace(spark: SparkSession, keyspace: str, location: str | None = None) -> None:
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{keyspace}`{where}")


def create_table(
    spark: SparkSession,
    keyspace: str,
    name: str,
    columns: str,
    partition_by: Sequence[str] = (),
    location: str | None = None,
) -> None:
    """Create keyspace and table if absent; ``columns`` is DDL text."""
    create_keyspace(spark, keyspace)
    parts = f" PARTITIONED BY ({', '.join(partition_by)})" if partition_by else ""
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{keyspace}`.`{name}` ({columns}) USING parquet{parts}{where}")


def drop_table(spark: SparkSession, keyspace: str, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS `{keyspace}`.`{name}`")


def drop_keyspace(spark: SparkSession, keyspace: str) -> bool:
    """Drop a keyspace and its tables if it is listed; say whether it was."""
    if keyspace not in list_keyspaces(spark):
        return False
    spark.sql(f"DROP DATABASE `{keyspace}` CASCADE")
    return True


def reset_keyspace(spark: SparkSession, keyspace: str, location: str | None = None) -> None:
    """Drop a keyspace if there, and make it anew, empty."""
    drop_keyspace(spark, keyspace)
    create_keyspace(spark, keyspace, location)


def reset_all_keyspaces(spark: SparkSession, keyspaces: Sequence[str]) -> None:
    for keyspace in keyspaces:
        reset_keyspace(spark, keyspace)


def clear_keyspace(spark: SparkSession, keyspace: str) -> list[str]:
    """Drop every table of the keyspace named, and of no other."""
    names = [t.name for t in spark.catalog.listTables(keyspace) if not t.isTemporary]
    for name in names:
        drop_table(spark, keyspace, name)
    return names


def table_catalog(spark: SparkSession, keyspaces: Sequence[str] | None = None) -> DataFrame:
    """Tables of the keyspaces with their columns and types."""
    rows = [
        (keyspace, t.name, i, c.name, c.dataType)
        for keyspace in (keyspaces if keyspaces is not None else list_keyspaces(spark))
        for t in spark.catalog.listTables(keyspace)
        if not t.isTemporary
        for i, c in enumerate(spark.catalog.listColumns(f"`{keyspace}`.`{t.name}`"))
    ]
    return spark.createDataFrame(
        rows, "keyspace string, table_name string, position int, column_name string, type string"
    )


def describe_keyspace(spark: SparkSession, keyspace: str) -> DataFrame:
    return spark.sql(f"DESCRIBE DATABASE EXTENDED `{keyspace}`")


def frame_catalog(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Columns and row counts of the given tables."""
    spark = next(iter(frames.values())).sparkSession
    columns = spark.createDataFrame(
        [(name, i, f.name) for name, df in frames.items() for i, f in enumerate(df.schema.fields, 1)],
        "table_name string, position int, column_name string",
    )
    counts = reduce(
        DataFrame.unionByName,
        [df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("table_name", F.lit(n)) for n, df in frames.items()],
    )
    return columns.join(counts, "table_name")


class KeyedTable:
    """A keyed table in hash buckets, whose upserts rewrite only the buckets they touch.

    A version names the folder of each bucket. An upsert or delete reads
    and writes the buckets of its keys, and then switches to a version that names the new
    folders beside the old ones of all others, so a reader sees the old rows or the new
    ones, never half of either. Folders of earlier versions stay for their readers until ``vacuum``.
    Everything lies below ``root``, which every executor must reach; the driver
    holds one name per bucket. The catalog has the name and the types of the table; its rows are those of ``read``.
    The number of buckets is fixed when the table is created: take so many that a bucket is a task's work.
    """

    def __init__(self, spark: SparkSession, keyspace: str, name: str, keys: Sequence[str], root: str, buckets: int = 64):
        self.spark, self.keys, self.buckets = spark, list(keys), buckets
        self.keyspace, self.name = keyspace, name
        self.full_name = f"`{keyspace}`.`{name}`"
        self.root = root.rstrip("/")
        self.log = VersionLog(spark, f"{self.root}/versions")

    def create(self, columns: str) -> None:
        """Create keyspace and table if absent; a table that is there keeps its rows and its buckets."""
        create_table(self.spark, self.keyspace, self.name, columns, location=f"{self.root}/catalog")
        number, names = self.log.current()
        if not number:
            self.log.commit(1, {"label": "", "buckets": str(self.buckets)})
        else:
            self.buckets = int(names["buckets"])

    def read(self) -> DataFrame:
        return self._rows(self._folders().values())

    def upsert(self, updates: DataFrame, version: str, order: Sequence[str] = ("write_ts",)) -> None:
        """Merge the updates and switch to ``version``; safe to repeat."""
        if self._label() != version:
            new = cut_lineage(latest_by(updates, self.keys, order))
            self._switch(new, lambda old: upsert_by_key(old, new, self.keys, order), version)

    def delete(self, deleted: DataFrame, version: str) -> None:
        if self._label() != version:
            gone = cut_lineage(deleted.select(*self.keys).distinct())
            self._switch(gone, lambda old: delete_by_key(old, gone, self.keys), version)

    def vacuum(self, keep: int = 2) -> int:
        """Delete the folders that none of the latest ``keep`` versions names; how many were deleted."""
        used = self.log.values(keep)
        system, base = open_uri(f"{self.root}/data")
        n = 0
        for run in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            for bucket in system.get_file_info(fs.FileSelector(run.path)):
                if bucket.type == fs.FileType.Directory and f"{run.base_name}/{bucket.base_name}" not in used:
                    system.delete_dir(bucket.path)
                    n += 1
        return n

    def _label(self) -> str | None:
        return self.log.current()[1].get("label")

    def _folders(self) -> dict[int, str]:
        return {int(k): v for k, v in self.log.current()[1].items() if k.isdigit()}

    def _rows(self, folders) -> DataFrame:
        paths = [f"{self.root}/data/{f}" for f in folders]
        schema = self.spark.table(self.full_name).schema
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def _switch(self, changed: DataFrame, merge: Callable[[DataFrame], DataFrame], version: str) -> None:
        number, _ = self.log.current()
        folders = self._folders()
        touched = {r[0] for r in changed.select(self._bucket()).distinct().collect()}  # as many as buckets at most
        rows = merge(self._rows(folders[b] for b in touched if b in folders))
        run = f"{number + 1}-{uuid.uuid4().hex[:12]}"  # a run that failed leaves a folder that nothing names
        target = f"{self.root}/data/{run}"
        rows.withColumn(BUCKET, self._bucket()).repartition(BUCKET).write.partitionBy(BUCKET).parquet(target)
        written = self.spark.read.schema(f"{BUCKET} int").parquet(target).select(BUCKET).distinct().collect()
        now = {b: f for b, f in folders.items() if b not in touched} | {r[0]: f"{run}/{BUCKET}={r[0]}" for r in written}
        self.log.commit(number + 1, {"label": version, "buckets": str(self.buckets)} | {str(b): f for b, f in now.items()})
