"""Helpers of operators whose tasks work on Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Columns = Mapping[str, Sequence]

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def to_schema(schema: str | T.StructType) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def record_batch(columns: Columns, schema: pa.Schema) -> pa.RecordBatch:
    """A batch of the given columns in the order and with the types of ``schema``."""
    arrays = [c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, type=f.type) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def bound_batches(spark: SparkSession, size: str = "8m") -> None:
    """Hand rows to tasks in batches of at most about ``size`` bytes (one row at least), unless the session says otherwise.

    Batches bounded by rows alone would hold as much as the longest texts do.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, size)


def release_memory() -> None:
    """Give memory that is free inside of this process back to the machine: workers live on, and go from stage to stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def _released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        yield from run(batches)
        release_memory()

    return task


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[Columns]], schema: str | T.StructType) -> DataFrame:
    """``fn`` gets one Arrow batch at a time and yields dictionaries of output columns."""
    bound_batches(df.sparkSession)
    kind = to_schema(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in fn(batch):
                yield record_batch(columns, arrow)

    return df.mapInArrow(_released(run), kind)


def map_task(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[Columns]], schema: str | T.StructType) -> DataFrame:
    """As ``map_batches``, but ``fn`` gets all batches of its task one after the other."""
    bound_batches(df.sparkSession)
    kind = to_schema(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in fn(batches):
            yield record_batch(columns, arrow)

    return df.mapInArrow(_released(run), kind)


def beside_rows(df: DataFrame, columns: Sequence[str], fn: Callable[..., Columns], schema: str) -> DataFrame:
    """All columns of ``df`` in a struct ``row``, beside the columns that ``fn`` finds from those named.

    One pass in which a value crosses to the task and back once; names in ``df`` never clash with the new ones.
    """
    bound_batches(df.sparkSession)
    found = to_schema(schema)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    places = [df.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(found)
        for batch in batches:
            row = batch.column(0)
            new = record_batch(fn(*(row.field(k) for k in places)), arrow)
            yield pa.RecordBatch.from_arrays([row, *new.columns], names=["row", *new.schema.names])

    return rows.mapInArrow(_released(run), T.StructType([*rows.schema.fields, *found.fields]))
