"""Waits as streams: a wait stays open until its answer can no longer change, and every wait gets an answer.

Waits are dealt to buckets by a hash; a bucket is one small table of waits in the state, with one event-time timer for
whichever of them ends first, so a batch reads and writes a state per bucket and not per wait. When the watermark passes the
end of a wait its answer is given and a mark stays that it is over, until its
time is over too. At the end of a source a marker row moves the
watermark behind all ends: open waits are answered as the batch forms answer
them, and no state is left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.constants import FILE_MAX_POLLS, READY_INTERVAL, READY_TIMEOUT
from millrace.operators.status import file_verdict, ready_verdict

SEEN = "resource string, start long, ready_at long, ts timestamp"
WAIT = "resource string, start long, ready_at long"
STATE = "waits binary, timer long"
BUCKETS = 512  # part of the checkpoint of a stream, which deals its waits by it
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Times of real rows lie before the first of these; a marker row carries the second.
CLEAR_MS = int(datetime(2200, 1, 1, tzinfo=timezone.utc).timestamp() * 1000)
MARKER_US = int(datetime(2261, 1, 1, tzinfo=timezone.utc).timestamp() * 1_000_000)


def _reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """First row, first ready row and newest time per resource of each Arrow batch."""
    for batch in batches:
        batch["ready_at"] = batch["at"].where(batch["ready"].fillna(False).astype(bool)).astype("Int64")
        seen = batch.groupby("resource", sort=False, as_index=False, dropna=False).agg(
            start=("at", "min"), ready_at=("ready_at", "min"), ts=("at", "max")
        )
        seen["ts"] = pd.to_datetime(seen["ts"], unit="us")
        yield seen[["resource", "start", "ready_at", "ts"]]


def _packed(waits: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(waits, preserve_index=False)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as stream:
        stream.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(pa.py_buffer(bytes(data))).read_all().to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)


class _Waits(StatefulProcessor):
    """The waits of a bucket: ``resource, start, ready_at, clear``; ``clear`` is NULL while a wait is open, then the time in ms to which its mark is kept."""

    def __init__(self, limit: int, keep_ms: int | None):
        self.limit, self.keep_ms = limit, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("waits", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None:
            return  # markers
        seen = pd.concat([frame[["resource", "start", "ready_at"]].astype({"start": "Int64", "ready_at": "Int64"}) for frame in rows])
        held = self.state.get()
        waits, timer = (None, None) if held is None else (_unpacked(held[0]), held[1])
        if waits is not None:
            over = waits["clear"].notna()
            closed = waits[over]
            seen = pd.concat([waits.loc[~over, ["resource", "start", "ready_at"]], seen[~seen["resource"].isin(closed["resource"])]])
        opened = seen.groupby("resource", sort=False, as_index=False).agg(start=("start", "min"), ready_at=("ready_at", "min"))
        opened["clear"] = pd.Series(pd.NA, index=opened.index, dtype="Int64")
        yield from self._settled(opened if waits is None else pd.concat([closed, opened]), timer, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        # a timer that the rows of this batch have replaced counts no more
        if held is not None and held[1] == expiredTimerInfo.getExpiryTimeInMs():
            yield from self._settled(_unpacked(held[0]), None, timerValues)

    def _settled(self, waits: pd.DataFrame, timer: int | None, timerValues) -> Iterator[pd.DataFrame]:
        """The answers of the waits that are over by now; the others go back into the state, with a timer for the first that ends."""
        now = timerValues.getCurrentWatermarkInMs()
        last = waits["start"] + self.limit
        end = -(-waits["ready_at"].fillna(last).where(lambda r: r <= last, last) // 1000)
        until = waits["clear"].fillna(end)
        passed = (until <= now).astype(bool)  # rows of that time would be late
        answered = waits[passed & waits["clear"].isna()]
        clear = CLEAR_MS if self.keep_ms is None else min(CLEAR_MS, now + self.keep_ms)
        left, first = waits[~passed], until[~passed].min()
        if len(answered) and now < clear:
            left = pd.concat([left, answered.assign(clear=pd.Series(clear, index=answered.index, dtype="Int64"))])
            first = clear if pd.isna(first) else min(first, clear)
        upcoming = int(first) if len(left) else None
        if timer is not None and timer != upcoming:
            self.handle.deleteTimer(timer)
        if upcoming is None:
            self.state.clear()
        else:
            self.state.update((_packed(left), upcoming))
            if timer != upcoming:
                self.handle.registerTimer(upcoming)
        if len(answered):
            yield answered[["resource", "start", "ready_at"]].reset_index(drop=True)


def closed_waits(polls: DataFrame, limit: int, delay: str, keep_ms: int | None = None) -> DataFrame:
    """One row per resource once its wait is over: start and first ready time.

    ``polls`` is a stream of (resource, at in microseconds, ready). Rows are
    reduced per resource before they are shuffled, so a busy resource sends few.
    A wait closes when the watermark has passed its first ready row, or
    ``limit`` microseconds after its start; until then rows that are late by
    less than ``delay`` still count. ``delay`` must cover the disorder of the source: rows that are later are dropped, as with any watermark.
    That a wait is over is remembered for ``keep_ms`` milliseconds of event time, so that
    the resource does not open another one, or until the marker. Rows without a resource are markers (``marker_rows``).
    """
    spark = polls.sparkSession
    if spark.conf.get(PROVIDER, None) is None:  # states with timers need this one
        spark.conf.set(PROVIDER, ROCKSDB)
    return (
        polls.where("at IS NOT NULL").select(F.col("resource").cast("string"), "at", F.col("ready").cast("boolean"))
        .mapInPandas(_reduce, SEEN)
        .withWatermark("ts", delay)
        .withColumn("bucket", F.when(F.col("resource").isNotNull(), F.pmod(F.xxhash64("resource"), F.lit(BUCKETS)).cast("int")))
        .groupBy("bucket")
        .transformWithStateInPandas(_Waits(limit, keep_ms), WAIT, "Append", "EventTime")
    )


def marker_rows(spark: SparkSession) -> DataFrame:
    """The row that ends a source of waits: once it has been read, every open wait is answered and no state is left."""
    return spark.createDataFrame([(None, MARKER_US, False)], "resource string, at long, ready boolean")


def with_markers(polls: DataFrame, folder: str) -> DataFrame:
    """``polls`` and the markers that come to lie in ``folder`` (parquet files)."""
    markers = polls.sparkSession.readStream.schema("resource string, at long, ready boolean").parquet(folder)
    return polls.select(F.col("resource").cast("string"), "at", "ready").unionByName(markers)


def run_and_close(spark: SparkSession, polls: DataFrame, folder: str, run: Callable[[DataFrame], object], answers: Callable[[DataFrame], DataFrame]) -> None:
    """Read the source to its end, then put the marker into ``folder`` and go on from the same checkpoint: all waits are answered.

    ``run`` starts and awaits a query over the frame it gets, always with the same checkpoint; ``answers`` makes waits of polls.
    """
    marker_rows(spark).limit(0).write.mode("overwrite").parquet(folder)
    run(answers(with_markers(polls, folder)))
    marker_rows(spark).write.mode("append").parquet(folder)
    run(answers(with_markers(polls, folder)))


def wait_until_ready_stream(
    polls: DataFrame,
    delay: str,
    unit: int = 1_000_000,
    timeout: int = READY_TIMEOUT,
    interval: int = READY_INTERVAL,
    timeout_first: bool = False,
    keep_ms: int | None = None,
) -> DataFrame:
    """Streaming form of ``wait_until_ready``: same rows, each as soon as it is certain."""
    waits = closed_waits(polls, (timeout + interval) * unit, delay, keep_ms)
    verdict = ready_verdict(F.col("start"), F.col("ready_at"), unit, timeout, interval, timeout_first)
    return waits.select("resource", verdict.alias("_v")).select("resource", "_v.*")


def wait_for_file_stream(
    arrivals: DataFrame,
    delay: str,
    unit: int = 1_000_000,
    interval: int = READY_INTERVAL,
    max_polls: int = FILE_MAX_POLLS,
    keep_ms: int | None = None,
) -> DataFrame:
    """Streaming form of ``wait_for_file`` over (resource = path, at, ready = arrived): the first row of a path opens its wait."""
    waits = closed_waits(arrivals, max_polls * interval * unit, delay, keep_ms)
    verdict = file_verdict(F.col("start"), F.col("ready_at"), unit, interval, max_polls)
    return waits.select(F.col("resource").alias("path"), verdict.alias("_v")).select("path", "_v.*")
