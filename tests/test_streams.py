"""Streams against their batch forms, over several files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.hooks import as_condition, chain_handlers
from millrace.operators import messages, status
from millrace.sources import topics
from millrace.streaming import upserts, waits
from millrace.streaming.runs import ProgressLog, run_handler, run_to_files


@pytest.fixture
def parts(spark, sf_dir, tmp_path):
    """The events in five files, in order of time."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    last = events.agg(F.max("event_id")).first()[0]
    for i in range(5):
        part = events.where(F.col("event_id").between(last * i // 5 + (i > 0), last * (i + 1) // 5))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def stream_of(spark, path, files_per_trigger=1):
    return topics.file_stream(spark, path, spark.read.parquet(path).schema, files_per_trigger)


def rows(df):
    return sorted(map(repr, df.collect()))


def test_subscription_reads_all_topics_once(spark, parts, tmp_path):
    named = spark.read.parquet(parts).withColumnRenamed("event_type", "topic")
    schema = spark.read.parquet(parts).schema
    stream = stream_of(spark, parts).withColumnRenamed("event_type", "topic")
    chosen = topics.choose_topics(["click", "view"])
    for _ in range(2):
        run_to_files(stream.where(F.col("topic").isin(chosen)), f"{tmp_path}/out", f"{tmp_path}/check")
    got = spark.read.parquet(f"{tmp_path}/out").select("event_id")
    assert rows(got) == rows(named.where(F.col("topic").isin(chosen)).select("event_id"))
    assert topics.choose_topics(["click"], "error") == ["error"]
    assert "topic" not in schema.names


def test_one_file_at_a_time_commits_after_the_task(spark, parts, tmp_path):
    seen = []

    def failing(batch, batch_id):
        if len(seen) == 2:
            raise RuntimeError("task failed")
        seen.append((batch_id, batch.count()))

    with pytest.raises(Exception, match="task failed"):
        run_handler(stream_of(spark, parts), failing, f"{tmp_path}/check")
    again = []
    run_handler(stream_of(spark, parts), lambda b, i: again.append((i, b.count())), f"{tmp_path}/check")
    assert [i for i, _ in seen] == [0, 1] and [i for i, _ in again] == [2, 3, 4]
    assert sum(n for _, n in seen + again) == spark.read.parquet(parts).count()


def test_upserts_survive_a_repeated_batch(spark, parts, tmp_path):
    keys, order = ["user_id", "event_type"], ["event_id"]
    stream = stream_of(spark, parts).select("user_id", "event_type", "event_id", "props")
    writer = upserts.delta_writer(f"{tmp_path}/rows", keys, order)

    def twice(batch, batch_id):
        writer(batch, batch_id)
        writer(batch, batch_id)

    run_handler(stream, twice, f"{tmp_path}/check")
    want = (
        spark.read.parquet(parts)
        .groupBy("user_id", "event_type")
        .agg(F.max("event_id").alias("event_id"), F.max_by("props", "event_id").alias("props"))
    )
    got = upserts.current_rows(spark, f"{tmp_path}/rows", keys, order)
    assert rows(got.select(*want.columns)) == rows(want)


def test_deltas_stay_few_in_a_long_stream(spark, tmp_path):
    """A hundred micro-batches: deltas and bases stay within the bound, and a micro-batch that is repeated later changes nothing."""
    keys, order, path = ["k"], ["seq"], f"{tmp_path}/rows"
    writer = upserts.delta_writer(path, keys, order, most_deltas=8)
    batch = lambda i: spark.createDataFrame([(i % 7, i, f"v{i}"), (i % 7, i - 50, "old"), (100 + i, i, "own")], "k long, seq long, v string")
    most = 0
    for i in range(100):
        writer(batch(i), i)
        most = max(most, len(list((tmp_path / "rows" / "deltas").glob("batch_id=*"))))
    assert most <= 8 and len(list((tmp_path / "rows" / "bases").iterdir())) <= 2
    want = {(i % 7, i, f"v{i}") for i in range(93, 100)} | {(100 + i, i, "own") for i in range(100)}
    assert {tuple(r) for r in upserts.current_rows(spark, path, keys, order).collect()} == want
    for i in (3, 98, 99):
        writer(batch(i), i)
    assert {tuple(r) for r in upserts.current_rows(spark, path, keys, order).collect()} == want


def readiness(df):
    return df.select(F.col("user_id").alias("resource"), "at", (F.col("event_type") == "purchase").alias("ready"))


@pytest.mark.parametrize("timeout_first", [False, True])
def test_ready_stream_equals_batch(spark, parts, tmp_path, timeout_first):
    """Files in any order, users that come late or never get ready: the answers of the batch form, and no state is left."""
    settings = {"unit": 60_000_000, "timeout_first": timeout_first}
    whole = readiness(spark.read.parquet(parts)).withColumn("resource", F.col("resource").cast("string"))
    last = whole.agg(F.max("at")).first()[0]
    late = spark.createDataFrame([("late", last - 1, False), ("late", last, True), ("never", last, False)], whole.schema)
    shuffled = whole.union(late).withColumn("n", F.pmod(F.xxhash64("resource", "at"), F.lit(5)))
    for n in range(5):
        shuffled.where(F.col("n") == n).drop("n").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = topics.file_stream(spark, f"{tmp_path}/in", whole.schema, 1)
    queries = []
    waits.run_and_close(
        spark, stream, f"{tmp_path}/markers", lambda s: queries.append(run_to_files(s, f"{tmp_path}/out", f"{tmp_path}/check")),
        lambda p: waits.wait_until_ready_stream(p, "10000 days", **settings),
    )
    want = status.wait_until_ready(whole.union(late), **settings)
    assert rows(spark.read.parquet(f"{tmp_path}/out").select(*want.columns)) == rows(want)
    assert queries[-1].lastProgress.stateOperators[0].numRowsTotal == 0


def test_marks_of_ended_waits_go(spark, tmp_path):
    """With a time to keep them, marks of ended waits do not pile up while the stream goes on."""
    schema = "resource string, at long, ready boolean"
    for step in range(6):
        data = [(f"r{step}-{i}", (1 + step) * 10_000_000_000 + i, True) for i in range(20)]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = topics.file_stream(spark, f"{tmp_path}/in", schema, 1)
        query = run_to_files(waits.wait_until_ready_stream(stream, "1 second", keep_ms=5_000), f"{tmp_path}/out", f"{tmp_path}/check")
        assert query.lastProgress.stateOperators[0].numRowsTotal <= 20 * 2 * 3
    assert spark.read.parquet(f"{tmp_path}/out").count() >= 100


def test_state_is_per_bucket_and_not_per_wait(spark, tmp_path, monkeypatch):
    """Waits that start, get ready and end in different batches: few states and timers, and the answers of the batch form."""
    monkeypatch.setattr(waits, "BUCKETS", 4)
    schema, data = "resource string, at long, ready boolean", []
    for step in range(4):
        rows_ = [(f"r{i}", (1_000 + 150 * step + i % 90) * 1_000_000, step == i % 5) for i in range(400) if i % 4 <= step]
        data += rows_
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    states = []

    def run(stream):
        query = run_to_files(stream, f"{tmp_path}/out", f"{tmp_path}/check")
        states.extend(p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators)

    stream = topics.file_stream(spark, f"{tmp_path}/in", schema, 1)
    waits.run_and_close(spark, stream, f"{tmp_path}/markers", run, lambda p: waits.wait_until_ready_stream(p, "200 seconds"))
    want = status.wait_until_ready(spark.createDataFrame(data, schema))
    assert rows(spark.read.parquet(f"{tmp_path}/out").select(*want.columns)) == rows(want)
    assert 0 < max(states) <= 4 * 4 and states[-1] == 0  # a state, a timer and its index entry per bucket


def test_a_wait_stays_open_until_the_watermark_passes(spark, tmp_path):
    """One resource ready late, one never: nothing is decided before a sentinel row."""
    schema = "resource string, at long, ready boolean"

    def put(*data):
        spark.createDataFrame(list(data), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        stream = topics.file_stream(spark, f"{tmp_path}/in", schema, 1)
        run_to_files(waits.wait_until_ready_stream(stream, "0 seconds"), f"{tmp_path}/out", f"{tmp_path}/check")
        return {r.resource: (r.verdict, r.waited) for r in spark.read.schema(
            "resource string, verdict string, waited long").parquet(f"{tmp_path}/out").collect()}

    def at(second):
        return (1_000 + second) * 1_000_000

    put(("never", at(0), False), ("late", at(0), False), ("soon", at(0), False), ("soon", at(7), True))
    assert run() == {"soon": ("READY", 10)}  # an earlier ready row would be late now
    put(("other", at(100), True))
    assert set(run()) == {"soon", "other"}
    put(("late", at(403), True), ("never", at(404), False))
    put(("sentinel", at(10_000), False), ("never", at(9_000), True))
    done = run()
    assert done["late"] == ("READY", 405) and done["never"] == ("TIMEOUT", 405) and "sentinel" not in done


def test_progress_of_each_batch_is_kept(spark, parts, tmp_path):
    log = ProgressLog()
    spark.streams.addListener(log)
    try:
        query = run_to_files(stream_of(spark, parts), f"{tmp_path}/out", f"{tmp_path}/check")
        log.wait_for(query)
    finally:
        spark.streams.removeListener(log)
    frame = log.to_frame(spark, query)
    assert frame.agg(F.sum("num_input_rows")).first()[0] == spark.read.parquet(parts).count()
    assert frame.where("num_input_rows > 0").count() == 5
    with pytest.raises(TimeoutError):
        ProgressLog().wait_for(query, 0.01)
    log.forget(query)
    assert log.to_frame(spark, query).count() == 0


def test_connector_options():
    read = topics.read_options("h:9092", ["a", "b"], "g")
    assert read["subscribe"] == "a,b" and read["startingOffsets"] == "earliest" and read["kafka.group.id"] == "g"
    groups = {"monitor": "m", "a": "x"}
    assert [topics.choose_group(groups), topics.choose_group(groups, "a"), topics.choose_group(groups, "a", "o")] == [
        "m", "x", "o",
    ]
    assert topics.write_options("h:9092")["kafka.max.request.size"] == "15048576"


def test_null_key_decodes_to_null(spark):
    frame = spark.createDataFrame(
        [("t", 0, 7, None, bytearray(b"v"))], "topic string, partition int, offset long, key binary, value binary"
    )
    row = messages.decode_record(frame).first()
    assert (row.partition, row.offset, row.key, row.value) == (0, 7, None, "v")


def test_delivery_is_counted_while_writing(spark, tmp_path):
    from pyspark.sql import Observation

    seen = Observation("delivery")
    frame = spark.createDataFrame([("t", "k", "v" * n) for n in (1, 5, 50)], "topic string, key string, value string")
    catalog = messages.topics_frame(spark, [messages.Topic("t", config={"max_message_bytes": "10"})])
    guarded = messages.observe_delivery(messages.size_guard(frame, catalog), seen)
    guarded.write.parquet(f"{tmp_path}/sent")
    assert seen.get == {"delivered": 2, "failed": 1, "bytes_delivered": 8}


def test_hooks(spark):
    frame = spark.range(10)
    assert frame.where(as_condition(lambda c: c > 7, F.col("id"))).count() == 2
    assert frame.where(as_condition(None)).count() == 10
    calls = []
    chain_handlers(lambda b, i: calls.append(b.count()), lambda b, i: calls.append(i))(frame, 3)
    assert calls == [10, 3]
