"""Queries that run a stream over the events file until it is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import messages, status
from millrace.plans.bindings import ACTIONS_SQL, MINUTE_US
from millrace.plans.registry import query, table
from millrace.plans.status import READY_SQL
from millrace.session import scratch_path
from millrace.sources.topics import choose_topics, file_stream
from millrace.streaming import upserts
from millrace.streaming.runs import ProgressLog, run_handler, run_to_files
from millrace.streaming.waits import run_and_close, wait_for_file_stream, wait_until_ready_stream


def _events(spark, sf_dir, files_per_trigger=None):
    schema = table(spark, sf_dir, "events").schema
    return file_stream(spark, sf_dir, schema, files_per_trigger, "events.parquet")


def _records(stream):
    return stream.select(
        F.col("event_type").alias("topic"),
        F.encode(F.col("user_id").cast("string"), "UTF-8").alias("key"),
        F.encode("props", "UTF-8").alias("value"),
        (F.col("user_id") % 4).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
    )


def _micros():
    return F.unix_micros(F.col("ts").cast("timestamp"))


def _through_files(spark, stream, label):
    path = scratch_path(spark, label)
    run_to_files(stream, f"{path}/rows", f"{path}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def _waits_to_the_end(spark, polls, answers, label):
    """Answers of all waits, of those that are open when the source ends too."""
    path = scratch_path(spark, label)
    run_and_close(spark, polls, f"{path}/markers", lambda stream: run_to_files(stream, f"{path}/rows", f"{path}/checkpoint"), answers)
    return spark.read.parquet(f"{path}/rows")


@query("stream_subscribe", """
SELECT event_type AS topic, CAST(user_id % 4 AS INTEGER) AS "partition", event_id AS "offset",
       CAST(user_id AS VARCHAR) AS key, props AS value
FROM events WHERE event_type IN ('click', 'view', 'purchase')
""")
def stream_subscribe(spark, sf_dir):
    topics = choose_topics(["click", "view", "purchase"])
    records = _records(_events(spark, sf_dir)).where(F.col("topic").isin(topics))
    return _through_files(spark, messages.decode_record(records), "subscribe")


@query("stream_subscribe_one", """
SELECT event_type AS topic, CAST(user_id % 4 AS INTEGER) AS "partition", event_id AS "offset",
       CAST(user_id AS VARCHAR) AS key, props AS value
FROM events WHERE event_type = 'error'
""")
def stream_subscribe_one(spark, sf_dir):
    topics = choose_topics(["click", "view", "purchase"], override="error")
    records = _records(_events(spark, sf_dir)).where(F.col("topic").isin(topics))
    return _through_files(spark, messages.decode_record(records), "subscribe")


@query("stream_upsert", """
SELECT CAST(user_id AS VARCHAR) AS key, event_type AS topic, arg_max(props, event_id) AS value,
       max(event_id) AS "offset"
FROM events GROUP BY user_id, event_type
""")
def stream_upsert(spark, sf_dir):
    """The newest message per key and topic, kept up to date by a stream."""
    path = scratch_path(spark, "upsert")
    keys, order = ["key", "topic"], ["offset"]
    stream = messages.decode_record(_records(_events(spark, sf_dir))).drop("partition")
    run_handler(stream, upserts.delta_writer(f"{path}/rows", keys, order), f"{path}/checkpoint")
    return upserts.current_rows(spark, f"{path}/rows", keys, order)


@query("one_at_a_time", "SELECT event_type AS topic, count(*) AS n_records FROM events GROUP BY event_type")
def one_at_a_time(spark, sf_dir):
    """One file per trigger, its task (a count per topic) done before the commit."""
    path = scratch_path(spark, "single")

    def task(batch, batch_id):
        counts = batch.groupBy("topic").agg(F.count(F.lit(1)).alias("n_records"))
        counts.write.mode("overwrite").parquet(f"{path}/rows/batch_id={batch_id}")

    run_handler(_records(_events(spark, sf_dir, files_per_trigger=1)), task, f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/rows").groupBy("topic").agg(F.sum("n_records").alias("n_records"))


@query("stream_stats", "SELECT count(*) AS num_input_rows FROM events")
def stream_stats(spark, sf_dir):
    """Rows read by a subscription, as its progress reports tell."""
    path = scratch_path(spark, "stats")
    log = ProgressLog()
    spark.streams.addListener(log)
    try:
        run = run_to_files(_records(_events(spark, sf_dir)), f"{path}/rows", f"{path}/checkpoint")
        log.wait_for(run)
    finally:
        spark.streams.removeListener(log)
    return log.to_frame(spark, run).agg(F.sum("num_input_rows").alias("num_input_rows"))


@query("wait_until_ready_stream", READY_SQL.format(last=405).replace("SELECT resource, CASE", "SELECT CAST(resource AS VARCHAR) AS resource, CASE"))
def wait_until_ready_by_stream(spark, sf_dir):
    polls = _events(spark, sf_dir).select(
        F.col("user_id").alias("resource"), _micros().alias("at"), (F.col("event_type") == "purchase").alias("ready")
    )
    return _waits_to_the_end(spark, polls, lambda p: wait_until_ready_stream(p, "1 day", unit=MINUTE_US), "ready")


@query("wait_for_file_stream", """
WITH seen AS (
  SELECT 'flags/' || user_id AS path, epoch_us(min(ts)) AS start,
         epoch_us(min(ts) FILTER (event_type = 'signup')) AS arrived
  FROM events GROUP BY user_id
),
tried AS (SELECT path, greatest((arrived - start + 1799999999) // 1800000000, 1) AS attempt, arrived FROM seen)
SELECT path, CASE WHEN arrived IS NOT NULL AND attempt <= 50 THEN 'FOUND' ELSE 'TIMEOUT' END AS status,
       CASE WHEN arrived IS NOT NULL AND attempt <= 50 THEN attempt END AS attempt
FROM tried
""")
def wait_for_file_by_stream(spark, sf_dir):
    arrivals = _events(spark, sf_dir).select(
        F.concat(F.lit("flags/"), "user_id").alias("resource"),
        _micros().alias("at"),
        (F.col("event_type") == "signup").alias("ready"),
    )
    return _waits_to_the_end(spark, arrivals, lambda p: wait_for_file_stream(p, "1 day", unit=MINUTE_US, interval=30), "files")


@query("wait_for_value_stream", f"""
WITH {ACTIONS_SQL},
waits AS (SELECT pod, name, min(at_us) AS start, max(value) AS expected FROM act GROUP BY pod, name),
polls AS (SELECT pod, name, expected, start, unnest(range(10)) AS poll FROM waits),
seen AS (
  SELECT p.pod, p.name, p.poll, p.expected, arg_max(a.value, a.seq) AS value
  FROM polls p JOIN act a ON a.pod = p.pod AND a.name = p.name AND a.at_us <= p.start + p.poll * 14400000000
  GROUP BY ALL
)
SELECT w.pod, w.name, w.expected, min(s.poll) FILTER (s.value = s.expected) AS poll,
       count(*) FILTER (s.value = s.expected) > 0 AS matched
FROM waits w JOIN seen s ON s.pod = w.pod AND s.name = w.name GROUP BY ALL
""")
def wait_for_value_by_stream(spark, sf_dir):
    """The batch query's waits, each poll's last value kept up to date by a stream."""
    path = scratch_path(spark, "value")
    named = table(spark, sf_dir, "events").where("event_type <> 'error'")
    waits = named.groupBy(F.col("user_id").alias("pod"), F.col("event_type").alias("name")).agg(
        F.min(_micros()).alias("start"), F.max(F.regexp_extract("props", "([0-9]+)", 1)).alias("expected")
    )
    actions = _events(spark, sf_dir).select(
        F.col("user_id").alias("pod"),
        F.col("event_type").alias("name"),
        F.regexp_extract("props", "([0-9]+)", 1).alias("value"),
        _micros().alias("at"),
        F.col("event_id").alias("seq"),
    )
    keys, order = [*status.WAIT_KEYS, "poll"], ["at", "seq"]
    handler = upserts.delta_writer(
        f"{path}/rows", keys, order, lambda batch: status.value_slots(batch, waits, MINUTE_US, 240, 10)
    )
    run_handler(actions, handler, f"{path}/checkpoint")
    return status.slot_verdict(waits, upserts.current_rows(spark, f"{path}/rows", keys, order))
