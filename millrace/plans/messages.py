"""Queries over topic messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.jsons import canonical_or_raw, pretty_json
from millrace.operators import messages as ops
from millrace.plans.bindings import BODIES_SQL, MESSAGES_SQL, json_bodies, messages, raw_records
from millrace.plans.registry import query, table

TOPICS = [
    ops.Topic("click", 4, 0, 1, True, {"max_message_bytes": "20000000"}),
    ops.Topic("view", 4, 1, 1, True, {"max_message_bytes": "20000000"}),
    ops.Topic("purchase", 4, 0, 3, False, {"max_message_bytes": "20000000", "retention_ms": "604800000"}),
    ops.Topic("signup", 1, 0, 1, False, {"max_message_bytes": "200000"}),
]
GROUPS = [
    ops.Group("brain", subscribe=["click"], publish=["view"]),
    ops.Group("bots", subscribe=["view"], publish=["click"]),
    ops.Group("monitor", subscribe=["click", "view", "error"]),
]
VERBOSE_SQL = """
flags AS (SELECT * FROM (VALUES ('click', true), ('view', true), ('purchase', false), ('signup', false))
          t(topic, talk))
"""


@query("decode_record", f"""
WITH {MESSAGES_SQL} SELECT topic, "partition", "offset", key, value FROM msg
""")
def decode_record(spark, sf_dir):
    return ops.decode_record(raw_records(spark, sf_dir))


@query("topic_fanout", """
SELECT topic, CAST(user_id AS VARCHAR) AS key, props AS value
FROM events, (VALUES ('mirror'), ('audit'), ('archive')) t(topic)
""")
def topic_fanout(spark, sf_dir):
    sent = ops.fan_out(messages(spark, sf_dir), ["mirror", "audit", "archive"])
    return sent.select("topic", F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value"))


@query("topic_publish_all", """
SELECT topic, CAST(user_id AS VARCHAR) AS key, props AS value
FROM events, (VALUES ('click'), ('view'), ('purchase'), ('signup')) t(topic)
""")
def topic_publish_all(spark, sf_dir):
    sent = ops.publish_all(messages(spark, sf_dir), TOPICS)
    return sent.select("topic", F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value"))


@query("json_publish", f"""
WITH {BODIES_SQL}
SELECT 'documents' AS topic, CAST(id AS VARCHAR) AS key, CAST(json(body) AS VARCHAR) AS value
FROM bodies WHERE json_valid(body)
""")
def json_publish(spark, sf_dir):
    return ops.publish_json(json_bodies(spark, sf_dir), "id", "body", "documents")


@query("json_rejected", f"""
WITH {BODIES_SQL}
SELECT 'documents' AS topic, CAST(id AS VARCHAR) AS key, body, 'malformed' AS error FROM bodies WHERE NOT json_valid(body)
""")
def json_rejected(spark, sf_dir):
    """What ``json_publish`` does not send."""
    return ops.rejected_json(json_bodies(spark, sf_dir), "id", "body", "documents")


SIZE_TOPICS = [
    ops.Topic("en", config={"max_message_bytes": "20000"}),
    ops.Topic("fr", config={"max_message_bytes": "2000"}),
    ops.Topic("de", config={"max_message_bytes": "200000"}),
]
SIZED_SQL = """
sized AS (
  SELECT lang AS topic, CAST(doc_id AS VARCHAR) AS key,
         CAST(strlen(CAST(doc_id AS VARCHAR)) + strlen(text) AS BIGINT) AS n_bytes,
         CAST(CASE lang WHEN 'en' THEN 20000 WHEN 'fr' THEN 2000 WHEN 'de' THEN 200000 ELSE 15048576 END
              AS BIGINT) AS max_bytes
  FROM documents
)
"""


def _guarded(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("topic"), F.col("doc_id").cast("string").alias("key"), F.col("text").alias("value")
    )
    return ops.size_guard(docs, ops.topics_frame(spark, SIZE_TOPICS)).drop("value")


@query("size_guard", f"""
WITH {SIZED_SQL} SELECT topic, key, n_bytes, max_bytes, n_bytes <= max_bytes AS accepted FROM sized
""")
def size_guard(spark, sf_dir):
    return _guarded(spark, sf_dir)


@query("delivery_report", f"""
WITH {SIZED_SQL}
SELECT topic, CASE WHEN n_bytes <= max_bytes THEN 'delivered' ELSE 'failed' END AS status,
       CASE WHEN n_bytes > max_bytes THEN 'message too large' END AS error,
       count(*) AS n_messages, CAST(sum(n_bytes) AS BIGINT) AS n_bytes
FROM sized GROUP BY ALL
""")
def delivery_report(spark, sf_dir):
    return ops.delivery_report(_guarded(spark, sf_dir))


@query("topic_catalog", """
SELECT event_type AS topic, CAST(count(DISTINCT user_id % 4) + 1 AS INTEGER) AS partitions, 1 AS replication_factor,
       unnest(['max.message.bytes', 'retention.ms']) AS name,
       unnest([CAST(max(strlen(props)) AS VARCHAR), CAST(count(*) AS VARCHAR)]) AS value
FROM events GROUP BY event_type
""")
def topic_catalog(spark, sf_dir):
    """Topics as the events show them: partitions in use, largest message, volume."""
    seen = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("topic")).agg(
        F.count_distinct(F.col("user_id") % 4).cast("int").alias("num_partitions"),
        F.max(F.octet_length("props")).cast("string").alias("bytes"),
        F.count(F.lit(1)).cast("string").alias("n"),
    )
    configured = seen.select(
        "topic",
        "num_partitions",
        F.lit(1).alias("other_channels"),
        F.lit(1).alias("replication_factor"),
        F.create_map(F.lit("max_message_bytes"), "bytes", F.lit("retention_ms"), "n").alias("config"),
    )
    return ops.topic_catalog(configured).select(
        "topic", "partitions", "replication_factor", F.explode("config").alias("name", "value")
    )


@query("verbosity_route", f"""
WITH {MESSAGES_SQL}, {VERBOSE_SQL}
SELECT m.topic, "partition", "offset",
       'topic: ' || m.topic || ', partition: ' || "partition" || ', offset: ' || "offset" || ', key: ' || key AS header,
       CASE WHEN talk THEN CAST(json(value) AS VARCHAR) END AS body
FROM msg m LEFT JOIN flags f ON m.topic = f.topic
""")
def verbosity_route(spark, sf_dir):
    records = ops.decode_record(raw_records(spark, sf_dir))
    return ops.route_by_verbosity(records, ops.topics_frame(spark, TOPICS))


@query("group_delivery", f"""
WITH {MESSAGES_SQL},
edges AS (SELECT * FROM (VALUES ('brain', 'click'), ('bots', 'view'), ('monitor', 'click'), ('monitor', 'view'),
                                ('monitor', 'error')) t("group", topic))
SELECT "group", m.topic, "partition", "offset", key FROM msg m JOIN edges e ON m.topic = e.topic
""")
def group_delivery(spark, sf_dir):
    records = ops.decode_record(raw_records(spark, sf_dir)).drop("value")
    return ops.deliver_to_groups(records, ops.groups_frame(spark, GROUPS))


@query("topic_summary", f"""
WITH {MESSAGES_SQL}
SELECT topic, "partition", min("offset") AS first_offset, max("offset") AS last_offset, count(*) AS n_records
FROM msg GROUP BY ALL
""")
def topic_summary(spark, sf_dir):
    return ops.topic_summary(raw_records(spark, sf_dir))


@query("last_message", f"""
WITH {MESSAGES_SQL}
SELECT topic, "partition", max("offset") AS "offset", arg_max(key, "offset") AS key, arg_max(value, "offset") AS value
FROM msg GROUP BY ALL
""")
def last_message(spark, sf_dir):
    return ops.last_message(ops.decode_record(raw_records(spark, sf_dir)))


@query("last_message_of_topic", f"""
WITH {MESSAGES_SQL}, latest AS (SELECT topic, max(event_id) AS event_id FROM msg GROUP BY topic)
SELECT topic, event_id AS "offset", key, value FROM latest JOIN msg USING (topic, event_id)
""")
def last_message_of_topic(spark, sf_dir):
    """Over a whole topic, the event number standing for the offset."""
    records = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("topic"), F.col("event_id").alias("offset"),
        F.col("user_id").cast("string").alias("key"), F.col("props").alias("value"),
    )
    return ops.last_message(records, ["topic"])


@query("json_pretty", f"""
WITH {BODIES_SQL}
SELECT id, CASE WHEN json_valid(body) THEN CAST(json(body) AS VARCHAR) ELSE body END AS value,
       CASE WHEN json_valid(body)
            THEN '{{' || chr(10) || '    "k": ' || (body::JSON->>'k') || chr(10) || '}}' ELSE body END AS indented
FROM bodies
""")
def json_pretty(spark, sf_dir):
    body = F.col("body")
    return json_bodies(spark, sf_dir).select(
        "id", canonical_or_raw(body).alias("value"), pretty_json(body).alias("indented")
    )


@query("debug_replay", """
WITH found AS (
  SELECT event_id AS id, CASE WHEN event_id % 10 = 0 THEN substr(props, 1, length(props) - 1) ELSE props END AS body
  FROM events
),
ids AS (SELECT event_id AS id FROM events UNION ALL SELECT -event_id - 1 FROM events)
SELECT CAST(i.id AS VARCHAR) AS key, 'docking_experiments' AS topic,
       CASE WHEN json_valid(body) THEN CAST(json(body) AS VARCHAR) END AS value,
       CASE WHEN body IS NULL THEN 'missing' WHEN json_valid(body) THEN 'sent' ELSE 'malformed' END AS status
FROM ids i LEFT JOIN found f ON i.id = f.id
""")
def debug_replay(spark, sf_dir):
    """Replay every event, and as many ids that have no file."""
    events = table(spark, sf_dir, "events").select("event_id")
    there = events.select(F.col("event_id").alias("id"))
    absent = events.select((-F.col("event_id") - 1).alias("id"))
    ids = there.unionByName(absent).select(F.col("id").cast("string").alias("id"))
    return ops.replay_documents(ids, json_bodies(spark, sf_dir).select("path", "body"), "debug/bot_")


@query("delete_topics", """
SELECT event_type AS topic, CAST(user_id AS VARCHAR) AS key, props AS value
FROM events WHERE event_type NOT IN ('click', 'error', 'my_topic')
""")
def delete_topics(spark, sf_dir):
    return ops.drop_topics(messages(spark, sf_dir), ["click", "error", "my_topic"])
