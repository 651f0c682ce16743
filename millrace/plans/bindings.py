"""The given tables in the shape of each operator's input, in Spark and in SQL.

Every binding keeps the whole table. Remainders of a key only decide which
variant of a row is built (its extension, its layer, its malformed body).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.ranking import numbered
from millrace.plans.registry import table

MINUTE_US = 60_000_000


# -- topic messages out of events ------------------------------------------

def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic, key, value: a keyed message per event, not yet placed in a log."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("topic"),
        F.col("user_id").cast("string").alias("key"),
        F.col("props").alias("value"),
    )


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic, partition, offset, key and value as bytes: a topic log."""
    placed = table(spark, sf_dir, "events").select(
        "event_id",
        F.col("event_type").alias("topic"),
        (F.col("user_id") % 4).cast("int").alias("partition"),
        F.encode(F.col("user_id").cast("string"), "UTF-8").alias("key"),
        F.encode("props", "UTF-8").alias("value"),
    )
    return numbered(placed, ["topic", "partition"], "event_id", "offset", start=0).drop("event_id")


MESSAGES_SQL = """
msg AS (
  SELECT event_type AS topic, CAST(user_id % 4 AS INTEGER) AS "partition",
         row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY event_id) - 1 AS "offset",
         CAST(user_id AS VARCHAR) AS key, props AS value, event_id
  FROM events
)
"""


# -- JSON documents out of events ------------------------------------------

def json_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, path, body: one JSON file per event, each tenth cut short."""
    cut = F.expr("substring(props, 1, length(props) - 1)")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("debug/bot_"), F.col("event_id"), F.lit(".json")).alias("path"),
        F.when(F.col("event_id") % 10 == 0, cut).otherwise(F.col("props")).alias("body"),
    )


BODIES_SQL = """
bodies AS (
  SELECT event_id AS id, 'debug/bot_' || event_id || '.json' AS path,
         CASE WHEN event_id % 10 = 0 THEN substr(props, 1, length(props) - 1) ELSE props END AS body
  FROM events
)
"""


# -- files out of documents -------------------------------------------------

def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, text: a tree of text files, some in directories to ignore."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat_ws(
            "/",
            "source",
            "lang",
            F.element_at(F.array(*[F.lit(d) for d in SUB_DIRS]), (F.col("doc_id") % 5 + 1).cast("int")),
            F.concat(
                F.col("doc_id").cast("string"),
                F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % 4 + 1).cast("int")),
            ),
        ).alias("path"),
        "text",
    )


SUB_DIRS = ["core", ".cache", "pkg.egg-info", "target", "main"]
EXTENSIONS = [".json", ".tmpl", ".conf", ".txt"]

FILES_SQL = """
files AS (
  SELECT doc_id,
         source || '/' || lang || '/' || ['core', '.cache', 'pkg.egg-info', 'target', 'main'][doc_id % 5 + 1]
           || '/' || doc_id || ['.json', '.tmpl', '.conf', '.txt'][doc_id % 4 + 1] AS path,
         text
  FROM documents
)
"""


# -- objects out of pages ----------------------------------------------------

def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bucket, key, size, mtime: host and path of each page."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        F.regexp_extract(url, "^https?://([^/]+)/", 1).alias("bucket"),
        F.regexp_extract(url, "^https?://[^/]+/(.*)$", 1).alias("key"),
        F.length("html").cast("long").alias("size"),
        F.col("page_id").alias("mtime"),
    )


OBJECTS_SQL = """
obj AS (
  SELECT regexp_extract(url, '^https?://([^/]+)/', 1) AS bucket,
         regexp_extract(url, '^https?://[^/]+/(.*)$', 1) AS key,
         CAST(length(html) AS BIGINT) AS size, page_id AS mtime
  FROM pages
)
"""


# -- keyed table out of orders ----------------------------------------------

def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", F.lit(0).cast("long").alias("write_ts")
    )


def order_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later price for each tenth key, and a new key beside each of them."""
    tenth = table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 10 == 0)
    changed = tenth.select(
        "o_orderkey", "o_custkey", (F.col("o_totalprice") + 1).alias("o_totalprice"),
        F.lit(1).cast("long").alias("write_ts"),
    )
    added = tenth.select(
        (-F.col("o_orderkey") - 1).alias("o_orderkey"), "o_custkey", "o_totalprice",
        F.lit(1).cast("long").alias("write_ts"),
    )
    return changed.unionByName(added)


# -- readiness and actions out of events -------------------------------------

def ready_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """resource, at (microseconds), ready: what was seen of a resource and when."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("resource"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        (F.col("event_type") == "purchase").alias("ready"),
    )


def action_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pod, seq, at, line: report lines, those of errors unparsable."""
    name = F.col("event_type")
    number = F.regexp_extract("props", "([0-9]+)", 1)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("pod"),
        F.col("event_id").alias("seq"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        F.when(name == "error", F.concat(name, F.lit(" "), number))
        .otherwise(F.concat(name, F.lit(": "), number))
        .alias("line"),
    )


ACTIONS_SQL = """
act AS (
  SELECT user_id AS pod, event_id AS seq, epoch_us(ts) AS at_us, event_type AS name,
         regexp_extract(props, '([0-9]+)', 1) AS value
  FROM events WHERE event_type <> 'error'
)
"""


# -- steps, sets and jobs -----------------------------------------------------

def step_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job, step, state: a step per line item."""
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    state = (
        F.when(status == "F", F.when(flag == "R", "FAILED").otherwise("COMPLETED"))
        .when(flag == "A", "RUNNING")
        .when(flag == "N", "COMPLETED")
        .otherwise("CANCELLED")
    )
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("step"), state.alias("state")
    )


STEPS_SQL = """
steps AS (
  SELECT l_orderkey AS job, l_linenumber AS step,
         CASE WHEN l_linestatus = 'F' THEN CASE WHEN l_returnflag = 'R' THEN 'FAILED' ELSE 'COMPLETED' END
              WHEN l_returnflag = 'A' THEN 'RUNNING' WHEN l_returnflag = 'N' THEN 'COMPLETED'
              ELSE 'CANCELLED' END AS state
  FROM lineitem
)
"""


def replica_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, replicas, current, updated, ready: a replica set per order."""
    counted = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("name")).agg(
        F.count(F.lit(1)).alias("replicas"),
        F.count_if(F.col("l_returnflag") != "N").alias("updated"),
        F.count_if(F.col("l_linestatus") == "F").alias("ready"),
    )
    current = F.when(F.col("name") % 2 == 0, F.col("replicas"))
    return counted.withColumn("current", current)


SETS_SQL = """
sets AS (
  SELECT l_orderkey AS name, count(*) AS replicas,
         CASE WHEN l_orderkey % 2 = 0 THEN count(*) END AS current,
         count(*) FILTER (l_returnflag <> 'N') AS updated,
         count(*) FILTER (l_linestatus = 'F') AS ready
  FROM lineitem GROUP BY l_orderkey
)
"""
