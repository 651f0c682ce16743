"""Queries over job, step, set and pod status."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from millrace.constants import CLUSTER_READY
from millrace.operators import status as ops
from millrace.plans.bindings import (
    ACTIONS_SQL,
    MINUTE_US,
    SETS_SQL,
    STEPS_SQL,
    action_lines,
    ready_polls,
    replica_sets,
    step_states,
)
from millrace.plans.registry import query, table


def _status_documents(spark, sf_dir):
    """A status document of two items per order, each tenth cut short."""
    items = F.array(
        F.struct(
            F.struct(F.concat(F.lit("order-"), "o_orderkey").alias("name")).alias("metadata"),
            F.struct(F.col("o_orderstatus").alias("phase")).alias("status"),
        ),
        F.struct(
            F.struct(F.concat(F.lit("customer's-"), "o_custkey").alias("name")).alias("metadata"),
            F.struct(F.col("o_orderpriority").alias("phase")).alias("status"),
        ),
    )
    whole = F.to_json(F.struct(items.alias("items")))
    body = F.when(F.col("o_orderkey") % 10 == 0, F.substring(whole, F.lit(2), F.length(whole))).otherwise(whole)
    return table(spark, sf_dir, "orders").select("o_orderkey", body.alias("body"))


@query("status_items", """
SELECT o_orderkey, unnest([0, 1]) AS ordinal,
       unnest(['order-' || o_orderkey, 'customer''s-' || o_custkey]) AS name,
       unnest([o_orderstatus, o_orderpriority]) AS phase
FROM orders WHERE o_orderkey % 10 <> 0
""")
def status_items(spark, sf_dir):
    item = "struct<metadata: struct<name: string>, status: struct<phase: string>>"
    return ops.status_items(_status_documents(spark, sf_dir), "body", item).select(
        "o_orderkey", "ordinal", F.col("item.metadata.name").alias("name"), F.col("item.status.phase").alias("phase")
    )


def _resources(spark, sf_dir):
    return replica_sets(spark, sf_dir).withColumn(
        "metadata", F.struct(F.concat(F.lit("set-"), F.col("name").cast("string")).alias("name"))
    )


@query("name_contains", f"""
WITH {SETS_SQL}
SELECT 'set-' || name AS name, replicas, 'set-' || name = 'set-77' AS exact FROM sets
WHERE contains('set-' || name, '77')
""")
def name_contains(spark, sf_dir):
    found = ops.resources_named(_resources(spark, sf_dir), "77")
    return found.select(
        F.col("metadata.name").alias("name"), "replicas", (F.col("metadata.name") == "set-77").alias("exact")
    )


@query("name_exact", f"WITH {SETS_SQL} SELECT 'set-' || name AS name, replicas FROM sets WHERE 'set-' || name = 'set-77'")
def name_exact(spark, sf_dir):
    found = ops.resources_named(_resources(spark, sf_dir), "set-77", exact=True)
    return found.select(F.col("metadata.name").alias("name"), "replicas")


@query("name_first", f"""
WITH {SETS_SQL}
SELECT 'set-' || name AS name, replicas, ready FROM sets WHERE contains('set-' || name, '77') ORDER BY sets.name LIMIT 1
""")
def name_first(spark, sf_dir):
    found = ops.first_named(_resources(spark, sf_dir), "77", "name")
    return found.select(F.col("metadata.name").alias("name"), "replicas", "ready")


@query("step_rollup", f"""
WITH {STEPS_SQL}
SELECT job, count(*) AS n_steps,
       CASE WHEN bool_or(state IN ('CANCELLED', 'FAILED', 'CANCEL_PENDING', 'INTERRUPTED')) THEN 'FAILED'
            WHEN bool_and(state = 'COMPLETED') THEN 'COMPLETE' ELSE 'PENDING' END AS verdict
FROM steps GROUP BY job
""")
def step_rollup(spark, sf_dir):
    return ops.step_rollup(step_states(spark, sf_dir))


@query("step_wait", f"""
WITH {STEPS_SQL},
polls AS (
  SELECT job, step - 1 AS poll, bool_or(state IN ('CANCELLED', 'FAILED', 'CANCEL_PENDING', 'INTERRUPTED')) AS failed,
         bool_and(state = 'COMPLETED') AS done
  FROM steps GROUP BY ALL
),
settled AS (
  SELECT job, min(poll) FILTER ((failed OR done) AND poll < 4) AS poll, max(poll) AS last_poll,
         arg_min(failed, poll) FILTER ((failed OR done) AND poll < 4) AS failed
  FROM polls GROUP BY job
)
SELECT job, poll, CASE WHEN poll IS NULL AND last_poll + 1 >= 4 THEN 'TIMEOUT' WHEN poll IS NULL THEN 'PENDING'
                       WHEN failed THEN 'FAILED' ELSE 'COMPLETE' END AS verdict
FROM settled
""")
def step_wait(spark, sf_dir):
    """The line number taken as the poll: what a wait of four polls would report."""
    history = step_states(spark, sf_dir).withColumn("poll", F.col("step") - 1)
    return ops.await_steps(history, max_wait=4)


@query("job_active", f"""
WITH {STEPS_SQL} SELECT job, bool_or(state IN ('PENDING', 'RUNNING')) AS active FROM steps GROUP BY job
""")
def job_active(spark, sf_dir):
    return ops.jobs_active(step_states(spark, sf_dir))


@query("job_status", """
WITH latest AS (SELECT o_custkey AS name, arg_max(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY o_custkey)
SELECT name, CASE s WHEN 'O' THEN 'Active' WHEN 'F' THEN 'Complete' ELSE 'Failed' END AS status, s = 'F' AS complete
FROM latest
""")
def job_status(spark, sf_dir):
    """A customer as a job, each order of theirs as a snapshot of it."""
    state = F.col("o_orderstatus")
    kind = F.when(state == "F", "Complete").otherwise("Failed")
    snapshots = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("name"),
        F.col("o_orderkey").alias("seq"),
        F.struct(
            F.when(state == "O", F.lit(1)).alias("active"),
            F.when(state != "O", F.array(F.struct(kind.alias("type")), F.struct(F.lit("Other").alias("type")))).alias(
                "conditions"
            ),
        ).alias("status"),
    )
    return ops.job_status(snapshots, ["seq"])


@query("set_ready", f"""
WITH {SETS_SQL}
SELECT name, replicas,
       CASE WHEN coalesce(current, updated) = replicas THEN ready = replicas
            ELSE coalesce(current, updated) = 20 END AS ready
FROM sets
""")
def set_ready(spark, sf_dir):
    verdict = ops.set_ready(F.col("replicas"), F.col("current"), F.col("updated"), F.col("ready"))
    return replica_sets(spark, sf_dir).select("name", "replicas", verdict.alias("ready"))


def _pods(spark, sf_dir):
    """An order as a pod: its init containers and host follow from its columns."""
    phase = F.when(F.col("o_orderstatus") == "O", "Running").when(F.col("o_orderstatus") == "P", "Pending")
    inits = F.when(
        F.col("o_orderpriority") != "5-LOW",
        F.array(
            F.struct((F.col("o_totalprice") > 100000).alias("ready")),
            F.struct((F.col("o_custkey") % 2 == 0).alias("ready")),
        ),
    )
    return table(spark, sf_dir, "orders").select(
        F.struct(F.concat(F.lit("pod-"), "o_orderkey").alias("name")).alias("metadata"),
        F.struct(
            F.coalesce(phase, F.lit("Succeeded")).alias("phase"),
            inits.alias("init_container_statuses"),
            F.concat(F.lit("10.0.0."), F.col("o_custkey") % 256).alias("host_ip"),
        ).alias("status"),
    )


@query("pod_ready", """
SELECT 'pod-' || o_orderkey AS pod,
       o_orderstatus = 'O' AND (o_orderpriority = '5-LOW' OR (o_totalprice > 100000 AND o_custkey % 2 = 0)) AS ready
FROM orders
""")
def pod_ready(spark, sf_dir):
    verdict = ops.pod_ready(F.col("status.phase"), F.col("status.init_container_statuses"))
    return _pods(spark, sf_dir).select(F.col("metadata.name").alias("pod"), verdict.alias("ready"))


@query("node_map", """
SELECT 'pod-' || o_orderkey AS pod, '10.0.0.' || (o_custkey % 256) AS host_ip
FROM orders WHERE contains('pod-' || o_orderkey, '-1')
""")
def node_map(spark, sf_dir):
    return ops.node_map(_pods(spark, sf_dir), "-1")


@query("cluster_select", """
SELECT 'j-' || o_orderkey AS id, 'emr-' || o_orderpriority AS name FROM orders
WHERE o_orderstatus IN ('O', 'F') AND o_orderdate > TIMESTAMP '1996-06-01' AND contains(o_orderpriority, 'HIGH')
ORDER BY o_orderdate DESC, 'j-' || o_orderkey DESC LIMIT 1
""")
def cluster_select(spark, sf_dir):
    """An order as a cluster: open is running, fulfilled is waiting."""
    state = F.when(F.col("o_orderstatus") == "O", "RUNNING").when(F.col("o_orderstatus") == "F", "WAITING")
    clusters = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("j-"), "o_orderkey").alias("id"),
        F.concat(F.lit("emr-"), "o_orderpriority").alias("name"),
        F.coalesce(state, F.lit("TERMINATED")).alias("state"),
        F.col("o_orderdate").alias("created"),
    )
    return ops.cluster_select(clusters, "HIGH", datetime(1996, 6, 1), CLUSTER_READY).select("id", "name")


@query("step_rows", """
SELECT p_partkey, unnest(['ingest', 'purify']) AS step,
       unnest(['spark-submit --class lib.' || p_type || ' --deploy-mode client s3://' || p_brand || '/in.jar',
               'spark-submit --class lib.' || p_type || '.Pure --deploy-mode client s3://' || p_brand || '/pure.jar'])
         || ' -re aws -u ' || p_name || ' -nb ' || p_brand AS args
FROM part
""")
def step_rows(spark, sf_dir):
    groups = _job_groups(spark, sf_dir)
    rows = ops.step_rows(groups, ["pipelines", "kafka", "jobs"], F.lit("aws"), F.col("p_name"), F.col("p_brand"))
    return rows.select("p_partkey", "step", F.array_join("args", " ").alias("args"))


@query("step_rows_local", """
SELECT p_partkey, unnest(['ingest', 'purify']) AS step,
       unnest(['spark-submit --master spark://127.0.0.1:7077 --class lib.' || p_type || ' /jars/in.jar',
               'spark-submit --master spark://127.0.0.1:7077 --class lib.' || p_type || '.Pure /jars/pure.jar'])
         || ' -re local -u ' || p_name || ' -nb ' || p_brand AS args
FROM part
""")
def step_rows_local(spark, sf_dir):
    groups = _job_groups(spark, sf_dir)
    rows = ops.local_step_rows(groups, ["pipelines", "kafka", "jobs"], F.col("p_name"), F.col("p_brand"))
    return rows.select("p_partkey", "step", F.array_join("args", " ").alias("args"))


def _job_groups(spark, sf_dir):
    """A part as a pipeline whose job group names two steps."""

    def conf(suffix, jar):
        return F.struct(
            F.concat(F.lit("lib."), "p_type", F.lit(suffix)).alias("main_class"),
            F.concat(F.lit("s3://"), "p_brand", F.lit(jar)).alias("jar_path"),
            F.lit(f"/jars{jar}").alias("local_jar_path"),
        )

    steps = F.create_map(F.lit("ingest"), conf("", "/in.jar"), F.lit("purify"), conf(".Pure", "/pure.jar"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_brand", F.struct(F.struct(steps.alias("jobs")).alias("kafka")).alias("pipelines")
    )


ORDER_SQL = """
WITH numbered AS (
  SELECT CAST(turn AS VARCHAR) AS batch_key, conv_id || '/' || role AS item,
         row_number() OVER (PARTITION BY turn ORDER BY conv_id {way}) AS step_no
  FROM conversations
),
batches AS (SELECT batch_key, row_number() OVER (ORDER BY batch_key {way}) AS batch_no
            FROM (SELECT DISTINCT batch_key FROM numbered))
SELECT batch_key, item, step_no, batch_no FROM numbered JOIN batches USING (batch_key)
"""


def _ordered(spark, sf_dir, delete):
    items = table(spark, sf_dir, "conversations").select(
        F.col("turn").cast("string").alias("batch_key"),
        F.concat("conv_id", F.lit("/"), "role").alias("item"),
        "conv_id",
    )
    return ops.batch_order(items, "conv_id", delete).drop("conv_id")


@query("batch_order", ORDER_SQL.format(way="ASC"))
def batch_order(spark, sf_dir):
    return _ordered(spark, sf_dir, delete=False)


@query("batch_order_delete", ORDER_SQL.format(way="DESC"))
def batch_order_delete(spark, sf_dir):
    return _ordered(spark, sf_dir, delete=True)


@query("latest_action", f"""
WITH {ACTIONS_SQL} SELECT pod, name, arg_max(value, seq) AS value, max(seq) AS seq FROM act GROUP BY pod, name
""")
def latest_action(spark, sf_dir):
    return ops.latest_action(action_lines(spark, sf_dir))


READY_SQL = """
WITH seen AS (
  SELECT user_id AS resource, epoch_us(min(ts)) AS start, epoch_us(min(ts) FILTER (event_type = 'purchase')) AS ready_at
  FROM events GROUP BY user_id
),
waited AS (SELECT resource, (ready_at - start + 299999999) // 300000000 * 5 AS waited FROM seen)
SELECT resource, CASE WHEN waited <= {last} THEN 'READY' ELSE 'TIMEOUT' END AS verdict,
       CASE WHEN waited <= {last} THEN waited ELSE 405 END AS waited
FROM waited
"""


@query("wait_until_ready", READY_SQL.format(last=405))
def wait_until_ready(spark, sf_dir):
    return ops.wait_until_ready(ready_polls(spark, sf_dir), unit=MINUTE_US)


@query("wait_until_ready_service", READY_SQL.format(last=400))
def wait_until_ready_service(spark, sf_dir):
    return ops.wait_until_ready(ready_polls(spark, sf_dir), unit=MINUTE_US, timeout_first=True)


@query("wait_for_value", f"""
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
def wait_for_value(spark, sf_dir):
    """Ten polls four hours apart, for the largest value a pod ever reports."""
    actions = ops.action_rows(action_lines(spark, sf_dir))
    waits = actions.groupBy("pod", "name").agg(F.min("at").alias("start"), F.max("value").alias("expected"))
    return ops.wait_for_value(actions, waits, unit=MINUTE_US, interval=240)


@query("wait_for_file", """
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
def wait_for_file(spark, sf_dir):
    """A file per user, there once they sign up, looked for each half hour."""
    events = table(spark, sf_dir, "events").select(
        F.concat(F.lit("flags/"), "user_id").alias("path"),
        "event_type",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
    )
    expected = events.groupBy("path").agg(F.min("at").alias("start"))
    arrivals = events.where("event_type = 'signup'").select("path", "at")
    return ops.wait_for_file(expected, arrivals, unit=MINUTE_US, interval=30)
