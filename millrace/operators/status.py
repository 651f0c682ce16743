"""Status snapshots: roll-ups, readiness, selections, waits and orderings.

Every reduction is an aggregate with a map-side part, so one job or resource
holding most of the rows costs no more than many small ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.constants import (
    ACTION_MAX_POLLS,
    CLUSTER_STATES,
    CLUSTERS_SINCE,
    ENOUGH_REPLICAS,
    FILE_MAX_POLLS,
    LOCAL_MASTER,
    READY_INTERVAL,
    READY_TIMEOUT,
    STEP_ACTIVE,
    STEP_COMPLETED,
    STEP_FAILED,
    STEP_MAX_POLLS,
)
from millrace.functions.text import action_entries
from millrace.operators.ranking import numbered
from millrace.operators.skew import spread_join


# -- documents and resources -----------------------------------------------------

def status_items(documents: DataFrame, body: str, item_schema: str) -> DataFrame:
    """One row per ``items[]`` element of each JSON status document."""
    parsed = F.from_json(F.col(body), f"items array<{item_schema}>", {"mode": "PERMISSIVE"})
    rest = [c for c in documents.columns if c != body]
    return documents.select(*rest, F.posexplode(parsed["items"]).alias("ordinal", "item"))


def resources_named(resources: DataFrame, fragment: str, exact: bool = False) -> DataFrame:
    """Resources whose ``metadata.name`` contains, or is, the given text."""
    name = F.col("metadata.name")
    return resources.where(name == fragment if exact else name.contains(fragment))


def first_named(resources: DataFrame, fragment: str, ordinal: str) -> DataFrame:
    """The first resource, by ``ordinal``, whose name contains the text; no row if none."""
    row = F.struct(*resources.columns)
    found = resources_named(resources, fragment).agg(F.min_by(row, ordinal).alias("_row"))
    return found.where("_row IS NOT NULL").select("_row.*")


def claim_pairs(claims: DataFrame, fragment: str) -> DataFrame:
    """Claim and volume names of the claims found; NULL for a claim without volume."""
    return resources_named(claims, fragment).select(
        F.col("metadata.name").alias("claim"), F.col("spec.volumeName").alias("volume")
    )


def node_map(pods: DataFrame, fragment: str) -> DataFrame:
    """Pod name and host address of the pods found, as rows."""
    return resources_named(pods, fragment).select(
        F.col("metadata.name").alias("pod"), F.col("status.host_ip").alias("host_ip")
    )


def pod_ready(phase: Column, init_statuses: Column) -> Column:
    """Running, and every init container ready; a pod without any counts as ready."""
    return phase.contains("Running") & F.coalesce(
        F.forall(init_statuses, lambda c: F.coalesce(c["ready"], F.lit(False))), F.lit(True)
    )


def set_ready(
    replicas: Column, current: Column, updated: Column, ready: Column, enough: int = ENOUGH_REPLICAS
) -> Column:
    """Whether a replica set is ready; unknown counts make it not ready."""
    actual = F.coalesce(current, updated)
    verdict = F.when(actual == replicas, F.coalesce(ready == actual, F.lit(False))).otherwise(
        replicas.isNotNull() & (actual == enough)
    )
    return F.coalesce(verdict, F.lit(False))


def job_status(snapshots: DataFrame, order: Sequence[str]) -> DataFrame:
    """Latest status per job: Active, else the type of its first condition."""
    latest = snapshots.groupBy("name").agg(F.max_by("status", F.struct(*order)).alias("status"))
    first = F.get("status.conditions", F.lit(0))["type"]
    state = F.when(F.col("status.active").isNotNull(), "Active").otherwise(first)
    return latest.select("name", state.alias("status")).withColumn(
        "complete", F.coalesce(F.col("status") == "Complete", F.lit(False))
    )


# -- steps -------------------------------------------------------------------------

def _verdict() -> tuple[list[Column], Column]:
    state = F.coalesce("state", F.lit(""))  # an unknown state is neither failed nor completed
    parts = [
        F.bool_or(state.isin(STEP_FAILED)).alias("_failed"),
        F.bool_and(state == STEP_COMPLETED).alias("_done"),
    ]
    return parts, F.when(F.col("_failed"), "FAILED").when(F.col("_done"), "COMPLETE").otherwise("PENDING")


def step_rollup(steps: DataFrame, polls: int = 1, max_wait: int = STEP_MAX_POLLS) -> DataFrame:
    """Verdict per job over its steps; still pending after ``max_wait`` polls is a TIMEOUT."""
    parts, verdict = _verdict()
    late = F.when((verdict == "PENDING") & F.lit(polls >= max_wait), "TIMEOUT").otherwise(verdict)
    return steps.groupBy("job").agg(*parts, F.count(F.lit(1)).alias("n_steps")).select("job", "n_steps", late.alias("verdict"))


def await_steps(history: DataFrame, max_wait: int = STEP_MAX_POLLS) -> DataFrame:
    """First poll (from 0) at which a job failed or completed, and that verdict.

    Polls from ``max_wait`` on come too late to count. Every job has a row: one
    without a poll that counts and settles it is TIMEOUT once ``max_wait`` polls were made.
    """
    parts, verdict = _verdict()
    polls = history.groupBy("job", "poll").agg(*parts)
    settled = F.when((F.col("poll") < max_wait) & (verdict != "PENDING"), F.struct("poll", verdict.alias("verdict")))
    return (
        polls.groupBy("job")
        .agg(F.min(settled).alias("_first"), F.max("poll").alias("_last"))
        .select(
            "job",
            F.col("_first.poll").alias("poll"),
            F.coalesce(
                "_first.verdict", F.when(F.col("_last") + 1 >= max_wait, "TIMEOUT").otherwise("PENDING")
            ).alias("verdict"),
        )
    )


def jobs_active(steps: DataFrame) -> DataFrame:
    """Whether a step of the job's name is pending or running; an unknown state is neither."""
    return steps.groupBy("job").agg(F.bool_or(F.coalesce("state", F.lit("")).isin(STEP_ACTIVE)).alias("active"))


def _steps(groups: DataFrame, path: Sequence[str], args: Sequence[Column]) -> DataFrame:
    group = F.col(path[0])
    for key in path[1:]:
        group = group[key]
    rest = [c for c in groups.columns if c != path[0]]
    return groups.select(*rest, F.explode(group).alias("step", "conf")).withColumn("args", F.array(*args)).drop("conf")


def step_rows(groups: DataFrame, path: Sequence[str], runtime_env: Column, unique_name: Column, bucket: Column) -> DataFrame:
    """One row per step of a nested job group, with its submit arguments."""
    return _steps(groups, path, [
        F.lit("spark-submit"), F.lit("--class"), F.col("conf.main_class"), F.lit("--deploy-mode"), F.lit("client"),
        F.col("conf.jar_path"), F.lit("-re"), runtime_env, F.lit("-u"), unique_name, F.lit("-nb"), bucket,
    ])


def local_step_rows(groups: DataFrame, path: Sequence[str], unique_name: Column, bucket: Column, master: str = LOCAL_MASTER) -> DataFrame:
    """The same steps for a local master, which takes another jar and environment."""
    return _steps(groups, path, [
        F.lit("spark-submit"), F.lit("--master"), F.lit(master), F.lit("--class"), F.col("conf.main_class"),
        F.col("conf.local_jar_path"), F.lit("-re"), F.lit("local"), F.lit("-u"), unique_name, F.lit("-nb"), bucket,
    ])


def cluster_select(
    clusters: DataFrame,
    fragment: str,
    created_after: datetime = CLUSTERS_SINCE,
    states: Sequence[str] = tuple(CLUSTER_STATES),
) -> DataFrame:
    """The newest cluster of a name, in one of the states, created after a date."""
    return (
        clusters.where(F.col("state").isin(list(states)))
        .where(F.col("created") > F.lit(created_after))
        .where(F.col("name").contains(fragment))
        .orderBy(F.desc("created"), F.desc("id"))
        .limit(1)
    )


def batch_order(items: DataFrame, pos: str, delete: bool = False, ties: Sequence[str] = ()) -> DataFrame:
    """Number batches by their key as text, and items within; both reversed to delete.

    Neither items nor batch keys are ordered in one task.
    """
    numbered_items = numbered(items, ["batch_key"], pos, "step_no", ties=ties, descending=delete)
    batches = numbered(items.select("batch_key").distinct(), [], "batch_key", "batch_no", descending=delete)
    return numbered_items.join(batches, "batch_key", "left")


# -- actions and waits ----------------------------------------------------------------

def action_rows(lines: DataFrame) -> DataFrame:
    """Name and value of each report line; lines that hold none are dropped."""
    rest = [c for c in lines.columns if c != "line"]
    return lines.select(*rest, F.explode(action_entries(F.col("line"))).alias("_entry")).select(*rest, "_entry.name", "_entry.value")


def latest_action(lines: DataFrame) -> DataFrame:
    """The value each pod last reported under each name."""
    return action_rows(lines).groupBy("pod", "name").agg(
        F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq")
    )


def ceil_div(value: Column, by: int) -> Column:
    """Whole polls needed to reach ``value``."""
    return F.ceil(value / F.lit(by))


def ready_verdict(
    start: Column, ready_at: Column, unit: int, timeout: int, interval: int, timeout_first: bool
) -> Column:
    """``struct<verdict, waited>`` of one wait.

    Polls stand ``interval`` apart from ``start``. A wait that tests readiness
    before the timeout makes one more poll than one that tests it after.
    """
    waited = ceil_div(ready_at - start, interval * unit) * interval
    last = (timeout // interval + (0 if timeout_first else 1)) * interval
    ok = F.coalesce(waited <= last, F.lit(False))
    return F.struct(
        F.when(ok, "READY").otherwise("TIMEOUT").alias("verdict"),
        F.when(ok, waited).otherwise(F.lit((timeout // interval + 1) * interval).cast("long")).alias("waited"),
    )


def wait_until_ready(
    polls: DataFrame,
    unit: int = 1_000_000,
    timeout: int = READY_TIMEOUT,
    interval: int = READY_INTERVAL,
    timeout_first: bool = False,
) -> DataFrame:
    """Per resource: how long a wait from its first row on takes, or that it times out.

    ``at`` is a count of microseconds; ``unit`` is the microseconds in one unit
    of ``timeout`` and ``interval``.
    """
    seen = polls.groupBy("resource").agg(
        F.min("at").alias("_start"), F.min(F.when(F.col("ready"), F.col("at"))).alias("_ready")
    )
    verdict = ready_verdict(F.col("_start"), F.col("_ready"), unit, timeout, interval, timeout_first)
    return seen.select("resource", verdict.alias("_v")).select("resource", "_v.*")


WAIT_KEYS = ["pod", "name", "expected", "start"]


def value_slots(actions: DataFrame, waits: DataFrame, unit: int, interval: int, max_polls: int) -> DataFrame:
    """The actions that the polls of a wait can see, each with the first poll after it."""
    slot = ceil_div(F.greatest(F.col("at") - F.col("start"), F.lit(0)), interval * unit)
    return (
        spread_join(actions.select("pod", "name", "value", "at", "seq"), waits.select(*WAIT_KEYS), ["pod", "name"], ["seq"])
        .withColumn("poll", slot)
        .where(F.col("poll") < max_polls)
    )


def slot_verdict(waits: DataFrame, slots: DataFrame) -> DataFrame:
    """First poll per wait whose last value is the expected one."""
    seen = (
        slots.where(F.col("value") == F.col("expected")).groupBy(*WAIT_KEYS).agg(F.min("poll").alias("poll"))
    )
    return waits.select(*WAIT_KEYS).join(seen, WAIT_KEYS, "left").select(
        "pod", "name", "expected", "poll", F.col("poll").isNotNull().alias("matched")
    )


def wait_for_value(
    actions: DataFrame,
    waits: DataFrame,
    unit: int = 1_000_000,
    interval: int = READY_INTERVAL,
    max_polls: int = ACTION_MAX_POLLS,
) -> DataFrame:
    """Per wait (pod, name, expected, start): the first poll that sees the expected value.

    A poll sees the last value reported before it. Of the rows between two
    polls only the last counts, so rows are first reduced to one per poll.
    """
    slots = value_slots(actions, waits, unit, interval, max_polls)
    last = slots.groupBy(*WAIT_KEYS, "poll").agg(F.max_by("value", F.struct("at", "seq")).alias("value"))
    return slot_verdict(waits, last)


def file_verdict(start: Column, arrived: Column, unit: int, interval: int, max_polls: int) -> Column:
    """``struct<status, attempt>``: a wait sleeps before each look, so looks first after one interval."""
    looks = ceil_div(arrived - start, interval * unit)
    attempt = F.when(looks < 1, F.lit(1).cast("long")).otherwise(looks)
    ok = F.coalesce(attempt <= max_polls, F.lit(False))
    return F.struct(
        F.when(ok, "FOUND").otherwise("TIMEOUT").alias("status"), F.when(ok, attempt).alias("attempt")
    )


def wait_for_file(
    expected: DataFrame,
    arrivals: DataFrame,
    unit: int = 1_000_000,
    interval: int = READY_INTERVAL,
    max_polls: int = FILE_MAX_POLLS,
) -> DataFrame:
    """Per expected file (path, start): the attempt that finds it, or TIMEOUT."""
    first = arrivals.groupBy("path").agg(F.min("at").alias("_arrived"))
    found = expected.join(first, "path", "left")
    verdict = file_verdict(F.col("start"), F.col("_arrived"), unit, interval, max_polls)
    return found.select("path", verdict.alias("_v")).select("path", "_v.*")
