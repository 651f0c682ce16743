"""Physical plans and the spread of hot keys."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace import plans
from millrace.operators import keyed, messages, ranking, skew, status

QUERIES = plans.load()


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> int:
    return plan_of(df).count("Exchange hashpartitioning")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pairwise_joins_and_no_row_at_a_time_python(name, spark, sf_dir):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert word not in plan


@pytest.mark.parametrize(
    "name",
    [
        "scan_all", "scan_where", "topic_fanout", "topic_publish_all", "json_publish", "line_contains", "line_remove",
        "line_prepend", "extract_tokens", "template_render", "prop_render", "properties_source", "properties_append",
        "replace_last", "rename_copy", "env_lookup", "filtered_walk", "template_listing", "forbidden_names",
        "name_regex", "object_listing", "delete_by_prefix", "bulk_upload", "claim_pairs", "ingress_value",
        "status_items", "pod_ready", "node_map", "step_rows", "config_flatten", "variables_from_config",
        "delete_topics", "json_beautify", "json_pretty",
    ],
)
def test_row_local_queries_do_not_shuffle(name, spark, sf_dir):
    assert "Exchange" not in plan_of(QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize(
    "name,most",
    [("step_rollup", 1), ("job_active", 1), ("set_ready", 1), ("wait_until_ready", 1), ("latest_action", 1),
     ("job_status", 1), ("artifact_reconcile", 2), ("bulk_fetch", 1), ("bucket_names", 1)],
)
def test_reductions_shuffle_once(name, most, spark, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    assert exchanges(df) <= most
    assert "partial_" in plan_of(df) or name == "bucket_names"


def test_upsert_shuffles_each_side_once(spark, sf_dir):
    df = QUERIES["upsert_by_key"](spark, sf_dir)
    assert exchanges(df) == 2 and "FullOuter" in plan_of(df)


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = QUERIES["scan_where"](spark, sf_dir)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "GreaterThan(o_totalprice,300000.0)" in plan and "EqualTo(o_orderstatus,F)" in plan
    read = [line for line in plan.splitlines() if line.startswith("ReadSchema")][0]
    assert "o_orderdate" not in read and "o_custkey" in read


def test_limit_keeps_few_rows_per_task(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan_of(QUERIES["scan_limit"](spark, sf_dir))
    assert "TakeOrderedAndProject" in plan_of(QUERIES["cluster_select"](spark, sf_dir))


def test_big_configuration_is_not_broadcast(spark):
    """The strategy follows the size: no hint forces a large table to every task."""
    frame = spark.range(1000).select(F.concat(F.lit("t"), F.col("id") % 5).alias("topic"), F.lit(0).alias("partition"), F.col("id").alias("offset"),
                                     F.lit("k").alias("key"), F.lit("v").alias("value"))
    small = messages.topics_frame(spark, [messages.Topic("t", verbose=True)])
    plan = plan_of(messages.route_by_verbosity(frame, small))
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    large = spark.range(50_000_000).select(F.col("id").cast("string").alias("topic"), F.lit(True).alias("verbose"))
    assert "SortMergeJoin" in plan_of(messages.route_by_verbosity(frame, large))


@pytest.fixture
def no_broadcast(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k in old:
        spark.conf.set(k, "-1" if "Threshold" in k else "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def largest_share(df) -> float:
    """Share of the rows that the fullest partition holds."""
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes) / sum(sizes)


def hot(spark, n=40_000):
    """Rows of which one key holds nine tenths."""
    return spark.range(n).select(
        F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("key"),
        "id",
    )


def test_row_numbers_of_a_hot_group_are_spread(spark, no_broadcast):
    df = ranking.numbered(hot(spark), ["key"], "id", "place")
    assert largest_share(df) < 0.4
    plain = hot(spark).repartition(8, "key")
    assert largest_share(plain) > 0.8


def test_joins_on_a_hot_key_are_spread(spark, no_broadcast):
    lookup = hot(spark).groupBy("key").agg(F.min("id").alias("first"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10000")
    joined = skew.spread_join(hot(spark), lookup, ["key"], ["id"], rows_per_slice=1000)
    assert joined.count() == 40_000
    assert largest_share(joined) < 0.4
    slices = {r.key: r._slices for r in skew.hot_keys(hot(spark), ["key"], 1000).collect()}
    assert slices == {"hot": 36}
    plain = skew.spread_join(hot(spark), lookup, ["key"], ["id"])
    assert sorted(plain.collect()) == sorted(joined.select(*plain.columns).collect())


def test_every_hot_key_is_spread(spark, no_broadcast):
    """1,500 keys above the bound: none is left out."""
    facts = spark.range(30_000).select((F.col("id") % 1500).alias("key"), "id")
    assert {r._slices for r in skew.hot_keys(facts, ["key"], 9).collect()} == {3} and skew.hot_keys(facts, ["key"], 9).count() == 1500
    lookup = facts.groupBy("key").agg(F.min("id").alias("first"))
    assert skew.spread_join(facts, lookup, ["key"], ["id"], rows_per_slice=9).where("first = key").count() == 30_000


@pytest.mark.parametrize("order", ["id * 1000000007 * 1000000007 % 9223372036854775783", "0", "id % 3", "-id"])
def test_row_numbers_whatever_the_order_looks_like(order, spark, no_broadcast):
    """Sparse 64-bit keys, one value for all rows, few values: the numbers are whole and no task holds much."""
    rows = hot(spark, 20_000).withColumn("order", F.expr(f"try_cast({order} AS BIGINT)")) if "*" not in order else hot(spark, 20_000).withColumn("order", F.xxhash64("id"))
    df = ranking.numbered(rows, ["key"], "order", "place")
    assert largest_share(df) < 0.6  # eight runs of the hot group over eight tasks
    got = df.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("place").alias("d"), F.min("place").alias("a"), F.max("place").alias("b"))
    assert got.where("n <> d OR a <> 1 OR b <> n").count() == 0
    from pyspark.sql import Window

    wrong = df.withColumn("_before", F.lag("order").over(Window.partitionBy("key").orderBy("place"))).where("_before > `order`")
    assert wrong.count() == 0


def test_hot_keys_keep_all_rows(spark, no_broadcast):
    """Results over a key with most of the rows, against plain sums."""
    rows = hot(spark)
    batches = keyed.assign_batches(rows, 100, "id", ["key"]).groupBy("key", "batch_no").count()
    assert batches.where("key = 'hot' AND count = 100").count() == 360
    polls = rows.select(F.col("key").alias("resource"), F.col("id").alias("at"), (F.col("id") == 301).alias("ready"))
    got = {r.resource: (r.verdict, r.waited) for r in status.wait_until_ready(polls, unit=1).collect()}
    assert got["hot"] == ("READY", 300) and len(got) == rows.select("key").distinct().count()
