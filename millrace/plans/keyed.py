"""Queries over keyed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import keyed as ops
from millrace.plans.bindings import order_rows, order_updates
from millrace.plans.registry import query, table
from millrace.session import scratch_path

UPDATES_SQL = """
updates AS (
  SELECT o_orderkey, o_custkey, o_totalprice + 1 AS o_totalprice, CAST(1 AS BIGINT) AS write_ts
  FROM orders WHERE o_orderkey % 10 = 0
  UNION ALL
  SELECT -o_orderkey - 1, o_custkey, o_totalprice, 1 FROM orders WHERE o_orderkey % 10 = 0
)
"""


def _dated(df):
    return df.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


@query("scan_all", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority
FROM orders
""")
def scan_all(spark, sf_dir):
    return _dated(ops.scan_where(table(spark, sf_dir, "orders")))


@query("scan_where", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'F'
""")
def scan_where(spark, sf_dir):
    rows = ops.scan_where(table(spark, sf_dir, "orders"), "o_totalprice > 300000 AND o_orderstatus = 'F'")
    return rows.select("o_orderkey", "o_custkey", "o_totalprice")


@query("scan_limit", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50
""")
def scan_limit(spark, sf_dir):
    columns = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return ops.scan_limit(columns, ["o_orderkey"])


@query("upsert_by_key", f"""
WITH {UPDATES_SQL}
SELECT o_orderkey, arg_max(o_custkey, write_ts) AS o_custkey, arg_max(o_totalprice, write_ts) AS o_totalprice,
       max(write_ts) AS write_ts
FROM (SELECT o_orderkey, o_custkey, o_totalprice, CAST(0 AS BIGINT) AS write_ts FROM orders
      UNION ALL SELECT * FROM updates)
GROUP BY o_orderkey
""")
def upsert_by_key(spark, sf_dir):
    return ops.upsert_by_key(order_rows(spark, sf_dir), order_updates(spark, sf_dir), ["o_orderkey"])


@query("upsert_columns", f"""
WITH {UPDATES_SQL}
SELECT o_orderkey, coalesce(o.o_custkey, NULL) AS o_custkey, coalesce(u.o_totalprice, o.o_totalprice) AS o_totalprice,
       CAST(coalesce(u.write_ts, 0) AS BIGINT) AS write_ts
FROM orders o FULL JOIN updates u USING (o_orderkey)
""")
def upsert_columns(spark, sf_dir):
    """The updates do not supply the customer, so it stays, or is NULL for a new key."""
    updates = order_updates(spark, sf_dir).drop("o_custkey")
    return ops.upsert_columns(order_rows(spark, sf_dir), updates, ["o_orderkey"])


@query("batched_write", """
SELECT o_orderkey, o_orderpriority,
       (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) // 100 AS batch_no
FROM orders
""")
def batched_write(spark, sf_dir):
    """One writer per priority, 100 rows to a batch."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return ops.assign_batches(rows, 100, "o_orderkey", ["o_orderpriority"])


@query("delete_by_key", """
SELECT o_orderkey, o_custkey, o_totalprice, CAST(0 AS BIGINT) AS write_ts FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
""")
def delete_by_key(spark, sf_dir):
    """Orders left once each order with a returned item is deleted."""
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return ops.delete_by_key(
        order_rows(spark, sf_dir), returned.select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"]
    )


@query("create_table", """
SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
       CAST(CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS BIGINT) AS write_ts
FROM orders WHERE o_orderstatus <> 'P'
UNION ALL
SELECT -o_orderkey - 1, o_custkey, o_totalprice, 1 FROM orders WHERE o_orderkey % 10 = 0
""")
def create_table(spark, sf_dir):
    """Create a table, fill it, update it, delete pending orders, and drop keyspace and table again."""
    path = scratch_path(spark, "table")
    keyspace = "millrace_" + path[-8:]
    orders = ops.KeyedTable(spark, keyspace, "orders", ["o_orderkey"], path)
    orders.create("o_orderkey bigint, o_custkey bigint, o_totalprice double, write_ts bigint")
    try:
        orders.upsert(order_rows(spark, sf_dir), "filled")
        orders.upsert(order_updates(spark, sf_dir), "updated")
        orders.delete(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey"), "pruned")
        return orders.read()
    finally:
        ops.drop_keyspace(spark, keyspace)


TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


@query("table_catalog", f"""
WITH counts AS ({" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES)})
SELECT table_name, CAST(ordinal_position AS INTEGER) AS position, column_name, n_rows
FROM information_schema.columns JOIN counts USING (table_name)
""")
def table_catalog(spark, sf_dir):
    return ops.frame_catalog({t: table(spark, sf_dir, t) for t in TABLES})
