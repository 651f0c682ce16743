"""Queries that write files and catalogue tables out of the given tables, and look at them again."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import keyed, messages
from millrace.plans.registry import query, table
from millrace.session import scratch_path
from millrace.sources import files, writers


def _written(spark, sf_dir, label):
    """Every document as a file below a new folder; the folder, and a row per file."""
    root = scratch_path(spark, label)
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit(f"{root}/"), "lang", F.lit("/"), F.col("doc_id"), F.lit(".json")).alias("path"), "text"
    )
    return root, docs, writers.write_text_files(docs)


def _walked(spark, root):
    below = F.substring_index("path", root.rpartition("/")[2] + "/", -1)
    return files.walk_tree(spark, root).select(below.alias("path"), "size")


@query("json_files", """
SELECT lang, doc_id, text AS body FROM documents
""")
def json_files(spark, sf_dir):
    """Write all documents, then read the JSON files of every directory, in one scan."""
    root, _, report = _written(spark, sf_dir, "json")
    read = files.json_files(spark, f"{root}/*")
    place = "/([^/]*)/([0-9]+)\\.json$"
    return read.select(F.regexp_extract("path", place, 1).alias("lang"), F.regexp_extract("path", place, 2).cast("long").alias("doc_id"), "body")


@query("write_report", """
SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, true AS ok FROM documents
""")
def write_report(spark, sf_dir):
    _, _, report = _written(spark, sf_dir, "report")
    return report.select(F.regexp_extract("path", "([0-9]+)\\.json$", 1).cast("long").alias("doc_id"), "n_bytes", "ok")


@query("tree_walk", """
SELECT lang || '/' || doc_id || '.json' AS path, CAST(strlen(text) AS BIGINT) AS size FROM documents
""")
def tree_walk(spark, sf_dir):
    root, _, _ = _written(spark, sf_dir, "tree")
    return _walked(spark, root)


@query("tree_walk_links", """
SELECT lang || '/' || doc_id || '.json' AS path, CAST(strlen(text) AS BIGINT) AS size FROM documents
UNION ALL SELECT 'shared/' || doc_id || '.txt', strlen(text) FROM documents WHERE doc_id % 2 = 0
""")
def tree_walk_links(spark, sf_dir):
    """A tree with a link to a second one, links to its own root and to a directory inside: each directory is listed once."""
    root, docs, _ = _written(spark, sf_dir, "links")
    other = scratch_path(spark, "linked")
    even = docs.where("doc_id % 2 = 0").select(F.concat(F.lit(f"{other}/"), F.col("doc_id"), F.lit(".txt")).alias("path"), "text")
    writers.write_text_files(even)
    files.link_directories(spark, [(f"{root}/shared", other), (f"{root}/again", root), (f"{other}/back", f"{root}/again")])
    below = F.substring_index("path", root.rpartition("/")[2] + "/", -1)
    return files.walk_tree(spark, root, follow_links=True).select(below.alias("path"), "size")


@query("tree_copy_and_delete", """
SELECT lang || '/' || doc_id || '.json' AS path, CAST(strlen(text) AS BIGINT) AS size, 'from' AS side FROM documents WHERE lang <> 'de'
UNION ALL
SELECT lang || '/' || doc_id || '.json', strlen(text), 'to' FROM documents
""")
def tree_copy_and_delete(spark, sf_dir):
    """Copy all documents to a second tree, delete those of one language from the first, and list both."""
    root, docs, _ = _written(spark, sf_dir, "from")
    other = scratch_path(spark, "to")
    target = F.replace("path", F.lit(root), F.lit(other))
    writers.copy_files(docs.select(F.col("path").alias("src"), target.alias("dest")))
    writers.delete_files(docs.where("lang = 'de'"))
    return _walked(spark, root).withColumn("side", F.lit("from")).union(_walked(spark, other).withColumn("side", F.lit("to")))


@query("replay_files", """
WITH ids AS (SELECT c_custkey AS id, 1 AS there FROM customer UNION ALL SELECT -c_custkey - 1, 0 FROM customer)
SELECT CAST(id AS VARCHAR) AS key, 'docking_experiments' AS topic,
       CASE WHEN there = 1 AND id % 10 <> 0 THEN '{"name":"' || c_name || '","segment":"' || c_mktsegment || '"}' END AS value,
       CASE WHEN there = 0 THEN 'missing' WHEN id % 10 = 0 THEN 'malformed' ELSE 'sent' END AS status
FROM ids LEFT JOIN customer ON c_custkey = id
""")
def replay_files(spark, sf_dir):
    """A file per customer, each tenth broken, replayed by id beside as many ids without a file."""
    root = scratch_path(spark, "replay")
    given = table(spark, sf_dir, "customer")
    body = F.to_json(F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name")))
    cut = F.when(F.col("c_custkey") % 10 == 0, F.substring(body, 1, F.length(body) - 1)).otherwise(body)
    writers.write_text_files(given.select(F.concat(F.lit(f"{root}/input/bot_"), "c_custkey", F.lit(".json")).alias("path"), cut.alias("text")), tasks=4 * spark.sparkContext.defaultParallelism)
    ids = given.select(F.col("c_custkey").alias("id")).unionByName(given.select((-F.col("c_custkey") - 1).alias("id")))
    return messages.replay_files(ids, f"{root}/input/bot_")


CATALOGUED = ("region", "nation", "orders", "lineitem")


def _keyspace(spark, sf_dir):
    """A new keyspace with a filled copy of each of the tables above."""
    path = scratch_path(spark, "keyspace")
    keyspace = "millrace_" + path[-8:]
    for name in CATALOGUED:
        given = table(spark, sf_dir, name)
        columns = ", ".join(f"`{c}` {kind}" for c, kind in given.dtypes)
        keyed.create_table(spark, keyspace, name, columns, location=f"{path}/{name}")
        given.write.insertInto(f"`{keyspace}`.`{name}`")
    return keyspace


@query("catalog_columns", f"""
SELECT table_name, CAST(ordinal_position - 1 AS INTEGER) AS position, column_name
FROM information_schema.columns WHERE table_name IN {CATALOGUED}
""")
def catalog_columns(spark, sf_dir):
    """The columns of tables created in the catalogue."""
    keyspace = _keyspace(spark, sf_dir)
    try:
        return keyed.table_catalog(spark, [keyspace]).select("table_name", "position", "column_name")
    finally:
        keyed.drop_keyspace(spark, keyspace)


@query("keyspace_lifecycle", """
SELECT 'filled' AS step, 'region' AS table_name, count(*) AS n_rows FROM region
UNION ALL SELECT 'filled', 'nation', count(*) FROM nation
UNION ALL SELECT 'filled', 'orders', count(*) FROM orders
UNION ALL SELECT 'filled', 'lineitem', count(*) FROM lineitem
UNION ALL SELECT 'dropped', 'region', count(*) FROM region
UNION ALL SELECT 'dropped', 'orders', count(*) FROM orders
UNION ALL SELECT 'dropped', 'lineitem', count(*) FROM lineitem
UNION ALL SELECT 'refilled', 'orders', count(*) FROM orders WHERE o_orderstatus = 'O'
""")
def keyspace_lifecycle(spark, sf_dir):
    """Rows per table after filling, after dropping a table, after a clear (none), and after a reset and a new table."""
    keyspace = _keyspace(spark, sf_dir)

    def seen(step):
        names = [t.name for t in spark.catalog.listTables(keyspace)]
        return [(step, n, spark.table(f"`{keyspace}`.`{n}`").count()) for n in names]

    try:
        rows = seen("filled")
        keyed.drop_table(spark, keyspace, "nation")
        rows += seen("dropped")
        keyed.clear_keyspace(spark, keyspace)
        rows += seen("cleared")
        keyed.reset_keyspace(spark, keyspace)
        orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
        keyed.create_table(spark, keyspace, "orders", ", ".join(f"`{c}` {k}" for c, k in orders.dtypes), location=scratch_path(spark, "orders"))
        orders.write.insertInto(f"`{keyspace}`.`orders`")
        rows += seen("refilled")
        return spark.createDataFrame(rows, "step string, table_name string, n_rows long")
    finally:
        keyed.drop_keyspace(spark, keyspace)
