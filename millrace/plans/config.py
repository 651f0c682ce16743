"""Queries over layered configuration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import config as ops
from millrace.plans.registry import query, table

LAYERS_SQL = """
layers AS (
  SELECT l.layer, p_partkey AS seq, {path} AS path, p_retailprice AS value
  FROM part, (VALUES (0, 1), (1, 3), (2, 5), (3, 7)) l(layer, step)
  WHERE p_partkey % step = 0
)
"""
FLAT_PATH = "p_brand || '.' || p_type"
MIXED_PATH = "CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 3 THEN p_brand || '.' || p_type || '.' || p_size" \
             " ELSE p_brand || '.' || p_type END"


def _layers(spark, sf_dir, path):
    """Four layers: all parts, then each 3rd, 5th and 7th."""
    rules = F.array(*[F.struct(F.lit(i).alias("layer"), F.lit(n).alias("step")) for i, n in enumerate((1, 3, 5, 7))])
    fits = F.filter(rules, lambda r: F.col("p_partkey") % r["step"] == 0)
    spread = table(spark, sf_dir, "part").withColumn("rule", F.explode(fits))
    return spread.select(
        F.col("rule.layer").alias("layer"),
        F.col("p_partkey").alias("seq"),
        F.expr(path).alias("path"),
        F.col("p_retailprice").alias("value"),
    )


@query("layered_resolve", f"""
WITH {LAYERS_SQL.format(path=FLAT_PATH)}
SELECT path, arg_max(value, layer * 1000000000000 + seq) AS value, max(layer) AS layer FROM layers GROUP BY path
""")
def layered_resolve(spark, sf_dir):
    return ops.layered_resolve(_layers(spark, sf_dir, FLAT_PATH))


@query("layered_conflicts", f"""
WITH {LAYERS_SQL.format(path=MIXED_PATH)},
latest AS (
  SELECT path, arg_max(value, layer * 1000000000000 + seq) AS value, max(layer) AS layer,
         max(layer * 1000000000000 + seq) AS at_order
  FROM layers GROUP BY path
)
SELECT path, value, layer FROM latest a
WHERE NOT EXISTS (SELECT 1 FROM latest b WHERE b.at_order > a.at_order
                  AND (starts_with(a.path, b.path || '.') OR starts_with(b.path, a.path || '.')))
""")
def layered_conflicts(spark, sf_dir):
    """Paths of one, two and three names, so that scalars and objects overwrite each other."""
    return ops.layered_resolve(_layers(spark, sf_dir, MIXED_PATH))


@query("layered_lists", f"""
WITH {LAYERS_SQL.format(path="p_brand")},
sets AS (SELECT path, max(layer * 1000000000000 + seq) FILTER (seq % 11 = 0) AS set_at FROM layers GROUP BY path)
SELECT path, layer, seq, unnest([0, 1]) AS pos, unnest(['p' || seq, 'q' || seq]) AS value
FROM layers JOIN sets USING (path) WHERE set_at IS NULL OR layer * 1000000000000 + seq >= set_at
""")
def layered_lists(spark, sf_dir):
    """Each part appends two elements to its brand's list; each 11th sets the list anew."""
    entries = _layers(spark, sf_dir, "p_brand").select(
        "layer", "seq", "path",
        F.array(F.concat(F.lit("p"), "seq"), F.concat(F.lit("q"), "seq")).alias("values"),
        F.when(F.col("seq") % 11 == 0, "set").otherwise("append").alias("op"),
    )
    return ops.layered_lists(entries)


def _reference_tree(spark, sf_dir):
    """Orders refer to customers, those to nations, those to regions.

    Of fifty orders one refers to nothing there is, one may, one refers to itself.
    """

    def leaf(name, kind, key, value):
        return table(spark, sf_dir, name).select(
            F.concat(F.lit(kind + "."), F.col(key)).alias("path"), F.expr(value).alias("value")
        )

    order_value = """
        CASE o_orderkey % 50
            WHEN 0 THEN concat('${ghost.', o_orderkey, '}')
            WHEN 1 THEN concat('[${?ghost.', o_orderkey, '}]', o_orderpriority)
            WHEN 2 THEN concat('${order.', o_orderkey, '}x')
            WHEN 3 THEN concat('${order.', o_orderkey - 3, '}')
            ELSE concat('arn:${customer.', o_custkey, '}:', o_orderstatus, '/${customer.', o_custkey, '}')
        END"""
    parts = [
        leaf("region", "region", "r_regionkey", "r_name"),
        leaf("nation", "nation", "n_nationkey", "concat('${region.', n_regionkey, '}/', n_name)"),
        leaf("customer", "customer", "c_custkey", "concat(c_mktsegment, '@${nation.', c_nationkey, '}')"),
        leaf("orders", "order", "o_orderkey", order_value),
    ]
    return reduce(DataFrame.unionByName, parts)


@query("substitution_resolve", """
WITH n AS (SELECT n_nationkey, r_name || '/' || n_name AS v FROM nation LEFT JOIN region ON n_regionkey = r_regionkey),
c AS (SELECT c_custkey, c_mktsegment || '@' || v AS v FROM customer LEFT JOIN n ON c_nationkey = n_nationkey),
o AS (
  SELECT o_orderkey,
         CASE o_orderkey % 50 WHEN 0 THEN NULL WHEN 1 THEN '[]' || o_orderpriority WHEN 2 THEN NULL WHEN 3 THEN NULL
              ELSE 'arn:' || v || ':' || o_orderstatus || '/' || v END AS value,
         CASE o_orderkey % 50 WHEN 0 THEN 'missing' WHEN 1 THEN 'resolved' WHEN 2 THEN 'cycle' WHEN 3 THEN 'missing'
              ELSE CASE WHEN v IS NULL THEN 'missing' ELSE 'resolved' END END AS status
  FROM orders LEFT JOIN c ON o_custkey = c_custkey
)
SELECT 'region.' || r_regionkey AS path, r_name AS value, 'resolved' AS status FROM region
UNION ALL SELECT 'nation.' || n_nationkey, v, CASE WHEN v IS NULL THEN 'missing' ELSE 'resolved' END FROM n
UNION ALL SELECT 'customer.' || c_custkey, v, CASE WHEN v IS NULL THEN 'missing' ELSE 'resolved' END FROM c
UNION ALL SELECT 'order.' || o_orderkey, value, status FROM o
""")
def substitution_resolve(spark, sf_dir):
    return ops.substitution_resolve(_reference_tree(spark, sf_dir))


def _ordered_entries(spark, sf_dir):
    """Three layers over customers: subtrees taken from nations, values built on their own earlier ones, lists, chains, loops."""
    base = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "c_nationkey", "c_mktsegment", "concat('customer.', c_custkey) AS p")
    nations = table(spark, sf_dir, "nation").select(
        "n_nationkey",
        F.explode(F.array(
            F.struct(F.lit("name").alias("leaf"), F.col("n_name").alias("value")),
            F.struct(F.lit("region").alias("leaf"), F.expr("concat('${region.', n_regionkey, '}')").alias("value")),
        )).alias("e"),
    )
    fixed = [
        table(spark, sf_dir, "region").selectExpr("0 AS layer", "CAST(r_regionkey AS LONG) AS seq", "concat('region.', r_regionkey) AS path", "'set' AS op", "r_name AS value"),
        nations.selectExpr("0 AS layer", "CAST(n_nationkey AS LONG) AS seq", "concat('nation.', n_nationkey, '.', e.leaf) AS path", "'set' AS op", "e.value AS value"),
    ]
    entries = base.selectExpr("k", "p", """stack(15,
        0, 0, '.label', 'set', concat('#', k, '@${', p, '.home.name}'),
        0, 1, '.home', 'set', concat('${nation.', c_nationkey, '}'),
        0, 2, '.tags', 'clear', CAST(NULL AS STRING),
        0, 3, '.tags', 'append', c_mktsegment,
        0, 4, '.all', 'set', concat('${', p, '.tags}'),
        1, 0, '.label', 'set', if(k % 3 = 0, concat('${', p, '.label}!'), NULL),
        1, 1, '.home.name', 'set', if(k % 5 = 0, 'moved', NULL),
        1, 2, '.tags', if(k % 7 = 0, 'clear', 'set'), CAST(NULL AS STRING),
        1, 3, '.tags', 'append', if(k % 2 = 0, concat('${', p, '.home.region}'), NULL),
        2, 0, '.label', 'set', if(k % 4 = 0, concat('${?', p, '.label}?'), NULL),
        2, 1, '.chain', 'set', if(k % 50 = 0, 'end', concat('.${customer.', k - 1, '.chain}')),
        2, 2, '.loop', 'set', if(k % 13 = 0, concat('${', p, '.pool}'), NULL),
        2, 3, '.pool', 'set', if(k % 13 = 0, concat('x${', p, '.loop}'), NULL),
        2, 4, '.gone', 'set', if(k % 11 = 0, concat('${ghost.', k, '}'), NULL),
        2, 5, '.inner', 'set', if(k % 17 = 0, concat('${', p, '}'), NULL)
        ) AS (layer, n, leaf, op, value)""")
    own = entries.selectExpr("layer", "k * 100 + n AS seq", "concat(p, leaf) AS path", "op", "value")
    return reduce(DataFrame.unionByName, [*fixed, own])


@query("ordered_resolve", """
WITH c AS (
  SELECT c_custkey AS k, 'customer.' || c_custkey AS p, n_nationkey, r_name AS region, c_mktsegment AS tag,
         CASE WHEN c_custkey % 5 = 0 THEN 'moved' ELSE n_name END AS name,
         printf('%d-%020d', 10000000000, 10000000000000000000::HUGEINT + c_custkey * 100 + 3) AS first,
         printf('%d-%020d', 10000000001, 10000000000000000000::HUGEINT + c_custkey * 100 + 3) AS second,
         printf('%d-%020d', 10000000000, 10000000000000000000::HUGEINT + c_custkey * 100 + 4) AS copy
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
),
tags AS (
  SELECT p, first AS element, copy, tag AS value FROM c WHERE k % 7 <> 0
  UNION ALL SELECT p, second, copy, region FROM c WHERE k % 2 = 0
)
SELECT 'region.' || r_regionkey AS path, NULL AS element, r_name AS value, 'resolved' AS status FROM region
UNION ALL SELECT 'nation.' || n_nationkey || '.name', NULL, n_name, 'resolved' FROM nation
UNION ALL SELECT 'nation.' || n_nationkey || '.region', NULL, r_name, 'resolved' FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT p || '.home.name', NULL, name, 'resolved' FROM c
UNION ALL SELECT p || '.home.region', NULL, region, 'resolved' FROM c
UNION ALL SELECT p || '.label', NULL, '#' || k || '@' || name || CASE WHEN k % 3 = 0 THEN '!' ELSE '' END || CASE WHEN k % 4 = 0 THEN '?' ELSE '' END, 'resolved' FROM c
UNION ALL SELECT p || '.tags', element, value, 'resolved' FROM tags
UNION ALL SELECT p || '.tags', NULL, NULL, 'resolved' FROM c WHERE k % 7 = 0 AND k % 2 = 1
UNION ALL SELECT p || '.all', copy || '|' || element, value, 'resolved' FROM tags
UNION ALL SELECT p || '.all', NULL, NULL, 'resolved' FROM c WHERE k % 7 = 0 AND k % 2 = 1
UNION ALL SELECT a.p || '.chain', NULL, CASE WHEN a.k - a.k % 50 >= (SELECT min(k) FROM c) THEN repeat('.', CAST(a.k % 50 AS INTEGER)) || 'end' END,
                 CASE WHEN a.k - a.k % 50 >= (SELECT min(k) FROM c) THEN 'resolved' ELSE 'missing' END FROM c a
UNION ALL SELECT p || unnest(['.loop', '.pool']), NULL, NULL, 'cycle' FROM c WHERE k % 13 = 0
UNION ALL SELECT p || '.gone', NULL, NULL, 'missing' FROM c WHERE k % 11 = 0
UNION ALL SELECT p || '.inner', NULL, NULL, 'cycle' FROM c WHERE k % 17 = 0
""")
def ordered_resolve(spark, sf_dir):
    """Layers, lists and references in one."""
    return ops.ordered_resolve(_ordered_entries(spark, sf_dir))


DOCUMENT = (
    "concat('{\"name\":\"', c_name, '\",\"account\":{\"rank\":', c_custkey * 7, ',\"segment\":\"', c_mktsegment,"
    " '\",\"flags\":{}},\"tags\":[\"a\",', c_nationkey, ',true,null],\"nested\":[{\"id\":', c_custkey, '},[]]}')"
)


def _documents(spark, sf_dir):
    """A nested configuration document per customer."""
    return table(spark, sf_dir, "customer").select("c_custkey", F.expr(DOCUMENT).alias("body"))


@query("config_flatten", f"""
WITH docs AS (SELECT c_custkey, {DOCUMENT} AS body FROM customer)
SELECT c_custkey, substr(t.fullkey, 3) AS path,
       CASE t.type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'bool' WHEN 'OBJECT' THEN 'tree'
                   WHEN 'ARRAY' THEN 'list' WHEN 'NULL' THEN 'null' ELSE 'number' END AS type,
       CASE WHEN t.type = 'NULL' THEN 'null' ELSE t.value ->> '$' END AS value
FROM docs, json_tree(docs.body) t
WHERE t.type NOT IN ('OBJECT', 'ARRAY') OR CAST(t.value AS VARCHAR) IN ('{{}}', '[]')
""")
def config_flatten(spark, sf_dir):
    return ops.config_flatten(_documents(spark, sf_dir), "body")


@query("variables_from_config", """
SELECT c_custkey, unnest([0, 1, 2, 3]) AS pos, unnest(['#name#', '#account#', '#tags#', '#nested#']) AS k,
       unnest([c_name, '{"rank":' || c_custkey * 7 || ',"segment":"' || c_mktsegment || '","flags":{}}',
               '["a",' || c_nationkey || ',true,null]', '[{"id":' || c_custkey || '},[]]']) AS v
FROM customer
""")
def variables_from_config(spark, sf_dir):
    return ops.variables_from_config(_documents(spark, sf_dir), "body")


@query("config_malformed", f"""
WITH docs AS (SELECT c_custkey, {DOCUMENT} AS body FROM customer)
SELECT c_custkey, substr(body, 1, length(body) - 1) AS body FROM docs WHERE c_custkey % 10 = 0
""")
def config_malformed(spark, sf_dir):
    """Each tenth document is cut short: these, and no others, are reported."""
    cut = F.when(F.col("c_custkey") % 10 == 0, F.expr("substring(body, 1, length(body) - 1)")).otherwise(F.col("body"))
    return ops.malformed_documents(_documents(spark, sf_dir).withColumn("body", cut), "body")
