"""Queries over object and file listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.jsons import ingress_value as first_ingress
from millrace.functions.names import valid_dir, valid_file, ends_with_any, file_name, parent_dir
from millrace.operators import objects as ops
from millrace.operators import status
from millrace.plans.bindings import FILES_SQL, OBJECTS_SQL, files, objects
from millrace.plans.registry import query

NAMES_SQL = """
named AS (
  SELECT *, string_split(path, '/') AS parts, string_split(path, '/')[-1] AS name,
         string_split(path, '/')[-2] AS parent
  FROM files
)
"""


@query("object_listing", f"""
WITH {OBJECTS_SQL}
SELECT bucket, regexp_replace(key, '\\s+$', '') AS key, size, mtime FROM obj WHERE starts_with(key, 'e')
""")
def object_listing(spark, sf_dir):
    return ops.list_prefix(objects(spark, sf_dir), "e")


@query("bucket_names", f"WITH {OBJECTS_SQL} SELECT DISTINCT bucket FROM obj")
def bucket_names(spark, sf_dir):
    return ops.bucket_names(objects(spark, sf_dir))


@query("filtered_walk", f"""
WITH {FILES_SQL}, {NAMES_SQL}
SELECT path, source_dir AS dirpath, name, CAST(len(parts) - 1 AS INTEGER) AS depth
FROM (SELECT *, array_to_string(parts[:-2], '/') AS source_dir FROM named)
WHERE NOT ends_with(name, '.json') AND NOT ends_with(name, '7.txt')
  AND len(list_filter(parts[:-2], lambda d: ends_with(d, '.egg-info') OR starts_with(d, '.')
                                            OR d IN ('target', 'src3', 'de'))) = 0
""")
def filtered_walk(spark, sf_dir):
    walked = ops.filtered_walk(files(spark, sf_dir), ["target", "src3", "de"], [".json", "7.txt"])
    return walked.select("path", "dirpath", "name", "depth")


@query("template_listing", f"""
WITH {FILES_SQL}, {NAMES_SQL}
SELECT path FROM named WHERE ends_with(path, '.tmpl') AND parent NOT IN ('target', '.cache')
""")
def template_listing(spark, sf_dir):
    return ops.template_listing(files(spark, sf_dir), ["target", ".cache"]).select("path")


@query("remove_non_templates", f"""
WITH {FILES_SQL}, {NAMES_SQL}
SELECT path FROM named
WHERE NOT ((ends_with(path, '.yaml') OR ends_with(path, '.json')) AND parent NOT IN ('target', '.cache'))
""")
def remove_non_templates(spark, sf_dir):
    return ops.remove_non_templates(files(spark, sf_dir), ["target", ".cache"]).select("path")


@query("forbidden_names", f"""
WITH {FILES_SQL}, {NAMES_SQL}
SELECT path,
       NOT (ends_with(parent, '.egg-info') OR starts_with(parent, '.') OR parent IN ('target', 'dist')) AS dir_ok,
       NOT (ends_with(name, '.conf') OR ends_with(name, '1.tmpl')) AS file_ok,
       ends_with(path, '3.txt') OR ends_with(path, '.json') AS has_end
FROM named
""")
def forbidden_names(spark, sf_dir):
    path = F.col("path")
    return files(spark, sf_dir).select(
        "path",
        valid_dir(parent_dir(path), ["target", "dist"]).alias("dir_ok"),
        valid_file(file_name(path), [".conf", "1.tmpl"]).alias("file_ok"),
        ends_with_any(path, ["3.txt", ".json"]).alias("has_end"),
    )


@query("name_regex", f"""
WITH {FILES_SQL}, {NAMES_SQL} SELECT path FROM named WHERE regexp_matches(name, '[37]\\.(conf|txt)')
""")
def name_regex(spark, sf_dir):
    return ops.names_matching(files(spark, sf_dir), "[37]\\.(conf|txt)").select("path")


@query("object_exists", f"""
WITH {OBJECTS_SQL}
SELECT bucket, 'en' AS prefix, CASE WHEN mtime % 2 = 0 THEN substr(key, 4) ELSE substr(key, 4) || '_x' END AS name,
       starts_with(key, 'en/') AND mtime % 2 = 0 AS found
FROM obj
""")
def object_exists(spark, sf_dir):
    """Ask for each key as if it lay below en/; every other name does not exist."""
    rest = F.expr("substring(key, 4)")
    requests = objects(spark, sf_dir).select(
        "bucket",
        F.lit("en").alias("prefix"),
        F.when(F.col("mtime") % 2 == 0, rest).otherwise(F.concat(rest, F.lit("_x"))).alias("name"),
    )
    return ops.objects_exist(requests, objects(spark, sf_dir))


@query("bucket_sync", f"""
WITH {OBJECTS_SQL}
SELECT 'live/' || bucket || '/' || key AS src_key, 'backup/' || bucket || '/' || key AS dest_key, size,
       CASE WHEN mtime % 4 = 0 THEN 'missing' WHEN mtime % 3 = 0 THEN 'size' ELSE 'newer' END AS reason
FROM obj WHERE mtime % 4 = 0 OR mtime % 3 = 0 OR mtime % 5 = 0
""")
def bucket_sync(spark, sf_dir):
    """A backup that lacks each 4th object, has each 3rd cut, and each 5th out of date."""
    listing = objects(spark, sf_dir)
    rel = F.concat("bucket", F.lit("/"), "key")
    source = listing.select(F.concat(F.lit("live/"), rel).alias("key"), "size", "mtime")
    backup = listing.where("mtime % 4 <> 0").select(
        F.concat(F.lit("backup/"), rel).alias("key"),
        F.when(F.col("mtime") % 3 == 0, F.col("size") - 1).otherwise(F.col("size")).alias("size"),
        F.when(F.col("mtime") % 5 == 0, F.col("mtime") - 1).otherwise(F.col("mtime")).alias("mtime"),
    )
    return ops.sync_plan(source, backup, "live", "backup")


@query("bucket_sync_many", f"""
WITH {OBJECTS_SQL},
pairs AS (
  SELECT DISTINCT 'live/' || bucket AS src_prefix, 'mirror/' || bucket AS dest_prefix FROM obj
  UNION ALL SELECT 'live', 'backup' UNION ALL SELECT 'live/nothing', 'none'
),
there AS (
  SELECT 'backup/' || bucket || '/' || key AS key, CASE WHEN mtime % 3 = 0 THEN size - 1 ELSE size END AS size FROM obj WHERE mtime % 4 <> 0
  UNION ALL SELECT 'mirror/' || bucket || '/' || key, size FROM obj WHERE mtime % 2 = 0
),
plan AS (
  SELECT src_prefix, dest_prefix, 'live/' || bucket || '/' || obj.key AS src_key,
         dest_prefix || substr('live/' || bucket || '/' || obj.key, length(src_prefix) + 1) AS dest_key, size
  FROM obj JOIN pairs ON starts_with('live/' || bucket || '/' || obj.key, src_prefix || '/')
)
SELECT plan.*, CASE WHEN there.key IS NULL THEN 'missing' ELSE 'size' END AS reason
FROM plan LEFT JOIN there ON dest_key = there.key WHERE there.key IS NULL OR there.size <> plan.size
""")
def bucket_sync_many(spark, sf_dir):
    """A backup of everything and a mirror per bucket, planned at once: their prefixes lie inside each other."""
    listing = objects(spark, sf_dir)
    at = lambda root: F.concat(F.lit(root + "/"), "bucket", F.lit("/"), "key")
    source = listing.select(at("live").alias("key"), "size", "mtime")
    cut = F.when(F.col("mtime") % 3 == 0, F.col("size") - 1).otherwise(F.col("size"))
    there = listing.where("mtime % 4 <> 0").select(at("backup").alias("key"), cut.alias("size"), "mtime").unionByName(
        listing.where("mtime % 2 = 0").select(at("mirror").alias("key"), "size", "mtime")
    )
    fixed = spark.createDataFrame([("live", "backup"), ("live/nothing/", "none")], "src_prefix string, dest_prefix string")
    each = listing.select(F.concat(F.lit("live/"), "bucket").alias("src_prefix"), F.concat(F.lit("mirror/"), "bucket").alias("dest_prefix"))
    plan = ops.sync_pairs(source, there, each.distinct().unionByName(fixed))
    return plan.withColumn("src_prefix", F.rtrim("src_prefix", F.lit("/")))


@query("artifact_reconcile", f"""
WITH {OBJECTS_SQL},
s AS (SELECT bucket || '-' || key || '-' || mtime || '.jar' AS artifact, mtime % 2 = 0 AS local, mtime % 3 = 0 AS remote
      FROM obj)
SELECT artifact, local, remote, 'aws' AS env,
       CASE WHEN remote AND NOT local THEN 'download' WHEN remote THEN 'none'
            WHEN NOT local THEN 'build+push' ELSE 'push' END AS action FROM s
UNION ALL
SELECT artifact, local, remote, 'kind', CASE WHEN local THEN 'none' ELSE 'build' END FROM s
""")
def artifact_reconcile(spark, sf_dir):
    name = ops.artifact_name(F.concat("bucket", F.lit("-"), "key"), F.col("mtime").cast("string"))
    wanted = objects(spark, sf_dir).select(name.alias("artifact"), "mtime")
    local, remote = wanted.where("mtime % 2 = 0"), wanted.where("mtime % 3 = 0")
    plans = [
        ops.reconcile_artifacts(wanted, local, remote, env).withColumn("env", F.lit(env)) for env in ("aws", "kind")
    ]
    return plans[0].unionByName(plans[1])


@query("bulk_upload", f"""
WITH {FILES_SQL}
SELECT 'repo/' || path AS path, 'artifacts/v1/' || path AS dest_key FROM files
""")
def bulk_upload(spark, sf_dir):
    tree = files(spark, sf_dir).select(F.concat(F.lit("repo/"), "path").alias("path"))
    return ops.upload_manifest(tree, "repo/", "artifacts/v1")


@query("bulk_fetch", f"""
WITH {OBJECTS_SQL}, flat AS (SELECT string_split(key, '/')[-1] AS name, key FROM obj)
SELECT name, max(key) AS winner, count(*) AS n_sources FROM flat GROUP BY name HAVING count(*) > 1
""")
def bulk_fetch(spark, sf_dir):
    """Names that collide when all pages are fetched into one directory."""
    return ops.fetch_collisions(objects(spark, sf_dir))


@query("delete_by_prefix", f"WITH {OBJECTS_SQL} SELECT * FROM obj WHERE NOT starts_with(key, 'en/')")
def delete_by_prefix(spark, sf_dir):
    return ops.delete_by_prefix(objects(spark, sf_dir), "en/")


@query("delete_objects", f"WITH {OBJECTS_SQL} SELECT * FROM obj WHERE size >= 3000")
def delete_objects(spark, sf_dir):
    """Delete the small objects by key."""
    listing = objects(spark, sf_dir)
    return ops.delete_objects(listing, listing.where("size < 3000"))


@query("claim_pairs", f"""
WITH {OBJECTS_SQL}
SELECT bucket || '/' || key AS claim, CASE WHEN mtime % 3 > 0 THEN 'pv-' || mtime END AS volume
FROM obj WHERE contains(bucket || '/' || key, '.org/')
""")
def claim_pairs(spark, sf_dir):
    claims = objects(spark, sf_dir).select(
        F.struct(F.concat("bucket", F.lit("/"), "key").alias("name")).alias("metadata"),
        F.struct(
            F.when(F.col("mtime") % 3 > 0, F.concat(F.lit("pv-"), "mtime")).alias("volumeName")
        ).alias("spec"),
    )
    return status.claim_pairs(claims, ".org/")


@query("ingress_value", f"""
WITH {OBJECTS_SQL}
SELECT key, CASE WHEN mtime % 4 > 0 THEN '10.0.0.' || mtime END AS ip,
       CASE WHEN mtime % 4 > 1 THEN bucket END AS hostname
FROM obj
""")
def ingress_value(spark, sf_dir):
    """Each 4th service has no ingress; every 4th after it only an address."""
    entry = F.struct(
        F.concat(F.lit("10.0.0."), "mtime").alias("ip"),
        F.when(F.col("mtime") % 4 > 1, F.col("bucket")).alias("hostname"),
    )
    other = F.struct(F.lit("10.9.9.9").alias("ip"), F.lit("spare").alias("hostname"))
    ingress = F.when(F.col("mtime") % 4 > 0, F.array(entry, other))
    return objects(spark, sf_dir).select(
        "key", first_ingress(ingress, "ip").alias("ip"), first_ingress(ingress, "hostname").alias("hostname")
    )
