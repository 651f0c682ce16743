"""Object and file sets: list, filter, look up, plan copies, reconcile, delete.

A listing is a DataFrame of keys (and sizes, times); no operator reads contents.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.constants import IGNORED_DIRS, LOCAL_ENVS
from millrace.functions.names import (
    dir_segments,
    ends_with_any,
    file_name,
    parent_dir,
    relative_key,
    rstrip,
    valid_dir,
    valid_file,
)
from millrace.functions.text import rename_path
from millrace.operators.ranking import latest_by
from millrace.operators.skew import spread_join

NameTest = Callable[[Column], Column]


def list_prefix(listing: DataFrame, prefix: str = "") -> DataFrame:
    """Objects whose key starts with the prefix text; keys lose trailing blanks."""
    return listing.where(F.col("key").startswith(prefix)).withColumn("key", rstrip(F.col("key")))


def bucket_names(listing: DataFrame) -> DataFrame:
    return listing.select("bucket").distinct()


def filtered_walk(
    files: DataFrame,
    forbidden_dirs: Sequence[str] = (),
    forbidden_files: Sequence[str] = (),
    dir_test: NameTest | None = None,
    file_test: NameTest | None = None,
) -> DataFrame:
    """Files of a tree; a refused directory takes its whole subtree with it.

    Adds ``dirpath``, ``name`` and ``depth``: order by depth for a top-down
    walk, by descending depth for bottom-up.
    """
    keep_dir = dir_test or (lambda name: valid_dir(name, forbidden_dirs))
    keep_file = file_test or (lambda name: valid_file(name, forbidden_files))
    segments = dir_segments(F.col("path"))
    name = file_name(F.col("path"))
    return files.where(F.forall(segments, keep_dir) & keep_file(name)).select(
        "*",
        F.array_join(segments, "/").alias("dirpath"),
        name.alias("name"),
        F.size(segments).alias("depth"),
    )


def _searched(path: Column, ignored_dirs: Sequence[str]) -> Column:
    """Whether the directory right above a file is searched at all."""
    above = F.coalesce(parent_dir(path), F.lit(""))
    return ~above.isin(list(ignored_dirs)) if ignored_dirs else F.lit(True)


def template_listing(files: DataFrame, ignored_dirs: Sequence[str] = IGNORED_DIRS) -> DataFrame:
    """Template files, but for those right below an ignored directory."""
    path = F.col("path")
    return files.where(path.endswith(".tmpl") & _searched(path, ignored_dirs))


def remove_non_templates(files: DataFrame, ignored_dirs: Sequence[str] = IGNORED_DIRS) -> DataFrame:
    """Files left once rendered ``.yaml`` and ``.json`` files are deleted."""
    path = F.col("path")
    return files.where(~(ends_with_any(path, [".yaml", ".json"]) & _searched(path, ignored_dirs)))


def names_matching(files: DataFrame, pattern: str, directory: str | None = None) -> DataFrame:
    """Files whose name has a match of the pattern, of one directory or of all."""
    path = F.col("path")
    hit = file_name(path).rlike(pattern)
    if directory is not None:
        hit = hit & (F.array_join(dir_segments(path), "/") == directory)
    return files.where(hit)


def objects_exist(requests: DataFrame, listing: DataFrame) -> DataFrame:
    """For each (bucket, prefix, name) whether ``prefix/name`` is listed; trailing blanks count on neither side."""
    there = listing.select("bucket", rstrip(F.col("key")).alias("_key"), F.lit(True).alias("_there")).distinct()
    wanted = requests.withColumn("_key", rstrip(F.concat("prefix", F.lit("/"), "name")))
    return (
        wanted.join(there, ["bucket", "_key"], "left")
        .withColumn("found", F.coalesce("_there", F.lit(False)))
        .drop("_key", "_there")
    )


def _newest(listing: DataFrame) -> DataFrame:
    """One row per key, its newest version: a listing may name a key more than once, as one of versions does."""
    return latest_by(listing.select("key", "size", "mtime"), ["key"], ["mtime", "size"])


def _reason() -> Column:
    """Why an object is copied over the one with ``_size`` and ``_mtime``; NULL if it is not."""
    return (
        F.when(F.col("_size").isNull(), "missing")
        .when(F.col("size") != F.col("_size"), "size")
        .when(F.col("mtime") > F.col("_mtime"), "newer")
    )


def sync_plan(
    source: DataFrame, destination: DataFrame, src_prefix: str, dest_prefix: str | None = None
) -> DataFrame:
    """What to copy: absent, of another size, or older at the destination.

    A prefix is a directory here. Nothing is ever deleted. A key is copied once: where a
    listing names it more than once, its newest version counts.
    """
    src_dir = src_prefix.rstrip("/") + "/"
    dest_dir = (src_prefix if dest_prefix is None else dest_prefix).rstrip("/") + "/"

    def below(listing: DataFrame, folder: str) -> DataFrame:
        return _newest(listing.where(F.col("key").startswith(folder))).withColumn(
            "_rel", relative_key(F.col("key"), folder)
        )

    there = below(destination, dest_dir).select(
        "_rel", F.col("size").alias("_size"), F.col("mtime").alias("_mtime")
    )
    return (
        below(source, src_dir)
        .join(there, "_rel", "left")
        .withColumn("reason", _reason())
        .where(F.col("reason").isNotNull())
        .select(
            F.col("key").alias("src_key"),
            F.concat(F.lit(dest_dir), "_rel").alias("dest_key"),
            "size",
            "reason",
        )
    )


def sync_pairs(source: DataFrame, destination: DataFrame, pairs: DataFrame, longest: bool = False) -> DataFrame:
    """One sync plan for all ``pairs`` (src_prefix, dest_prefix; a null dest_prefix is the src_prefix): what ``sync_plan`` says for each.

    Keys meet pairs by equality with one of their directories, so neither the plan nor the work grows with
    pairs times keys. Prefixes may lie inside each other: a key is copied for each pair above it, or with
    ``longest`` for the deepest one only. Of a key that is listed more than once the newest version counts.
    """
    folder = lambda c: F.concat(F.rtrim(F.col(c), F.lit("/")), F.lit("/"))
    wanted = pairs.withColumn("dest_prefix", F.coalesce("dest_prefix", "src_prefix")).select(
        "src_prefix", "dest_prefix", folder("src_prefix").alias("_dir"), folder("dest_prefix").alias("_dest_dir")
    ).distinct()
    parts = F.split("key", "/")
    depths = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1))
    dirs = F.transform(depths, lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/")))
    placed = spread_join(_newest(source).select("key", "size", "mtime", F.explode(dirs).alias("_dir")), wanted, ["_dir"], ["key"])
    if longest:
        deepest = placed.groupBy("key").agg(F.max(F.length("_dir")).alias("_most"))
        placed = placed.join(deepest, "key").where(F.length("_dir") == F.col("_most")).drop("_most")
    placed = placed.withColumn("dest_key", F.concat("_dest_dir", F.substring(F.col("key"), F.length("_dir") + 1, F.length("key"))))
    there = _newest(destination).select(F.col("key").alias("dest_key"), F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    return placed.join(there, "dest_key", "left").withColumn("reason", _reason()).where(F.col("reason").isNotNull()).select(
        "src_prefix", "dest_prefix", F.col("key").alias("src_key"), "dest_key", "size", "reason"
    )


def sync_many(source: DataFrame, destination: DataFrame, src: str, dest: str, names: Sequence[str]) -> DataFrame:
    """One sync plan for several names below a source and a destination path."""
    pairs = source.sparkSession.createDataFrame([(f"{src}/{n}", f"{dest}/{n}") for n in names], "src_prefix string, dest_prefix string")
    return sync_pairs(source, destination, pairs).select("src_key", "dest_key", "size", "reason")


def artifact_name(name: Column, commit: Column) -> Column:
    return F.concat(name, F.lit("-"), commit, F.lit(".jar"))


def reconcile_artifacts(
    wanted: DataFrame, local: DataFrame, remote: DataFrame, runtime_env: str, push: bool = True
) -> DataFrame:
    """What to do for each wanted ``artifact``: build, download, push, both or none.

    The three sets are merged by one aggregation instead of two joins.
    """

    def flagged(df: DataFrame, flag: str) -> DataFrame:
        flags = [F.lit(f == flag).alias(f) for f in ("wanted", "local", "remote")]
        return df.select("artifact", *flags)

    state = (
        flagged(wanted, "wanted")
        .unionByName(flagged(local, "local"))
        .unionByName(flagged(remote, "remote"))
        .groupBy("artifact")
        .agg(*[F.bool_or(f).alias(f) for f in ("wanted", "local", "remote")])
        .where("wanted")
        .drop("wanted")
    )
    here, there = F.col("local"), F.col("remote")
    if runtime_env in LOCAL_ENVS:
        action = F.when(~here, "build").otherwise("none")
    else:
        action = (
            F.when(there & ~here, "download")
            .when(there, "none")
            .when(~here, "build+push" if push else "build")
            .otherwise("push" if push else "none")
        )
    return state.withColumn("action", action)


def upload_manifest(files: DataFrame, source: str, prefix: str) -> DataFrame:
    """Destination key of each file below ``source``: prefix, relative path."""
    folder = source.rstrip("/") + "/"
    path = F.col("path")
    return files.where(path.startswith(folder)).withColumn(
        "dest_key", F.concat(F.lit(prefix.rstrip("/") + "/"), relative_key(path, folder))
    )


def fetch_plan(listing: DataFrame, dest: str) -> DataFrame:
    """Where each object lands in one flat directory; the last key listed wins a name."""
    winners = listing.groupBy(file_name(F.col("key")).alias("name")).agg(
        F.max("key").alias("key"), F.count(F.lit(1)).alias("n_sources")
    )
    return winners.withColumn("dest", F.concat(F.lit(dest.rstrip("/") + "/"), "name"))


def fetch_collisions(listing: DataFrame) -> DataFrame:
    """Names that several objects would take, and the key that ends up there."""
    return fetch_plan(listing, "").where("n_sources > 1").select("name", F.col("key").alias("winner"), "n_sources")


def delete_by_prefix(listing: DataFrame, prefix: str = "") -> DataFrame:
    """Objects left once all below a prefix are deleted."""
    return listing.where(~F.col("key").startswith(prefix))


def delete_objects(listing: DataFrame, deleted: DataFrame) -> DataFrame:
    """Objects left once single keys are deleted."""
    return listing.join(deleted.select("bucket", "key").distinct(), ["bucket", "key"], "left_anti")


def clone_plan(
    files: DataFrame,
    origin: str,
    target: str,
    ignored_dirs: Sequence[str] = IGNORED_DIRS,
    ignored_files: Sequence[str] = (),
    origin_root: str | None = None,
    target_root: str | None = None,
) -> DataFrame:
    """Files of a tree to clone: none below a directory with an ignored ending.

    With the two roots, only files below ``origin_root`` are cloned; they move to ``target_root``, and names change
    below it, so that a root that happens to hold the old name stays.
    """
    if origin_root is not None:
        old, new = origin_root.rstrip("/") + "/", (origin_root if target_root is None else target_root).rstrip("/") + "/"
        below = files.where(F.col("path").startswith(old)).withColumn("_full", F.col("path")).withColumn("path", relative_key(F.col("path"), old))
        plan = clone_plan(below, origin, target, ignored_dirs, ignored_files)
        # a directory right below the root is named between two slashes, too
        inner = F.substring(rename_path(F.concat(F.lit("/"), "path"), origin, target), 2, 1 << 30)
        return plan.withColumn("new_path", F.concat(F.lit(new), inner)).withColumn("path", F.col("_full")).drop("_full")
    kept = filtered_walk(
        files,
        dir_test=lambda d: ~ends_with_any(d, ignored_dirs),
        file_test=lambda f: ~ends_with_any(f, ignored_files),
    )
    return kept.withColumn("new_path", rename_path(F.col("path"), origin, target)).drop("dirpath", "name", "depth")
