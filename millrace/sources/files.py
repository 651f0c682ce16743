"""File sources: object listings, tree walks, whole JSON and text files, properties.

Spark's own readers skip files and directories whose name starts with ``_`` or
``.``, and keep the list of files on the driver; ``walk_tree`` does neither, ``json_files`` only the first.
"""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from math import ceil
from urllib.parse import quote
from zlib import crc32

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.names import rstrip
from millrace.functions.text import parse_property, property_lines
from millrace.session import cut_lineage
from millrace.sources.writers import open_uri, read_blocks

LISTING = "path string, size long, mtime timestamp"


def _below(path: Column, root: str) -> Column:
    """The part of a full path below ``root``, however the scheme is written."""
    folder = root.split("://", 1)[-1].rstrip("/") + "/"
    folder = folder if folder.startswith("/") or "://" in root else "/" + folder
    return F.substring(path, F.position(F.lit(folder), path) + len(folder), F.length(path))


def list_objects(spark: SparkSession, root: str, prefix: str = "", bucket: str | None = None) -> DataFrame:
    """bucket, key, size, mtime of the objects below ``root`` whose key starts with ``prefix``.

    Only the deepest whole directory of the prefix is listed; contents are not
    read. Nothing found gives no rows.
    """
    folder, _, _ = prefix.rpartition("/")
    start = f"{root.rstrip('/')}/{folder}" if folder else root
    try:
        found = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .load(start)
            .select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
        )
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], LISTING)
    name = bucket if bucket is not None else root.rstrip("/").rpartition("/")[2]
    key = rstrip(_below(F.col("path"), root))
    return found.select(F.lit(name).alias("bucket"), key.alias("key"), "size", "mtime").where(
        F.col("key").startswith(prefix)
    )


def text_files(spark: SparkSession, root: str, name_glob: str | None = None, recursive: bool = True) -> DataFrame:
    """path and text of whole files, one row each; the glob is applied while listing."""
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if name_glob is not None:
        reader = reader.option("pathGlobFilter", name_glob)
    return reader.text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


NAMED = "path string, body string, error string"


def read_named(paths: DataFrame, path: str = "path") -> DataFrame:
    """``path, body, error`` of the files named by the rows, opened by the tasks; no directory is listed.

    A file that is not there has neither body nor error; one that cannot be read, or is no UTF-8, has an
    error. A path that is named often is read once, and each file block by block.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for uri in batch.column("path").to_pylist():
                body = error = None
                try:
                    body = b"".join(read_blocks(uri)).decode("utf-8")
                except FileNotFoundError:
                    pass
                except (OSError, ValueError) as found:
                    error = f"{type(found).__name__}: {found}"
                rows.append((uri, body, error))
                held += len(body or "")
                if held > 8 << 20:
                    yield _named_batch(rows)
                    rows, held = [], 0
            yield _named_batch(rows)

    names = paths.select(F.col(path).alias("path")).where("path IS NOT NULL").distinct()
    return names.mapInArrow(read, NAMED)


def _named_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["path", "body", "error"])


def json_files(spark: SparkSession, directory: str) -> DataFrame:
    """path and body of each file right in the directory whose name holds ``.json``; the directory may be a glob of directories.

    Directories are listed and files opened by the tasks: the driver holds no list, and a file costs no
    split of its own. Names that start with ``_`` or ``.`` are skipped, as Spark's readers do; an empty file has an empty body.
    """
    try:
        open_uri(directory)
    except pa.ArrowInvalid:  # a store that only Spark reads
        return text_files(spark, directory, "*.json*", recursive=False).withColumnRenamed("text", "body")
    if not re.match(r"[a-z0-9+.-]+:/", directory):
        directory = "file:" + _encoded_name(os.path.abspath(directory), keep="?[]{}")
    scheme, rest = re.match(r"([a-z0-9+.-]+:(?://[^/]*)?)(.*)$", directory.rstrip("/")).groups()
    parts = rest.split("/")
    fixed = next((i for i, part in enumerate(parts) if re.search(r"[*?\[{]", part)), len(parts))
    start = ("file:" if scheme == "file://" else scheme) + "/".join(parts[:fixed])
    level = spark.createDataFrame([(start, _turns(start))], "path string, turns int")
    spread = spark.sparkContext.defaultParallelism

    def listed(folders: DataFrame) -> DataFrame:
        return _listed(folders, spread, _lister(True, encode=True))

    for part in parts[fixed:]:
        inner = F.col("name").rlike(_glob_pattern(part)) & ~_skipped(F.col("name"))
        level = listed(level).where(F.col("kind") == "dir").where(inner).select("path", "turns")
    entries = listed(level)
    wrong = entries.where(F.col("kind") == "error").select("path", "name").first()
    if wrong is not None:
        raise OSError(f"{wrong.path}: {wrong.name}")
    wanted = entries.where((F.col("kind") == "file") & F.contains("name", F.lit(".json")) & ~_skipped(F.col("name"))).select("path", "size")
    n, size = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not n and level.isEmpty():
        raise FileNotFoundError(directory)
    tasks = max(spread, ceil(n / 20_000), ceil(size / (64 << 20)))
    return wanted.select("path").repartition(tasks).mapInArrow(_read_bodies, "path string, body binary").select("path", F.col("body").cast("string").alias("body"))


def _skipped(name: Column) -> Column:
    return name.startswith(".") | (name.startswith("_") & ~name.contains("="))


def _encoded_name(name: str, keep: str = "") -> str:
    """A name as Hadoop's paths write it in a URI."""
    return re.sub(r'[%\s"<>\\^`{|}?#\[\]]', lambda m: m[0] if m[0] in keep else quote(m[0]), name)


def _glob_pattern(glob: str) -> str:
    """The regular expression of one part of a glob: ``*``, ``?``, ``[a-c]``, ``{a,b}``."""
    special = {"*": ".*", "?": ".", "{": "(?:", "}": ")", ",": "|", "[": "[", "]": "]", "-": "-"}
    return "^" + "".join(special.get(c, re.escape(c)) for c in glob.replace("[!", "[^")).replace("\\^", "^") + "$"


def _read_bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each file's bytes, handed on in batches of a few megabytes."""
    for batch in batches:
        paths, bodies, held = [], [], 0
        for uri in batch.column("path").to_pylist():
            paths.append(uri)
            bodies.append(b"".join(read_blocks(uri)))
            held += len(bodies[-1])
            if held > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(bodies, pa.binary())], names=["path", "body"])
                paths, bodies, held = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(bodies, pa.binary())], names=["path", "body"])


def template_files(spark: SparkSession, root: str) -> DataFrame:
    return text_files(spark, root, "*.tmpl")


def properties_files(spark: SparkSession, root: str, name_glob: str = "*.properties") -> DataFrame:
    """file, seq, key, value, is_comment: the entries of properties files in order."""
    lines = property_lines(F.col("text"))
    return (
        text_files(spark, root, name_glob)
        .select(F.col("path").alias("file"), F.posexplode(F.transform(lines, parse_property)).alias("seq", "prop"))
        .select("file", "seq", "prop.*")
    )


NameTest = Callable[[Column], Column]
ENTRIES = "kind string, path string, name string, size long, mtime timestamp, real string, turns int"


ENTRY_TYPES = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.string(), pa.int32())
ENTRIES_AT_ONCE = 10_000
TURN_BYTES = 512 << 10  # of a directory itself: about 15,000 names
MOST_TURNS = 16  # every turn reads all names; beyond this, reading them costs more than looking at the files


def _turns(uri: str, size: int | None = None) -> int:
    """How many tasks list a directory, by the size its file system states for the directory itself."""
    from pyarrow import fs

    if size is None:
        try:
            system, path = open_uri(uri)
            size = os.stat(path).st_size if isinstance(system, fs.LocalFileSystem) else 0
        except (OSError, ValueError):
            size = 0
    return min(MOST_TURNS, 1 + size // TURN_BYTES)


def _listed(folders: DataFrame, spread: int, lister) -> DataFrame:
    """The entries of directories, a row with ``path`` and ``turns`` each; the turns of one directory go to different tasks."""
    turns = F.least("turns", F.lit(spread))
    each = folders.select("path", turns.alias("turns"), F.explode(F.sequence(F.lit(0), turns - 1)).alias("turn"))
    place = F.pmod(F.hash("path").cast("long") + F.col("turn"), F.lit(spread)).cast("int")
    return cut_lineage(each.repartitionById(spread, place).mapInArrow(lister, ENTRIES))


def _entries(system, folder: str, turns: int, turn: int) -> Iterator[tuple]:
    """(name, full path, whether it is a directory, size, mtime in microseconds, turns) of what lies in a directory.

    A local directory is read as it goes, however large it is; of several turns, each looks at the files
    that the hash of their names gives it. Other file systems hand out theirs as one list.
    """
    from pyarrow import fs

    if not isinstance(system, fs.LocalFileSystem):
        for info in system.get_file_info(fs.FileSelector(folder)):
            inner = info.type == fs.FileType.Directory
            yield info.base_name, info.path, inner, None if inner else info.size, None if info.mtime_ns is None else info.mtime_ns // 1000, 1
        return
    with os.scandir(folder) as found:
        for entry in found:
            if turns > 1 and crc32(os.fsencode(entry.name)) % turns != turn:
                continue
            try:
                seen = entry.stat()
            except OSError:  # a link to nowhere, or gone by now
                yield entry.name, entry.path, False, None, None, None
                continue
            inner = stat.S_ISDIR(seen.st_mode)
            size = seen.st_size if stat.S_ISREG(seen.st_mode) else None
            yield entry.name, entry.path, inner, size, seen.st_mtime_ns // 1000, _turns(entry.path, seen.st_size) if inner else None


def _lister(follow_links: bool, encode: bool = False):
    """``encode`` makes paths URIs that can be opened whatever names hold."""

    def entries(uri: str, turns: int = 1, turn: int = 0) -> Iterator[tuple]:
        from pyarrow import fs

        below = uri.rstrip("/")
        try:
            system, folder = open_uri(uri)
            local = isinstance(system, fs.LocalFileSystem)
            for name, path, inner, size, mtime, its_turns in _entries(system, folder, turns, turn):
                if inner and not follow_links and local and os.path.islink(path):
                    continue
                real = os.path.realpath(path) if inner and local else path if inner else None
                yield "dir" if inner else "file", f"{below}/{_encoded_name(name) if encode else name}", name, size, mtime, real, its_turns
        except OSError as error:
            yield "error", uri, str(error), None, None, None, None

    def list_directories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The entries of each directory; one that cannot be read gives an error entry."""
        for batch in batches:
            for asked in zip(*[c.to_pylist() for c in batch.columns]):
                rows = []
                for row in entries(*asked):
                    rows.append(row)
                    if len(rows) == ENTRIES_AT_ONCE:
                        yield _entry_batch(rows)
                        rows = []
                yield _entry_batch(rows)

    return list_directories


def _entry_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(ENTRY_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, ENTRY_TYPES)], names=["kind", "path", "name", "size", "mtime", "real", "turns"])


def link_directories(spark: SparkSession, links: Sequence[tuple[str, str]]) -> None:
    """Make each first path of a local file system a link to the second one."""
    for name, target in links:
        os.symlink(open_uri(target)[1], open_uri(name)[1])


def walk_tree(
    spark: SparkSession,
    root: str,
    dir_test: NameTest | None = None,
    file_test: NameTest | None = None,
    tasks: int | None = None,
    errors: bool = False,
    follow_links: bool = False,
) -> DataFrame:
    """path, name, size, mtime and depth of the files of a tree, listed by the tasks.

    One job lists one level of directories, spread over the executors, and
    writes what it finds to the shared folder; a large local directory is listed by several tasks. A refused directory is never
    listed, so its subtree costs nothing. Linked directories are not followed, unless
    ``follow_links``: then a directory is listed at the first level that leads to it, under
    the name that sorts first, and never again, so loops end.
    ``errors`` adds a row, with NULL depth, per directory that cannot be read.
    """
    spread = tasks or spark.sparkContext.defaultParallelism
    top = root.rstrip("/") or "/"
    level = spark.createDataFrame([(top, _real(top), _turns(top))], "path string, real string, turns int")
    found, visited, depth = [], [level.select("real")], 0
    while True:
        listed = _listed(level, spread, _lister(follow_links))
        kept = listed.where(F.col("kind") == "file")
        if file_test is not None:
            kept = kept.where(file_test(F.col("name")))
        found.append(kept.withColumn("depth", F.lit(depth)))
        if errors:
            found.append(listed.where(F.col("kind") == "error").dropDuplicates(["path"]).withColumn("depth", F.lit(None).cast("int")))
        level = listed.where(F.col("kind") == "dir")
        if dir_test is not None:
            level = level.where(dir_test(F.col("name")))
        if follow_links:
            new = level.groupBy("real").agg(F.min("path").alias("path"), F.max("turns").alias("turns"))
            level = cut_lineage(new.join(reduce(DataFrame.unionByName, visited), "real", "left_anti").select("path", "real", "turns"))
            visited.append(level.select("real"))
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found).drop("kind", "real", "turns")
        level, depth = level.select("path", "real", "turns"), depth + 1


def _real(uri: str) -> str:
    from pyarrow import fs

    system, path = open_uri(uri)
    return os.path.realpath(path) if isinstance(system, fs.LocalFileSystem) else path
