"""Sources and writers on temporary directories."""

from __future__ import annotations

import errno
import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.functions import text as fx
from millrace.functions.jsons import beautified_json
from millrace.functions.names import valid_dir, valid_file
from millrace.operators import messages, objects
from millrace.sources import files, writers


@pytest.fixture
def tree(tmp_path):
    contents = {
        "en/a.json": '{"b": 1, "a": "é"}',
        "en/b.json.bak": "[1]",
        "en/sub/c.json": "{}",
        "es/d.txt": "x" * 100,
        "e.txt": "plain",
        "conf/app.properties": 'lang=en\n# note\nname="#lang#-x"\n\n',
        "conf/x.yaml.tmpl": "a: #a#\nb: b\nc: #a# #z#\n",
    }
    for name, text in contents.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    return tmp_path


def test_list_by_text_prefix(spark, tree):
    def keys(prefix):
        return {r.key for r in files.list_objects(spark, str(tree), prefix).collect()}

    assert keys("e") == {"en/a.json", "en/b.json.bak", "en/sub/c.json", "es/d.txt", "e.txt"}
    assert keys("en/") == {"en/a.json", "en/b.json.bak", "en/sub/c.json"}
    assert keys("en/s") == {"en/sub/c.json"}
    assert keys("nowhere/") == set()
    row = files.list_objects(spark, f"file://{tree}", "es/", bucket="b").first()
    assert (row.bucket, row.key, row.size) == ("b", "es/d.txt", 100)
    assert objects.bucket_names(files.list_objects(spark, str(tree))).count() == 1


def test_listing_reads_no_contents(spark, tree):
    plan = files.list_objects(spark, str(tree))._jdf.queryExecution().executedPlan().toString()
    assert "content#" not in plan and "length#" in plan


def test_json_files_of_one_directory(spark, tree):
    got = {os.path.basename(r.path): r.body for r in files.json_files(spark, str(tree / "en")).collect()}
    assert got == {"a.json": '{"b": 1, "a": "é"}', "b.json.bak": "[1]"}


def test_beautify_directory(spark, tree):
    docs = files.json_files(spark, str(tree / "en")).where(F.col("path").endswith(".json"))
    pretty = docs.select(
        F.concat(F.lit(str(tree) + "/BEAUTY/"), F.regexp_extract("path", "([^/]+)\\.json$", 1), F.lit("_pretty.json")).alias("path"),
        beautified_json(F.col("body")).alias("text"),
    )
    report = writers.write_text_files(pretty).collect()
    assert [r.ok for r in report] == [True]
    written = (tree / "BEAUTY/a_pretty.json").read_text(encoding="utf-8")
    assert written == json.dumps({"b": 1, "a": "é"}, indent=4, ensure_ascii=False)


def test_render_templates_over_old_files(spark, tree):
    (tree / "conf/x.yaml").write_text("old and much longer than the new one" * 9)
    variables = F.array(
        F.struct(F.lit("#a#").alias("k"), F.lit("1").alias("v")), F.struct(F.lit("#z#").alias("k"), F.lit("2").alias("v"))
    )
    rendered = files.template_files(spark, str(tree)).select(
        F.replace("path", F.lit(".tmpl"), F.lit("")).alias("path"), fx.render_text(F.col("text"), variables).alias("text")
    )
    assert writers.write_text_files(rendered).where("ok").count() == 1
    assert (tree / "conf/x.yaml").read_text() == "a: 1\nb: b\nc: 1 2\n"
    assert not [p for p in os.listdir(tree / "conf") if ".part-" in p]


def test_properties_files(spark, tree):
    rows = files.properties_files(spark, str(tree)).orderBy("seq").collect()
    assert [(r.key, r.value, r.is_comment) for r in rows] == [
        ("lang", "en", False), (None, "note", True), ("name", '"#lang#-x"', False),
    ]


def test_fetch_into_one_directory(spark, tree, tmp_path):
    (tree / "es/a.json").write_text("later")
    listing = files.list_objects(spark, str(tree))
    plan = objects.fetch_plan(listing.where("key LIKE 'e%'"), str(tmp_path / "flat")).select(
        F.concat(F.lit(str(tree) + "/"), "key").alias("src"), "dest"
    )
    missing = spark.createDataFrame([(str(tree / "gone"), str(tmp_path / "flat/gone"))], "src string, dest string")
    report = {os.path.basename(r.path): r for r in writers.copy_files(plan.unionByName(missing), tasks=3).collect()}
    assert report["a.json"].ok and not report["gone"].ok and report["gone"].error
    assert (tmp_path / "flat/a.json").read_text() == "later"
    assert objects.fetch_collisions(listing).where("name = 'a.json'").first().n_sources == 2


def test_upload_sync_and_delete(spark, tree, tmp_path):
    paths = files.list_objects(spark, str(tree)).where("key LIKE 'en/%'").select(
        F.concat(F.lit(str(tree) + "/"), "key").alias("path")
    )
    manifest = objects.upload_manifest(paths, str(tree) + "/", "v1")
    target = tmp_path / "bucket"
    copied = writers.copy_files(
        manifest.withColumn("dest", F.concat(F.lit(f"{target}/"), "dest_key")), src="path"
    )
    assert copied.where("ok").count() == 3
    assert (target / "v1/en/sub/c.json").exists()
    source = files.list_objects(spark, str(tree))
    there = files.list_objects(spark, str(target))
    plan = objects.sync_plan(source, there, "en", "v1/en")
    assert plan.count() == 0
    (target / "v1/en/sub/c.json").write_text("changed")
    there = files.list_objects(spark, str(target))
    assert [(r.dest_key, r.reason) for r in objects.sync_plan(source, there, "en", "v1/en").collect()] == [
        ("v1/en/sub/c.json", "size")
    ]
    doomed = there.where("key LIKE 'v1/en/sub/%'").select(F.concat(F.lit(f"{target}/"), "key").alias("path"))
    assert writers.delete_files(doomed).where("ok").count() == 1
    assert not (target / "v1/en/sub/c.json").exists()


def test_clone_tree(spark, tree, tmp_path):
    texts = files.text_files(spark, str(tree)).withColumn(
        "path", F.concat(F.lit("m/"), F.regexp_extract("path", f"{fx.like_literal(str(tree))}/(.*)$", 1))
    )
    plan = objects.clone_plan(texts, "en", "fr", ["conf"], [".bak"]).select(
        F.concat(F.lit(f"{tmp_path}/out/"), "new_path").alias("path"), fx.rename_text(F.col("text"), "plain", "fancy").alias("text")
    )
    assert writers.write_text_files(plan).where("ok").count() == 4
    assert (tmp_path / "out/m/fr/a.json").exists() and not (tmp_path / "out/m/conf").exists()
    assert (tmp_path / "out/m/e.txt").read_text() == "fancy"


def test_walk_lists_in_the_tasks(spark, tree):
    (tree / ".hidden/x").mkdir(parents=True)
    (tree / ".hidden/x/in.txt").write_text("1")
    (tree / "target/deep/er").mkdir(parents=True)
    (tree / "target/deep/er/out.txt").write_text("22")
    os.symlink(tree / "en", tree / "linked")

    def walked(**tests):
        rows = files.walk_tree(spark, str(tree), tasks=3, **tests).collect()
        return {os.path.relpath(r.path, tree): (r.size, r.depth) for r in rows}

    everything = walked()
    assert everything[".hidden/x/in.txt"] == (1, 2) and everything["target/deep/er/out.txt"] == (2, 3)
    assert not any(p.startswith("linked") for p in everything)
    pruned = walked(
        dir_test=lambda d: valid_dir(d, ["target"]), file_test=lambda f: valid_file(f, [".txt", ".tmpl"])
    )
    assert set(pruned) == {"en/a.json", "en/b.json.bak", "en/sub/c.json", "conf/app.properties"}
    want = {
        os.path.relpath(os.path.join(d, f), tree) for d, _, names in os.walk(tree) for f in names
    }
    assert set(everything) == want


def test_walk_follows_links_once(spark, tree, tmp_path_factory):
    """Links out of the tree, to its root and to each other: every directory is listed once, and the walk ends."""
    other = tmp_path_factory.mktemp("other")
    (other / "sub").mkdir()
    (other / "sub/far.txt").write_text("333")
    os.symlink(other, tree / "linked")
    os.symlink(other / "sub", tree / "en" / "twice")
    os.symlink(tree, other / "sub" / "loop")
    os.symlink(tree, tree / "self")
    rows = files.walk_tree(spark, str(tree), follow_links=True).collect()
    paths = sorted(os.path.relpath(r.path, tree) for r in rows)
    plain = {os.path.relpath(r.path, tree) for r in files.walk_tree(spark, str(tree)).collect()}
    assert set(paths) == plain | {"en/twice/far.txt"} and len(paths) == len(set(paths))


def test_clone_to_another_root(spark):
    rows = [("a/en/x-en-1.txt", "en"), ("a/en/en/y.txt", ""), ("a/en/z.iml", ""), ("other/en/x", ""), ("a/ens/q_en_r", "")]
    plan = objects.clone_plan(spark.createDataFrame(rows, "path string, text string"), "en", "fr", (), [".iml"], "a", "b/en/")
    assert {(r.path, r.new_path) for r in plan.collect()} == {
        ("a/en/x-en-1.txt", "b/en/fr/x-fr-1.txt"), ("a/en/en/y.txt", "b/en/fr/en/y.txt"), ("a/ens/q_en_r", "b/en/ens/q_fr_r"),
    }


def test_walk_reports_what_it_cannot_read(spark, tree):
    gone = files.walk_tree(spark, str(tree / "nowhere"), errors=True).collect()
    assert len(gone) == 1 and gone[0].depth is None
    assert files.walk_tree(spark, str(tree / "nowhere")).count() == 0


def test_rows_without_path_or_text_are_reported(spark, tmp_path):
    rows = [(f"{tmp_path}/a", "x"), (None, "y"), (f"{tmp_path}/b", None), (f"{tmp_path}/c", "")]
    report = writers.write_text_files(spark.createDataFrame(rows, "path string, text string")).collect()
    assert {(r.path, r.n_bytes, r.ok, r.error) for r in report} == {
        (f"{tmp_path}/a", 1, True, None), (None, 0, False, "no path"), (f"{tmp_path}/b", 0, False, "no text"), (f"{tmp_path}/c", 0, True, None),
    }
    plan = spark.createDataFrame([(f"{tmp_path}/a", f"{tmp_path}/d"), (None, f"{tmp_path}/e"), (f"{tmp_path}/a", None)], "src string, dest string")
    assert {(r.path, r.ok, r.error) for r in writers.copy_files(plan).collect()} == {(f"{tmp_path}/d", True, None), (f"{tmp_path}/e", False, "no source"), (None, False, "no path")}
    assert [r.ok for r in writers.delete_files(spark.createDataFrame([(None,)], "path string")).collect()] == [False]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "c", "d"]


def test_files_are_read_by_name(spark, tmp_path):
    """Present, absent, broken, unreadable and repeated names; other files of the directory are never touched."""
    bodies = {"1": b'{"b":1,"a":2}', "2": b'{"a":', "3": b"\xff\xfe", "4": b""}
    for name, body in bodies.items():
        (tmp_path / f"bot_{name}.json").write_bytes(body)
    (tmp_path / "bot_5.json").mkdir()
    for n in range(50):
        (tmp_path / f"other_{n}.json").write_text("{}")
    ids = spark.createDataFrame([("1",), ("1",), ("2",), ("3",), ("4",), ("5",), ("6",), (None,)], "id string")
    sent = messages.replay_files(ids, f"{tmp_path}/bot_").collect()
    assert sorted((r.key or "", r.value, r.status) for r in sent) == [
        ("", None, "missing"), ("1", '{"a":2,"b":1}', "sent"), ("1", '{"a":2,"b":1}', "sent"), ("2", None, "malformed"), ("3", None, "unreadable"),
        ("4", None, "malformed"), ("5", None, "unreadable"), ("6", None, "missing"),
    ]


def test_large_directories_come_in_batches(spark, tmp_path, monkeypatch):
    """No batch of a listing grows with its directory; names, sizes, times and links to nowhere are as they are."""
    for n in range(25):
        (tmp_path / f"f{n}").write_text("x" * n)
    os.symlink(tmp_path / "nowhere", tmp_path / "dangling")
    monkeypatch.setattr(files, "ENTRIES_AT_ONCE", 10)
    batch = pa.RecordBatch.from_pydict({"path": [str(tmp_path)]})
    found = list(files._lister(False)(iter([batch])))
    assert max(b.num_rows for b in found) <= 10 and sum(b.num_rows for b in found) == 26
    rows = {r.name: r for r in files.walk_tree(spark, str(tmp_path)).withColumn("us", F.unix_micros("mtime")).collect()}
    assert {n: r.size for n, r in rows.items()} == {f"f{n}": n for n in range(25)} | {"dangling": None}
    assert rows["f7"].us == os.stat(tmp_path / "f7").st_mtime_ns // 1000


def test_a_large_directory_is_listed_by_several_tasks(spark, tmp_path, monkeypatch):
    """Each name comes once, from one of the tasks; so do the error and the directories below, also those behind links."""
    for n in range(60):
        (tmp_path / f"f{n}é.json").write_text("x" * n)
    for n in range(5):
        (tmp_path / f"d{n}").mkdir()
        (tmp_path / f"d{n}/in").write_text("1")
    os.symlink(tmp_path, tmp_path / "d0" / "loop")
    monkeypatch.setattr(files, "TURN_BYTES", 1, raising=False)
    want = {f"f{n}é.json": n for n in range(60)} | {f"d{n}/in": 1 for n in range(5)}
    for follow in (False, True):
        walked = files.walk_tree(spark, str(tmp_path), tasks=4, follow_links=follow)
        rows = walked.withColumn("task", F.input_file_name()).collect()
        assert sorted((os.path.relpath(r.path, tmp_path), r.size) for r in rows) == sorted(want.items())
        assert len({r.task for r in rows if r.depth == 0}) == 4
    assert sorted(len(r.body) for r in files.json_files(spark, str(tmp_path)).collect()) == list(range(60))
    monkeypatch.setattr(files, "_turns", lambda uri, size=None: 9, raising=False)
    assert [(r.depth, r.size) for r in files.walk_tree(spark, str(tmp_path / "nowhere"), errors=True).collect()] == [(None, None)]


def test_json_files_of_a_glob_are_opened_by_the_tasks(spark, tmp_path):
    """Odd names, bytes that are no UTF-8, directories that the glob leaves out; rows as Spark's reader gives them, without its list of files."""
    for name, body in {
        "a/1.json": b"{}", "a/x y%41#.json": b"[1]", "a/_skip.json": b"", "a/.skip.json": b"", "a/b.json.bak": "\ufeffé".encode(), "a/no.txt": b"",
        "b1/bad.json": b"\xff", "b1/empty.json": b"", "c/other.json": b"2", ".hid/in.json": b"", "a/deep/in.json": b"",
    }.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    (tmp_path / "a/dir.json").mkdir()
    for glob in ("*", "{a,b?}", "[ab]*", "a"):
        got = files.json_files(spark, f"{tmp_path}/{glob}")
        want = files.text_files(spark, f"{tmp_path}/{glob}", "*.json*", recursive=False).withColumnRenamed("text", "body")
        assert "FileScan text" not in got._jdf.queryExecution().executedPlan().toString()
        seen = lambda df: sorted(map(tuple, df.select("path", F.col("body").cast("binary")).collect()))
        empty = [] if glob == "a" else [(f"file:{tmp_path}/b1/empty.json", b"")]  # the reader leaves out empty files
        assert seen(got) == sorted(seen(want) + empty)
    with pytest.raises(FileNotFoundError):
        files.json_files(spark, f"{tmp_path}/none*")
    with pytest.raises(OSError):
        files.json_files(spark, f"{tmp_path}/none")


@pytest.mark.parametrize("nameless", [True, False])
def test_files_appear_whole_and_replace_others(tmp_path, monkeypatch, nameless):
    """While a file is written its directory does not change; it replaces an old one, and a failure leaves nothing."""
    if not nameless:
        monkeypatch.setattr(writers, "_nameless", lambda folder: None)
    elif writers._nameless(str(tmp_path)) is None:
        pytest.skip("no nameless files here")
    target = tmp_path / "new/dir/f"

    def chunks():
        yield b"one"
        assert not target.exists() and (not nameless or not list(target.parent.iterdir()))
        yield b"two"

    assert writers._put(str(target), chunks()) == 6 and target.read_bytes() == b"onetwo"
    assert writers._put(f"file://{target}", iter([b"3"])) == 1 and target.read_bytes() == b"3"
    (target.parent / "d").mkdir()
    assert writers._reported(str(target.parent / "d"), lambda: iter([b"x"]))[2] is False
    assert sorted(p.name for p in target.parent.iterdir()) == ["d", "f"]


def test_texts_are_written_byte_by_byte_and_no_file_stays_open(spark, tmp_path):
    """Bytes that are no UTF-8 are a text for Spark, so they are written as they are; failures close their files too."""
    rows = spark.createDataFrame([(f"{tmp_path}/a", bytearray(b"\xff\xfex"))], "path string, text binary")
    assert [(r.n_bytes, r.ok) for r in writers.write_text_files(rows.withColumn("text", F.expr("CAST(text AS STRING)"))).collect()] == [(3, True)]
    assert (tmp_path / "a").read_bytes() == b"\xff\xfex"

    def broken():
        yield b"one"
        raise OSError("gone")

    before = len(os.listdir("/proc/self/fd"))
    for n in range(10):
        assert writers._reported(f"{tmp_path}/b{n % 2}", lambda: iter([b"x"]))[2] and not writers._reported(f"{tmp_path}/c", broken)[2]
    assert len(os.listdir("/proc/self/fd")) == before


def test_replayed_files_are_written_by_many_tasks(spark, sf_dir, monkeypatch):
    """A small table comes in one split; its files, which cost far more than its bytes, are not written by one task."""
    from millrace.plans import trees

    seen = []
    write = writers.cut_lineage
    monkeypatch.setattr(writers, "cut_lineage", lambda df: seen.append(df.rdd.getNumPartitions()) or write(df))
    trees.replay_files(spark, sf_dir)
    assert seen[0] >= spark.sparkContext.defaultParallelism


def test_plain_names_need_no_parsing():
    """Names that mean the same as a path and in a URI share one file system object; whatever else is parsed as before."""
    from pyarrow import fs

    assert writers.open_uri("/a/b.json")[0] is writers.open_uri("file:/c")[0]
    odd = ["/a b", "/a%20b", "file:///a%20b", "/a//b", "/a/", "/a/../b", "/a/./b", "/a/..", "/é/x", "/"]
    for uri in ["/a", "/a/b.c/..d/e...", "/a+b/c=1,2/_x-y", "file:///a+b/c=1,2/_x-y", *odd]:
        system, path = fs.FileSystem.from_uri(uri)
        assert writers.open_uri(uri) == (system, path) and isinstance(system, fs.LocalFileSystem), uri
    assert writers.open_uri("file:/a/b.json")[1] == "/a/b.json" == writers.open_uri("file:///a/b.json")[1]


def test_nameless_files_are_tried_once_where_there_are_none(tmp_path, monkeypatch):
    """A file system without nameless files is asked once a folder, not twice a file; short writes go on."""
    real, asked, write = os.open, [], os.write

    def refuse(path, flags, *more, **named):
        if flags & os.O_TMPFILE == os.O_TMPFILE:
            asked.append(path)
            raise OSError(errno.ENOENT if not os.path.isdir(path) else errno.EOPNOTSUPP, "no such files here")
        return real(path, flags, *more, **named)

    monkeypatch.setattr(os, "open", refuse)
    monkeypatch.setattr(os, "write", lambda fd, data: write(fd, data[:2]))
    for n in range(5):
        assert writers._put(f"{tmp_path}/new/{n}", iter([b"one", b"", b"three"])) == 8
    assert len(asked) == 2 and sorted(p.read_bytes() for p in (tmp_path / "new").iterdir()) == [b"onethree"] * 5
