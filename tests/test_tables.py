"""Lifecycle of keyed tables and keyspaces."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from millrace.operators import keyed


@pytest.fixture
def keyspace(spark):
    name = f"ks_{uuid.uuid4().hex[:8]}"
    yield name
    keyed.drop_keyspace(spark, name)


def test_create_is_idempotent_and_catalogued(spark, keyspace, tmp_path):
    for _ in range(2):
        keyed.create_table(spark, keyspace, "t", "k bigint, v string", location=f"{tmp_path}/t")
    keyed.create_table(spark, keyspace, "p", "k bigint, day string", ["day"], location=f"{tmp_path}/p")
    rows = keyed.table_catalog(spark, [keyspace]).collect()
    assert {(r.table_name, r.position, r.column_name, r.type) for r in rows} == {
        ("t", 0, "k", "bigint"), ("t", 1, "v", "string"), ("p", 0, "k", "bigint"), ("p", 1, "day", "string"),
    }
    assert keyspace in keyed.list_keyspaces(spark)
    assert keyed.describe_keyspace(spark, keyspace).count() > 0


def test_drop_and_reset(spark, keyspace, tmp_path):
    keyed.create_table(spark, keyspace, "t", "k bigint", location=f"{tmp_path}/t")
    keyed.drop_table(spark, keyspace, "t")
    keyed.drop_table(spark, keyspace, "t")
    assert keyed.table_catalog(spark, [keyspace]).count() == 0
    keyed.create_table(spark, keyspace, "t", "k bigint", location=f"{tmp_path}/t2")
    keyed.reset_keyspace(spark, keyspace)
    assert keyed.table_catalog(spark, [keyspace]).count() == 0
    assert keyspace in keyed.list_keyspaces(spark)
    assert keyed.drop_keyspace(spark, keyspace) is True
    assert keyed.drop_keyspace(spark, keyspace) is False
    keyed.reset_all_keyspaces(spark, [keyspace])
    assert keyspace in keyed.list_keyspaces(spark)


def test_clear_touches_one_keyspace_only(spark, keyspace, tmp_path):
    other = keyspace + "_other"
    for space in (keyspace, other):
        for name in ("a", "b"):
            keyed.create_table(spark, space, name, "k bigint", location=f"{tmp_path}/{space}/{name}")
    assert sorted(keyed.clear_keyspace(spark, keyspace)) == ["a", "b"]
    assert keyed.table_catalog(spark, [keyspace]).count() == 0
    assert keyed.table_catalog(spark, [other]).count() == 2
    keyed.drop_keyspace(spark, other)


def test_upsert_switches_versions(spark, keyspace, tmp_path):
    table = keyed.KeyedTable(spark, keyspace, "t", ["k"], str(tmp_path / "versions"))
    table.create("k bigint, v string, write_ts bigint")
    schema = "k bigint, v string, write_ts bigint"
    table.upsert(spark.createDataFrame([(1, "a", 1), (2, "b", 1)], schema), "v1")
    reader = table.read()
    second = spark.createDataFrame([(2, "c", 2), (3, "d", 2), (1, "old", 0)], schema)
    table.upsert(second, "v2")
    table.upsert(second, "v2")
    assert {tuple(r) for r in table.read().collect()} == {(1, "a", 1), (2, "c", 2), (3, "d", 2)}
    assert {r.k for r in reader.collect()} <= {1, 2, 3}
    table.delete(spark.createDataFrame([(2,)], "k bigint"), "v3")
    assert {r.k for r in table.read().collect()} == {1, 3}


def test_an_upsert_rewrites_only_its_buckets(spark, keyspace, tmp_path):
    schema = "k bigint, v string, write_ts bigint"
    table = keyed.KeyedTable(spark, keyspace, "t", ["k"], str(tmp_path / "t"), buckets=16)
    table.create(schema)
    assert table.read().count() == 0
    table.upsert(spark.range(1000).selectExpr("id AS k", "'a' AS v", "1L AS write_ts"), "v1")
    before = table._folders()
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "t" / "data").rglob("*.parquet")}
    assert len(before) == 16
    one = spark.createDataFrame([(7, "b", 2), (7, "c", 3)], schema)
    table.upsert(one, "v2")
    after = table._folders()
    changed = {b for b in after if after[b] != before[b]}
    assert len(changed) == 1 and after.keys() == before.keys()
    assert {p: p.stat().st_mtime_ns for p in files} == files  # nothing else was written again
    new = [p for p in (tmp_path / "t" / "data").rglob("*.parquet") if p not in files]
    assert {p.parent.name for p in new} == {f"bucket__={changed.pop()}"}
    assert table.read().where("v <> 'a'").collect() == [(7, "c", 3)] and table.read().count() == 1000
    table.delete(spark.range(1000).selectExpr("id AS k").where("k <> 7"), "v3")
    assert [r.k for r in table.read().collect()] == [7] and len(table._folders()) == 1
    table.delete(spark.createDataFrame([(7,)], "k bigint"), "v4")
    assert table.read().count() == 0
    assert table.vacuum(keep=1) == 16 + 1 + 1
    again = keyed.KeyedTable(spark, keyspace, "t", ["k"], str(tmp_path / "t"), buckets=3)
    again.create(schema)
    again.upsert(one, "v5")
    assert again.buckets == 16 and again.read().collect() == [(7, "c", 3)]


def test_a_failed_upsert_changes_nothing(spark, keyspace, tmp_path):
    schema = "k bigint, v string, write_ts bigint"
    table = keyed.KeyedTable(spark, keyspace, "t", ["k"], str(tmp_path / "t"), buckets=4)
    table.create(schema)
    table.upsert(spark.createDataFrame([(1, "a", 1), (2, "b", 1)], schema), "v1")
    bad = spark.createDataFrame([(2, "c", 2)], schema).withColumn("v", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        table.upsert(bad, "v2")
    assert {tuple(r) for r in table.read().collect()} == {(1, "a", 1), (2, "b", 1)}
    table.upsert(spark.createDataFrame([(2, "c", 2)], schema), "v2")
    assert {r.v for r in table.read().collect()} == {"a", "c"}


def test_scans_take_text_columns_and_functions(spark):
    frame = spark.range(100)
    assert keyed.scan_where(frame, "id > 90").count() == 9
    assert keyed.scan_where(frame, F.col("id") > 90).count() == 9
    assert keyed.scan_where(frame).count() == 100
    assert [r.id for r in keyed.scan_limit(frame, ["id"]).collect()] == list(range(50))


def test_write_batches(spark, tmp_path):
    keyed.write_batches(spark.range(0, 25, 1, 1), str(tmp_path / "out"), 10)
    files = [p for p in (tmp_path / "out").iterdir() if p.name.endswith(".parquet")]
    assert len(files) == 3
    assert spark.read.parquet(str(tmp_path / "out")).count() == 25
