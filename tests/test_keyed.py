"""Tables in buckets of their key: a merge rewrites the buckets it touches."""

import os

import pytest
from pyspark.sql import functions as F

from marquee.operators import merge
from marquee.sources.keyed import BUCKET, KeyedTable


def files(path):
    """Bucket folder -> its data files."""
    return {d: sorted(f for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")) for d in os.listdir(path) if d.startswith(BUCKET)}


@pytest.fixture
def table(spark, tmp_path):
    rows = [(i, f"name {i}", None if i % 5 == 0 else "old") for i in range(300)]
    return KeyedTable.create(spark.createDataFrame(rows, "id long, name string, poster string"), f"{tmp_path}/t", ["id"], buckets=8, files=2)


def test_upsert_rewrites_touched_buckets_only(spark, table):
    before, target = files(table.path), [tuple(r) for r in table.read().collect()]
    batch = spark.createDataFrame([(7, "seven", "a", 1), (7, "seven again", "b", 2)], "id long, name string, poster string, n int")
    assert table.upsert(batch, ["n"]) == 1
    after = files(table.path)
    assert [d for d in before if before[d] != after[d]] == [f"{BUCKET}={table.touched(batch)[0]}"]
    expected = {r[0]: r for r in target} | {7: (7, "seven again", "b")}
    assert sorted(tuple(r) for r in table.read().collect()) == sorted(expected.values())


def test_upsert_agrees_with_the_plain_merge(spark, table):
    batch = spark.createDataFrame([(i, f"new {i}", None, i) for i in range(250, 340)] + [(260, "last", "z", 999)], "id long, name string, poster string, n int")
    expected = sorted(tuple(r) for r in merge.upsert(table.read(), batch, ["id"], ["n"]).collect())
    for _ in range(2):  # the same batch again changes nothing
        table.upsert(batch, ["n"])
        assert sorted(tuple(r) for r in table.read().collect()) == expected
    assert table.upsert(batch.limit(0)) == 0


def test_refresh_rewrites_buckets_with_changes_only(spark, table):
    before, old = files(table.path), table.read().collect()
    feed = spark.createDataFrame([("10", "fresh"), ("11", "old"), ("999", "nobody")], "id string, poster string")
    found = {r.id: r.change for r in table.refresh(feed, "poster").collect() if r.change}
    assert found == {10: "newly_added"}
    after = files(table.path)
    assert sum(before[d] != after[d] for d in before) == 1
    assert {tuple(r) for r in table.read().collect()} == {(r.id, r.name, "fresh" if r.id == 10 else r.poster) for r in old}


def test_near_rows_hold_all_shared_keys(spark, table):
    batch = spark.createDataFrame([(i, "x") for i in (1, 50, 299)], "id long, name string")
    near = table.near(batch)
    assert near.join(batch, "id").count() == 3 and near.count() < 300
    assert f"PartitionFilters: [{BUCKET}" in near._jdf.queryExecution().executedPlan().toString() or BUCKET in near._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1][:80]
