"""Stored tables: upserts and deletions in place, without shuffling the table."""

import os
import uuid

import pytest

from quaverlake.operators import stored as St

SCHEMA = "source_id string, title string, seen_refresh_id string"


@pytest.fixture
def fresh(spark, tmp_path):
    made = []

    def make(df, key, **more):
        made.append(f"t_{uuid.uuid4().hex}")
        St.create_table(df, made[-1], key, f"file://{tmp_path}/{made[-1]}", **more)
        return made[-1]

    yield make
    for name in made:
        spark.sql(f"DROP TABLE {name}")


def files(tmp_path, name):
    """Band folders with the times of their files."""
    return {d: sorted(os.stat(f"{tmp_path}/{name}/{d}/{f}").st_mtime_ns for f in os.listdir(f"{tmp_path}/{name}/{d}") if f.endswith("parquet")) for d in os.listdir(f"{tmp_path}/{name}") if d.startswith("band=")}


def rows(spark, name, *columns):
    return sorted(tuple(r) for r in spark.table(name).select(*columns).collect())


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning")


def test_upsert_rewrites_its_bands_alone(spark, fresh, tmp_path):
    name = fresh(spark.createDataFrame([(f"t{k}", "old", "r1") for k in range(200)], SCHEMA), "source_id", bands=8, buckets=8)
    before = files(tmp_path, name)
    batch = spark.createDataFrame([("t7", "new"), ("x1", "new")], "source_id string, title string")
    for _ in range(2):  # a batch that runs twice
        St.upsert_table(spark, name, batch, "source_id", "r2")
        assert rows(spark, name, "source_id", "title", "seen_refresh_id") == sorted([(f"t{k}", "old", "r1") for k in range(200) if k != 7] + [("t7", "new", "r2"), ("x1", "new", "r2")])
    after = files(tmp_path, name)
    assert 1 <= sum(before[d] != after[d] for d in before) <= 2


def test_the_table_is_not_shuffled(spark, fresh):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        name = fresh(spark.createDataFrame([(f"t{k}", "old", "r1") for k in range(100)], SCHEMA), "source_id", bands=4, buckets=8)
        links = fresh(spark.createDataFrame([(f"t{k}", f"a{k % 9}") for k in range(130)], "track_id string, artist_id string"), "track_id", bands=4, buckets=8)
        batch = spark.createDataFrame([(f"t{k}", "new") for k in range(3)], "source_id string, title string")
        plan = St.upserted(spark, name, batch, "source_id", "r2")[0]
        assert len(shuffles(plan)) == 2 and "Exchange" not in shuffles(plan)[0]  # the batch's alone
        assert "LeftAnti" in plan._jdf.queryExecution().executedPlan().toString()
        assert len(shuffles(St.linked(spark, links, "track_id", name, "source_id"))) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_unseen_rows_and_their_links_go(spark, fresh):
    tracks = fresh(spark.createDataFrame([(f"t{k}", "x", "r2" if k % 3 else "r1") for k in range(60)] + [("n", "x", None)], SCHEMA), "source_id", bands=64, buckets=8)
    links = fresh(spark.createDataFrame([(f"t{k}", f"a{k}") for k in range(60)] * 2, "track_id string, artist_id string"), "track_id", bands=64, buckets=8)
    for _ in range(2):
        St.delete_unseen_tables(spark, [tracks], {links: "track_id"}, tracks, "r2")
        assert rows(spark, tracks, "source_id") == sorted((f"t{k}",) for k in range(60) if k % 3)
        assert rows(spark, links, "track_id") == sorted([(f"t{k}",) for k in range(60) if k % 3] * 2)


def test_links_of_owners_are_replaced(spark, fresh):
    links = fresh(spark.createDataFrame([(f"t{k}", f"a{k}", 0) for k in range(10)], "track_id string, artist_id string, pos int"), "track_id", bands=32, buckets=4)
    owners = spark.createDataFrame([("t1",), ("t2",), ("t99",)], "track_id string")
    now = spark.createDataFrame([("t1", "b", 0), ("t1", "c", 1), ("t99", "d", 0)], "track_id string, artist_id string, pos int")
    St.replace_owned(spark, links, owners, now, "track_id")
    assert rows(spark, links, "track_id", "artist_id") == sorted([(f"t{k}", f"a{k}") for k in range(10) if k not in (1, 2)] + [("t1", "b"), ("t1", "c"), ("t99", "d")])
