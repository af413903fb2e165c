"""Versioned tables: merging, jobs that die before and after the commit, repeated batches, two writers, time travel."""

import pytest
from pyspark.sql import functions as F

from quern.sources.versioned import Conflict, VersionedTable

SCHEMA = "id long, part string, name string, tags map<string,int>, n int"


@pytest.fixture
def held(spark, tmp_path):
    return VersionedTable.create(spark, str(tmp_path / "t"), SCHEMA, ["id", "part"], buckets=8)


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def state(table, version=None):
    return sorted((r.id, r.part, r.name, r.tags, r.n) for r in table.read(version).where("id is not null").collect())


def test_upserts_merge_and_keep_versions(spark, held):
    assert held.read().count() == 0 and held.version() == 0
    held.upsert(rows(spark, (1, "a", "one", {"x": 1}, 1), (2, "a", "two", None, 2), (1, "b", "three", None, 3)), "first")
    held.upsert(rows(spark, (1, "a", None, None, 10), (3, "c", "new", {"y": 2}, None)), "second", overwrite=["name"])
    assert state(held) == [(1, "a", None, {"x": 1}, 10), (1, "b", "three", None, 3), (2, "a", "two", None, 2), (3, "c", "new", {"y": 2}, None)]
    assert state(held, 1) == [(1, "a", "one", {"x": 1}, 1), (1, "b", "three", None, 3), (2, "a", "two", None, 2)]
    assert held.delete(rows(spark, (2, "a", None, None, None), (9, "z", None, None, None)), "third") == 3
    assert [x[0:2] for x in state(held)] == [(1, "a"), (1, "b"), (3, "c")]
    # A change that names some columns leaves the others.
    held.upsert(spark.createDataFrame([(1, "b", 7)], "id long, part string, n int"), "fourth")
    assert state(held)[1] == (1, "b", "three", None, 7)


def test_repeated_keys_null_keys_and_order(spark, held):
    held.upsert(rows(spark, (None, None, "x", None, 1), (5, "a", "old", None, 1), (5, "a", "newest", None, 9), (5, "a", "middle", None, 5)), "a", order="n")
    held.upsert(rows(spark, (None, None, "y", None, None)), "b")
    assert state(held) == [(5, "a", "newest", None, 9)]
    assert [tuple(r) for r in held.read().where("id is null").collect()] == [(None, None, "y", None, 1)]


def test_a_batch_counts_once(spark, held):
    first = held.upsert(rows(spark, (1, "a", "one", None, 1)), "b1")
    held.upsert(rows(spark, (1, "a", "two", None, 2)), "b2")
    assert held.upsert(rows(spark, (1, "a", "one", None, 1)), "b1") == first
    assert state(held) == [(1, "a", "two", None, 2)] and held.version() == 2


def test_dying_before_the_commit_loses_and_doubles_nothing(spark, held, monkeypatch):
    held.upsert(rows(spark, (1, "a", "one", None, 1)), "b1")
    before = state(held)

    def die(entry):
        raise SystemExit("killed between write and commit")

    with monkeypatch.context() as m:
        m.setattr(held, "_commit", die)
        with pytest.raises(SystemExit):
            held.upsert(rows(spark, (1, "a", "two", None, 2), (2, "b", "new", None, 1)), "b2")
    again = VersionedTable(spark, held.path)
    assert state(again) == before and again.version() == 1
    assert again.upsert(rows(spark, (1, "a", "two", None, 2), (2, "b", "new", None, 1)), "b2") == 2
    assert state(again) == [(1, "a", "two", None, 2), (2, "b", "new", None, 1)]
    assert again.vacuum() == 1 and again.vacuum() == 0 and state(again)[1][0] == 2 and state(again, 1) == before


def test_two_writers(spark, held, monkeypatch):
    other, commit, turns = VersionedTable(spark, held.path), held._commit, []

    def second(entry):
        if not turns:
            turns.append(1)
            other.upsert(rows(spark, (1, "a", "other", None, 5)), "other")
        commit(entry)

    monkeypatch.setattr(held, "_commit", second)
    assert held.upsert(rows(spark, (1, "a", "mine", None, None)), "mine") == 2
    assert state(held) == [(1, "a", "mine", None, 5)]
    with pytest.raises(Conflict):
        commit(held._log(2))


def test_only_touched_buckets_are_written(spark, held):
    held.upsert(rows(spark, *[(n, "a", "x", None, n) for n in range(200)]), "all")
    held.upsert(rows(spark, (7, "a", "y", None, None)), "one")
    assert [h["rewritten"] for h in held.history()] == [0, 8, 1]
    assert held.read().count() == 200 and held.read().where("name = 'y'").first().n == 7
    assert held.upsert(rows(spark), "none") == 3 and held.history()[-1]["rewritten"] == 0


def test_create_again_and_other_columns(spark, held):
    assert VersionedTable.create(spark, held.path, SCHEMA, ["id", "part"], buckets=8).version() == 0
    with pytest.raises(ValueError):
        VersionedTable.create(spark, held.path, "id long", ["id"])
    with pytest.raises(ValueError):
        VersionedTable.create(spark, held.path + "2", "id long", ["no"])


def test_as_a_streaming_sink(spark, tmp_path):
    """Batches are named by their number: a stream that is run again from an old checkpoint adds nothing."""
    source, table = str(tmp_path / "in"), VersionedTable.create(spark, str(tmp_path / "t"), "id long, n long", ["id"], 4)
    spark.range(10).select("id", (F.col("id") * 2).alias("n")).write.parquet(source)
    for checkpoint in ("one", "two"):
        stream = spark.readStream.schema("id long, n long").parquet(source)
        stream.writeStream.foreachBatch(lambda df, n: table.upsert(df, f"stream-{n}")).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination()
    assert table.version() == 1 and table.read().agg(F.sum("n")).first()[0] == 90
