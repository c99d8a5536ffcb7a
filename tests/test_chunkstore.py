"""The versioned store: replaced documents, old versions, races, jobs that die, and what vacuum leaves."""

import os

import pytest

from ferrolens.sources.chunkstore import ChunkStore


def rows(df):
    return sorted(map(tuple, df.select("document_id", "text").collect()))


def chunks(spark, *some):
    return spark.createDataFrame(list(some), "document_id string, text string")


def test_versions(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), buckets=4)
    with pytest.raises(ValueError, match="nothing was written"):
        store.read()
    assert store.write(chunks(spark, ("a", "1"), ("a", "2"), ("b", "3"), (None, "0"))) == 1
    held = store.read()
    assert store.write(chunks(spark, ("a", "new"), ("c", "4"))) == 2
    assert rows(held.filter("document_id is not null")) == [("a", "1"), ("a", "2"), ("b", "3")]  # a reader stays with its version
    assert rows(store.read().filter("document_id is not null")) == [("a", "new"), ("b", "3"), ("c", "4")]
    store.delete(chunks(spark, ("b", ""), (None, "")))
    assert rows(store.read()) == [("a", "new"), ("c", "4")] and store.versions() == [1, 2, 3]
    assert len(rows(store.read(1).filter("document_id is not null"))) == 3
    store.delete(chunks(spark, ("a", ""), ("c", "")))
    assert rows(store.read()) == []
    store.write(chunks(spark, ("d", "5")))
    store.vacuum(keep=1)
    assert store.versions() == [5] and rows(store.read()) == [("d", "5")]
    assert len(os.listdir(tmp_path / "s" / "data")) == 1


def test_a_race_loses_no_document(spark, tmp_path):
    """Another writer publishes between our reading and our publishing: we start again from its version."""
    one, two = (ChunkStore(spark, str(tmp_path / "s"), buckets=1) for _ in range(2))
    one.write(chunks(spark, ("a", "1")))
    publish, calls = one._publish, []

    def late(version, manifest, attempt):
        if not calls:
            calls.append(1)
            two.write(chunks(spark, ("b", "2")))
        return publish(version, manifest, attempt)

    one._publish = late
    assert one.write(chunks(spark, ("c", "3"))) == 3
    assert rows(one.read()) == [("a", "1"), ("b", "2"), ("c", "3")]


def test_a_job_that_dies_leaves_the_version_before(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"))
    store.write(chunks(spark, ("a", "1")))

    def dies(*_):
        raise KeyboardInterrupt

    store._publish = dies
    with pytest.raises(KeyboardInterrupt):
        store.write(chunks(spark, ("a", "2")))
    again = ChunkStore(spark, str(tmp_path / "s"))
    assert rows(again.read()) == [("a", "1")]
    again.write(chunks(spark, ("a", "3")))
    again.vacuum(1)
    assert rows(again.read()) == [("a", "3")] and len(os.listdir(tmp_path / "s" / "data")) == 1
