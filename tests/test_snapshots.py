import pytest

from lexigraph.sources import snapshots


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_commit_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    store = snapshots.SnapshotStore(spark, f"file://{tmp_path}/s")
    table = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    assert store.latest() == 0
    assert store.commit({"a": table((1, "x"), (2, "y")), "b": table((1, "p"))}) == 1
    pinned = store.read("a")

    def stopped(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:  # the second table can't be written
        real = snapshots.files.write_table
        m.setattr(snapshots.files, "write_table", lambda df, path, by: stopped() if "/b-" in path else real(df, path, by))
        with pytest.raises(RuntimeError):
            store.commit({"a": table((9, "z")), "b": table((9, "z"))})
    with monkeypatch.context() as m:  # the tables are written, the manifest isn't
        m.setattr(snapshots.Manifests, "commit", stopped)
        with pytest.raises(RuntimeError):
            store.commit({"a": table((9, "z")), "b": table((9, "z"))})
    assert store.latest() == 1 and rows(store.read("a")) == [(1, "x"), (2, "y")] and rows(store.read("b")) == [(1, "p")]
    assert store.commit({"a": table((2, "y2"), (3, "n"))}, batch="one") == 2
    assert store.commit({"a": table((7, "again"))}, batch="one") == 2  # a batch counts once
    assert rows(pinned) == [(1, "x"), (2, "y")] and rows(store.read("b")) == [(1, "p")]
    assert rows(store.diff("a", 1, 2, "k")) == [(1, "removed"), (2, "updated"), (3, "added")]
    with pytest.raises(snapshots.Conflict):
        store.commit({"a": table()}, base=1)
    with pytest.raises(snapshots.Conflict):
        store.manifests.commit(1, {})
    assert store.commit({"a": store.read("a")}) == 3 and store.clean(keep=1) >= 2
    assert rows(store.read("a")) == [(2, "y2"), (3, "n")] and rows(store.read("b")) == [(1, "p")]
    with pytest.raises(KeyError):
        store.read("a", 9)


def test_tables_by_partition_and_empty_tables(spark, tmp_path):
    store = snapshots.SnapshotStore(spark, f"file://{tmp_path}/s")
    df = spark.createDataFrame([("s1", 1), ("s2", 2)], "source_id string, n long")
    store.commit({"d": df, "e": df.limit(0)}, partition={"d": "source_id"})
    assert rows(store.tables()["d"]) == [("s1", 1), ("s2", 2)] and rows(store.read("e")) == []


def test_changes_write_what_they_bring(spark, tmp_path):
    store = snapshots.SnapshotStore(spark, f"file://{tmp_path}/s")
    table = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    key = lambda *k: spark.createDataFrame([(x,) for x in k], "k long")
    store.change({"a": table((1, "x"), (2, "y"), (3, "z"))}, {"a": key(1)})
    store.change({"a": table((2, "y2"))}, {"a": key(2, 2)}, batch="b")
    store.change({"a": table((3, "no"))}, {"a": key(3)}, batch="b")
    store.change({}, {"a": key(1, 9), "other": key(1)})
    assert rows(store.read("a")) == [(2, "y2"), (3, "z")] and rows(store.read("a", 1)) == [(1, "x"), (2, "y"), (3, "z")]
    store.change({"a": table((1, "back"))}, {})
    assert rows(store.read("a")) == [(1, "back"), (2, "y2"), (3, "z")]
    assert store.compact() == 5 and rows(store.read("a")) == [(1, "back"), (2, "y2"), (3, "z")]
