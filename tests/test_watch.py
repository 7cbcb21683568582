import os

import pytest

from pyspark.errors import StreamingQueryException

from lexigraph.plans import ingest
from lexigraph.sources.snapshots import SnapshotStore
from lexigraph.streaming import watch


def shown(documents):
    return sorted((r["path"].rpartition("/")[2], r["content"]) for r in documents.select("path", "content").collect())


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "src" / "node_modules").mkdir(parents=True)

    def put(name, text):
        (tmp_path / "src" / name).write_text(text)
        return tmp_path / "src" / name

    return put


def test_a_watched_folder_equals_a_synchronised_one(spark, tmp_path, folder, monkeypatch):
    for i in range(4):
        folder(f"a{i}.md", f"# Title {i}\nText of number {i}. " * 40)
    folder("node_modules/x.md", "excluded")
    sources = ingest.register_source(ingest.Tables.empty(spark).sources, f"file://{tmp_path}/src", sync_mode="watch")
    source = sources.first()
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    run = lambda: watch.watch(store, source, f"file://{tmp_path}/check", files_per_batch=2, availableNow=True)

    change = SnapshotStore.change
    calls = []

    def stops_after_the_second(self, *args, **options):
        version = change(self, *args, **options)
        calls.append(args)
        if len(calls) == 2:
            raise RuntimeError("stopped between the commit and the checkpoint")
        return version

    with monkeypatch.context() as m:
        m.setattr(SnapshotStore, "change", stops_after_the_second)
        with pytest.raises(StreamingQueryException):
            run().awaitTermination()
    at = store.latest()
    assert len(calls) == 2
    query = run()  # goes on from its checkpoint: the second batch comes again and is not applied again
    query.awaitTermination()
    assert store.latest() == at + 1  # the third batch of five files
    assert [n for n, _ in shown(store.read("documents"))] == [f"a{i}.md" for i in range(4)]

    folder("new.txt", "A new file.")
    run().awaitTermination()
    os.utime(folder("a1.md", "# Changed\nOther text."), (1, 1_600_000_000))
    (tmp_path / "src" / "a2.md").unlink()
    assert watch.sweep(store, source) == {"updated": 1, "deleted": 1, "error": 0}
    assert watch.sweep(store, source) == {}

    t = ingest.Tables.empty(spark)
    t.sources = sources
    synced, _ = ingest.sync_source(t, source["source_id"])
    assert shown(store.read("documents")) == shown(synced.documents)
    assert sorted(r["chunk_id"] for r in store.read("chunks").collect()) == sorted(r["chunk_id"] for r in synced.chunks.collect())
    before = shown(store.read("documents"))
    store.compact()
    store.clean(keep=1)
    assert shown(store.read("documents")) == before


def test_sweep_takes_empty_files_and_keeps_what_it_cannot_read(spark, tmp_path, folder):
    source = ingest.register_source(ingest.Tables.empty(spark).sources, f"file://{tmp_path}/src").first()
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    for name, text in {"a.md": "Text.", "b.md": "Other.", "empty.md": ""}.items():
        folder(name, text)
    assert watch.sweep(store, source) == {"added": 3, "error": 0}
    assert watch.sweep(store, source) == {}
    (tmp_path / "src" / "b.md").unlink()
    (tmp_path / "src" / "b.md").symlink_to(tmp_path / "nowhere")
    assert watch.sweep(store, source) == {}
    assert shown(store.read("documents")) == [("a.md", "Text."), ("b.md", "Other."), ("empty.md", "")]
    (tmp_path / "src" / "new.md").symlink_to(tmp_path / "nowhere")
    assert watch.sweep(store, source) == {"added": 1, "error": 1}
    assert len(shown(store.read("documents"))) == 3
