import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from lexigraph.plans import ingest
from lexigraph.sources import files, folder


@pytest.fixture
def tree(tmp_path):
    for name in ("src/a/deep", "src/node_modules/x", "src/.git", "src/empty"):
        (tmp_path / name).mkdir(parents=True)
    for name, text in {"one.md": "# One\nText.", "a/two.txt": "Two " * 50, "a/deep/three.md": "Three", "node_modules/x/no.md": "no", ".git/no.md": "no", "b.bin": "no", "long.txt": "x" * 500, "zero.txt": ""}.items():
        (tmp_path / "src" / name).write_text(text)
    return tmp_path / "src"


def test_same_rows_as_the_binary_file_source(spark, tree):
    (tree / "with space é.md").write_text("odd name")
    plain = files.chosen(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tree)), str(tree))
    pruned = files.scan(spark, str(tree))
    rows = lambda df: sorted((r["path"], r["name"], r["size"], r["modified_at"], bytes(r["content"])) for r in df.collect())
    assert rows(pruned) == rows(files.scan(spark, f"file://{tree}/")) and len(rows(pruned)) == 6
    assert rows(pruned.filter("size > 0")) == rows(plain)  # Spark's source leaves out empty files
    assert pruned.filter("error is not null").count() == 0
    some = [r["path"] for r in pruned.collect() if "é" in r["path"] or r["name"] == "three.md"]
    assert sorted(r["path"] for r in files.scan(spark, str(tree), paths=some).collect()) == sorted(some)


def test_excluded_folders_are_never_listed_nor_files_opened(tree, monkeypatch):
    listed, opened = [], []

    class Watching(pyarrow.fs.LocalFileSystem):
        def open_input_stream(self, path, *args):
            opened.append(path)
            return super().open_input_stream(path, *args)

    monkeypatch.setattr(folder.os, "scandir", lambda d, scan=folder.os.scandir: (listed.append(d), scan(d))[1])
    monkeypatch.setattr(folder, "_store", lambda f: (Watching(), str(tree), "file:"))
    reader = folder.FolderReader(str(tree), ["*.md", "*.txt"], ["node_modules", ".*"], 100 << 20, True, 1 << 20)
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert {d.removeprefix(str(tree)) for d in listed} == {"", "/a", "/a/deep", "/empty"}
    assert sum(b.num_rows for b in batches) == len(opened) == 5
    opened.clear()
    names = folder.FolderReader(str(tree), ["*.md"], ["node_modules", ".*"], 100 << 20, False, 1 << 20)
    assert sum(b.num_rows for p in names.partitions() for b in names.read(p)) == 2 and not opened


def test_tasks_by_bytes():
    of = lambda *sizes: [[f.size for f in s.files] for s in folder.shares([folder.Listed(f"f{i}", s, 0) for i, s in enumerate(sizes)], 10, 1)]
    assert of(4, 4, 4, 50, 1, 1) == [[4, 4], [4], [50], [1, 1]] and of() == [] and of(*[0] * 25) == [[0] * 10, [0] * 10, [0] * 5]


def test_bounded_batches_and_files_that_vanish_or_grow(tree, monkeypatch):
    monkeypatch.setattr(folder, "BATCH_BYTES", 300)
    reader = folder.FolderReader(str(tree), ["*.txt", "*.md"], ["node_modules", ".git"], 600, True, 1 << 30)
    (share,) = reader.partitions()
    (tree / "one.md").unlink()
    (tree / "a" / "two.txt").write_text("y" * 601)
    batches = list(reader.read(share))
    rows = {r["name"]: r for b in batches for r in b.to_pylist()}
    assert len(batches) == 2 and len(rows) == 5
    assert rows["one.md"]["content"] is None and "FileNotFoundError" in rows["one.md"]["error"]
    assert rows["two.txt"]["content"] is None and rows["two.txt"]["error"] == "larger than when it was listed"
    assert rows["zero.txt"]["content"] == b"" and rows["zero.txt"]["error"] is None and rows["long.txt"]["content"] == b"x" * 500


def test_larger_files_and_linked_folders_are_left_out(spark, tree):
    (tree / "a" / "loop").symlink_to(tree)
    got = folder.read(spark, str(tree), ["*.txt"], ["node_modules"], 499, task_bytes=1)
    assert sorted(r["name"] for r in got.select("name").collect()) == ["two.txt", "zero.txt"]
    assert folder.read(spark, str(tree / "empty"), ["*"], [], 10).count() == 0


def test_an_unreadable_file_is_an_error_of_the_sync(spark, tree):
    t = ingest.Tables.empty(spark)
    t.sources = ingest.register_source(t.sources, str(tree))
    source = t.sources.first()["source_id"]
    t, summary = ingest.sync_source(t, source)
    assert summary.first().asDict() == {"added": 5, "updated": 0, "unchanged": 0, "deleted": 0, "error": 0}
    (tree / "one.md").unlink()
    (tree / "one.md").symlink_to(tree / "nowhere")
    (tree / "zero.txt").unlink()
    t, summary = ingest.sync_source(t, source)
    assert summary.first().asDict() == {"added": 0, "updated": 0, "unchanged": 3, "deleted": 1, "error": 1}
    kept = {r["path"].rpartition("/")[2] for r in t.documents.select("path").collect()}
    assert kept == {"one.md", "two.txt", "three.md", "long.txt"}  # what can't be read isn't deleted


def test_a_sync_scans_its_folder_once(spark, tree, monkeypatch):
    reads = spark.sparkContext.accumulator(0)
    original = files.documents

    def counted(found, source_id):
        @F.udf("binary")
        def seen(content):
            reads.add(1)
            return content

        return original(found.withColumn("content", seen("content")), source_id)

    monkeypatch.setattr(files, "documents", counted)
    t = ingest.Tables.empty(spark)
    t.sources = ingest.register_source(t.sources, str(tree))
    t, summary = ingest.sync_source(t, t.sources.first()["source_id"])
    assert summary.first()["added"] == t.documents.count() == 5 and t.chunks.count() > 0
    assert reads.value == 5


def test_all_sources_in_one_plan(spark, tree, tmp_path):
    other = tmp_path / "other"
    other.mkdir()
    (other / "four.md").write_text("Four")
    t = ingest.Tables.empty(spark)
    for path in (tree, other, tree / "a", tmp_path / "missing"):  # the third lies within the first
        t.sources = ingest.register_source(t.sources, str(path))
    ids = {r["path"].rpartition("/")[2]: r["source_id"] for r in t.sources.collect()}
    t, results = ingest.sync_all(t)
    assert {n: results[ids[n]]["added"] for n in ("src", "other", "a")} == {"src": 5, "other": 1, "a": 2}
    assert isinstance(results[ids["missing"]], Exception)
    rows = t.documents.select("document_id", "source_id", "path").collect()
    assert len(rows) == len({r["document_id"] for r in rows}) == 6
    assert {r["source_id"] for r in rows if r["path"].endswith(("two.txt", "three.md"))} == {max(ids["src"], ids["a"])}
    t = t.written(spark, f"file://{tmp_path}/tables")
    (other / "four.md").unlink()
    t, results = ingest.sync_all(t)
    assert results[ids["other"]].asDict() == {"added": 0, "updated": 0, "unchanged": 0, "deleted": 1, "error": 0} and t.documents.count() == 5
    t, results = ingest.sync_all(t)
    assert set(results[ids["other"]].asDict().values()) == {0}
