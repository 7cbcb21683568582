import pytest
from compare import SMALL

from lexigraph.operators import embedding
from lexigraph.plans import ingest


def loads(log):
    def load():
        with open(log, "a") as f:
            f.write("loaded\n")

        def model(texts):
            with open(log, "a") as f:
                f.write(f"batch {len(texts)}\n")
            if any("bad" in t for t in texts):
                raise RuntimeError("refused")
            return [[float(len(t)), 1.0] for t in texts]

        return model

    return load


def test_a_failed_batch_is_counted_and_skipped(spark, tmp_path):
    texts = [(i, "bad" if i == 7 else f"text {i}") for i in range(50)] + [(50, None), (51, "")]
    rows = spark.createDataFrame(texts, "chunk_id long, content string").coalesce(1).sortWithinPartitions("chunk_id")
    whole = embedding.vectorize(rows, loads(tmp_path / "a"), "test-a", size=20)
    assert (whole.vectorized, whole.failed) == (31, 21)  # the first batch of twenty, and the null text
    assert {r["vec_id"] for r in whole.failures.collect()} == {*range(20), 50}
    assert {r["error"] for r in whole.failures.filter("vec_id < 20").collect()} == {"RuntimeError: refused"}
    log = (tmp_path / "a").read_text().split("\n")
    assert log.count("loaded") == 1 and log.count("batch 20") == 2
    alone = embedding.vectorize(rows, loads(tmp_path / "b"), "test-b", size=20, isolate=True)
    assert {(r["vec_id"], r["error"]) for r in alone.failures.collect()} == {(7, "RuntimeError: refused"), (50, "no text")}
    assert {r["vec_id"]: list(r["embedding"]) for r in alone.vectors.collect()}[9] == [6.0, 1.0]


@pytest.mark.parametrize("answer", [[], [[1.0]], [[1.0], [float("nan")]], [[1.0], [1.0, 2.0]], [[1.0], []], None, [[1.0], ["x"]]])
def test_answers_that_are_no_vectors(answer):
    assert all(v is None and e for v, e in embedding.answers(lambda texts: answer, ["a", "b"], False))


def test_empty_tables_and_single_texts(spark):
    none = embedding.vectorize(spark.createDataFrame([], "chunk_id string, content string"), lambda: None, "test-none")
    assert (none.vectorized, none.failed, none.vectors.count(), none.failures.count()) == (0, 0, 0, 0)
    with pytest.raises(ValueError):
        embedding.embed(spark.createDataFrame([], "chunk_id string, content string"), lambda: None, "test-none", "chunk_id", "content", size=0)


def test_what_failed_is_taken_again(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("cast(doc_id as string) as document_id", "source as source_id", "text as content")
    empty = ingest.Tables.empty(spark)
    tables = ingest.put_documents(empty, documents.select("document_id", "source_id", "content"))
    chunks = tables.chunks.count()

    def refuses():
        def model(texts):
            raise TimeoutError("no answer")

        return model

    tables, first = ingest.vectorize(tables, refuses, "test-refuses")
    assert (first.vectorized, first.failed) == (0, chunks)
    tables, second = ingest.vectorize(tables, lambda: lambda texts: [[float(len(t))] for t in texts], "test-lengths")
    assert (second.vectorized, second.failed) == (chunks, 0)
    assert tables.vectors.filter("document_id is null").count() == 0
    assert ingest.vectorize(tables, refuses, "test-refuses")[1].failed == 0


def test_entities_by_name_and_description(spark):
    e = spark.createDataFrame([("a", "Ada", "person", "wrote"), ("b", "Bob", "person", None)], "entity_id string, name string, type string, description string")
    done = embedding.vectorize_entities(e, lambda: lambda texts: [[float(len(t))] for t in texts], "test-entities")
    assert {(r["vec_id"], r["type"], r["embedding"][0]) for r in done.vectors.collect()} == {("a", "person", 10.0), ("b", "person", 3.0)}
