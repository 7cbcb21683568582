from pyspark.sql import functions as F

from lexigraph.operators import inverted, lexical, segments


def chunks(spark, n=300):
    rows = [(f"c{i:04d}", f"word{i % 17} shared other{i % 5} shared " + "x" * (i % 7), None if i % 3 else f"Title {i}") for i in range(n)] + [("empty", "", None), ("none", None, None)]
    return spark.createDataFrame(rows, "chunk_id string, content string, title string").repartition(3)


def test_postings_are_packed_without_a_shuffle(spark, tmp_path):
    d = chunks(spark)
    built = lexical.TextIndex.build(d, f"file://{tmp_path}/i", stem=False)
    got = {(r["token"], r["key"]): (r["dl"], r["tf"]) for r in built.read("postings").collect()}
    pairs = lexical.field_tokens(d, key="chunk_id").select("chunk_id", "dl", F.explode("occurrences").alias("o")).groupBy("chunk_id", "dl", "o.token").agg(F.sum("o.weight").alias("tf"))
    assert got == {(r["token"], r["chunk_id"]): (r["dl"], r["tf"]) for r in pairs.collect()}
    assert built.read("documents").count() == 302 and built.read("facts").first()["n"] == 302
    folders = {p.name for p in tmp_path.joinpath("i").iterdir()}
    assert folders == {"packed", "documents", "tokens", "facts"}


def test_small_runs_and_blocks_give_the_same_index(spark, tmp_path):
    d = chunks(spark)
    q = spark.createDataFrame([(1, "shared word1"), (2, "other2 x"), (3, "nothing"), (4, "")], "query_id long, query string")
    inverted.write(d, f"file://{tmp_path}/a", "chunk_id", lexical.FIELD_WEIGHTS, False, 4, 10)
    runs = spark.read.parquet(f"file://{tmp_path}/a/documents").groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("last")).collect()
    assert all(r["n"] <= 10 and r["last"] == r["n"] - 1 for r in runs) and sum(r["n"] for r in runs) == 302
    built = lexical.TextIndex.build(d, f"file://{tmp_path}/b", stem=False)
    index = segments.SegmentedIndex.create(spark, f"file://{tmp_path}/c", stem=False).put(d)
    for require_all in (True, False):
        order = [F.desc(F.round("score", 9)), F.col("chunk_id")]
        page = lambda found: sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 6)) for r in found.collect())
        stored = page(lexical.ranked(built.matches(q, require_all, top=10), 10, by=order))
        assert stored and stored == page(lexical.ranked(lexical.matches(d, q, require_all, key="chunk_id"), 10, by=order)) == page(index.search(q, 10, require_all=require_all))
