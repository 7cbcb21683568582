import math

from lexigraph.operators import evaluate, fusion, index, lexical, query, results, vector
from lexigraph.plans import api


def docs(spark):
    rows = [("low", "s", "/t/low.md", "General Article", "nothing here"), ("medium", "s", "/t/m.md", "Programming Guide", "a database is used"), ("high", "z", "/t/h.md", "Database Optimization", "database database database and database"), ("fox", "z", "/t/f.md", None, "xylophone player")]
    rows += [(f"pad{i}", "p", f"/p/{i}.md", "Padding", f"filler words number {i}") for i in range(8)]
    return spark.createDataFrame(rows, "document_id string, source_id string, path string, title string, content string")


def queries(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id long, query string")


def test_bm25_by_hand(spark):
    d = docs(spark)
    got = {r["document_id"]: r["score"] for r in lexical.matches(d, queries(spark, "database"), prefix=False).collect()}
    assert set(got) == {"medium", "high"} and got["high"] > got["medium"] > 0
    length = lambda c, t, p: len(c.split()) + len((t or "").split()) + len([x for x in p.replace("/", " ").replace(".", " ").split()])
    rows = d.collect()
    lengths = {r[0]: length(r[4], r[3], r[2]) for r in rows}
    mean = sum(lengths.values()) / len(rows)
    idf = math.log((len(rows) - 2 + 0.5) / 2.5)
    assert math.isclose(got["medium"], idf * 0.5 * 2.2 / (0.5 + 1.2 * (0.25 + 0.75 * lengths["medium"] / mean)))


def test_and_or_prefix_fallback(spark):
    kb = api.KnowledgeBase(docs(spark))
    q = queries(spark, "xylophone zzz", "xyloph", "qqq zzz", "general article")
    strict = {(r[0], r[1]) for r in lexical.matches(kb.documents, q).select("query_id", "document_id").collect()}
    assert strict == {(1, "fox"), (3, "low")}
    got = {(r["query_id"], r["document_id"], r["level"], r["confidence"]) for r in kb.search_with_fallback(q).collect()}
    assert {(0, "fox", 1, "low"), (1, "fox", 0, None), (3, "low", 0, None)} == got
    assert lexical.matches(kb.documents, queries(spark, "?!", "")).count() == 0
    assert lexical.matches(kb.documents.limit(0), q).count() == 0


def test_fusion_by_hand(spark):
    words = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id int, document_id string, rank int")
    near = spark.createDataFrame([(1, "b", 1, 0.9), (1, "d", 2, 0.4)], "query_id int, document_id string, rank int, score double")
    hits = fusion.rrf(words, near)
    hits = fusion.rerank(hits.withColumn("score", fusion.agreement_boost(hits["score"], hits["strategies"])))
    first = fusion.ranked(hits).orderBy("rank").first()
    assert first["document_id"] == "b" and math.isclose(first["score"], (0.5 / 62 + 0.5 / 61) * 1.2 * 1.9)
    assert fusion.confidence(hits).first()["confidence"] == "high"


def test_mmr_skips_a_copy(spark):
    hits = spark.createDataFrame([(1, "a", 1.0, 1, "same words here"), (1, "b", 0.99, 2, "same words here"), (1, "c", 0.9, 3, "other text there")], "query_id int, document_id string, score double, best_rank int, snippet string")
    assert [r["document_id"] for r in fusion.mmr(hits, 2, 0.5).orderBy("pick").collect()] == ["a", "c"]


def test_overlaps(spark):
    parts = spark.createDataFrame([(["left part shared text!", "shared text! right part", "no, other"],)], "p array<string>")
    assert parts.select(results.join_parts(parts["p"]).alias("x")).first()["x"] == "left part shared text!  right part\n\nno, other"
    d = spark.createDataFrame([("d", "word " * 900)], "document_id string, content string")
    got = results.document_text(index.chunk_table(d)).first()["content"]
    assert len(got) >= len(("word " * 900).strip()) - 10


def test_queries_are_understood(spark):
    q = queries(spark, 'find "this"', "how does it work", "revenue in 2020", "The Acme Corp Berlin", "plain words", "")
    got = {r["query_id"]: r for r in query.analyze(q).collect()}
    assert [got[i]["query_type"] for i in range(6)] == ["exact_quote", "conceptual", "factual", "entity", "exploratory", "exploratory"]
    assert got[0]["mode"] == "lexical" and got[3]["proper_nouns"] == ["The Acme Corp Berlin"] and "Acme" in got[3]["entities"]


def test_sync_is_idempotent(spark):
    scan = spark.createDataFrame([("a", "h1"), ("b", "h9"), ("d", "h4"), ("e", None)], "path string, hash string")
    known = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", "h3"), ("e", "h5")], "path string, hash string")
    assert {tuple(r) for r in index.sync_diff(scan, known).collect()} == {("a", "unchanged"), ("b", "updated"), ("c", "deleted"), ("d", "added"), ("e", "error")}
    same = scan.filter("hash is not null")
    assert {r["status"] for r in index.sync_diff(same, same).collect()} == {"unchanged"}
    assert {r["status"] for r in index.sync_diff(same, same, rebuild=True).collect()} == {"updated"}
    assert index.sync_summary(index.sync_diff(scan, known)).first().asDict() == {"added": 1, "updated": 1, "unchanged": 1, "deleted": 1, "error": 1}


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [-1.0, 0.0]), (4, [0.0, 0.0]), (5, None)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    got = [(r["vec_id"], round(r["score"], 6)) for r in vector.knn(v, q, 10, least=0.0).orderBy("rank").collect()]
    assert got == [(1, 1.0), (2, 0.6)]
    assert [r["vec_id"] for r in vector.knn(v, q, 1, skip_own=True).collect()] == [2]
    embedded = spark.createDataFrame([("one two",), (None,)], "t string").select(vector.hashing_embedder(8)("t").alias("v")).collect()
    assert len(embedded[0]["v"]) == 8 and embedded[1]["v"] == [0.0] * 8


def test_hybrid_search_runs_with_and_without_vectors(spark):
    d = docs(spark)
    v = spark.createDataFrame([("high", [1.0, 0.0]), ("low", [0.0, 1.0])], "vec_id string, embedding array<float>")
    q, qv = queries(spark, "database guide"), spark.createDataFrame([(0, [1.0, 0.1])], "query_id long, vector array<double>")
    both = api.KnowledgeBase(d, v).search(q, qv, api.SearchOptions(limit=3, adaptive_weights=True))
    assert {r["document_id"] for r in both.collect()} <= {"high", "medium", "low"} and both.count() > 0
    assert [r["document_id"] for r in api.KnowledgeBase(d).search(queries(spark, "database"), None, api.SearchOptions(diversify=False, rerank=False)).orderBy("rank").collect()] == ["high", "medium"]
    assert api.KnowledgeBase(d).search_with_context(queries(spark, "database")).count() == 2


def test_metrics_and_cases(spark):
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id int, document_id string, rank int")
    relevant = spark.createDataFrame([(1, "b"), (1, "x"), (2, "y")], "query_id int, document_id string")
    got = {r["query_id"]: r for r in evaluate.metrics(hits, relevant, 3).collect()}
    assert math.isclose(got[1]["precision"], 1 / 3) and got[1]["recall"] == 0.5 and got[1]["reciprocal_rank"] == 0.5 and got[2]["ndcg"] == 0
    assert math.isclose(got[1]["ndcg"], (1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    cases = spark.createDataFrame([("ok", "doc", ["Yes"], ["bad"], 1, 3), ("few", "", [], [], 5, 0), ("no", "doc", [], ["yes"], 0, 3)], "name string, expected_top_doc string, must_contain array<string>, must_not_contain array<string>, min_results int, max_rank int")
    found = spark.createDataFrame([("ok", 1, "/doc.md", "well yes"), ("no", 1, "/doc.md", "well YES")], "name string, rank int, path string, snippet string")
    assert {r["name"]: r["reason"] for r in evaluate.evaluate_cases(cases, found).collect()} == {"ok": "", "few": "insufficient results", "no": "found boilerplate phrase: yes"}
