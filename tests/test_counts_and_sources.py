from pyspark.sql import Observation

from lexigraph.functions import text as T
from lexigraph.operators import fusion, graph
from lexigraph.plans import api
from pyspark.sql import functions as F


def test_rejected_hits_are_counted_in_passing(spark):
    hits = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.1), (2, "c", 0.2), (2, "d", None)], "query_id long, document_id string, score double")
    for floor, left in ((0.2, ["a", "c"]), (0.0, ["a", "b", "c", "d"]), (0.9, [])):
        seen = Observation()
        got = sorted(r["document_id"] for r in fusion.floored(hits, floor, seen).collect())
        assert got == left and seen.get == {"before": 4, "rejected": 4 - len(left)}
    seen = Observation()
    assert fusion.floored(hits.limit(0), 0.2, seen).count() == 0


def test_a_search_tells_what_its_floor_rejected(spark):
    d = spark.createDataFrame([(f"d{i:02}", "s", f"/p/{i}.md", f"Title {i}", "database " * (i + 1) + "and words") for i in range(8)], "document_id string, source_id string, path string, title string, content string")
    q = spark.createDataFrame([(1, "database"), (2, "words")], "query_id long, query string")
    kb = api.KnowledgeBase(d)
    free = {(r["query_id"], r["document_id"]): r["score"] for r in kb.search(q, None, api.SearchOptions(limit=20, floor=0.0, rerank=False, diversify=False)).collect()}
    floor = sorted(free.values())[len(free) // 2]
    seen = Observation()
    options = api.SearchOptions(limit=20, floor=floor, rerank=False, diversify=False)
    kept = {(r["query_id"], r["document_id"]) for r in kb.search(q, None, options, seen).collect()}
    assert kept == {k for k, s in free.items() if s >= floor} == {(r["query_id"], r["document_id"]) for r in kb.search(q, None, options).collect()}
    assert seen.get == {"before": len(free), "rejected": len(free) - len(kept)} and 0 < len(kept) < len(free)


def test_sources_of_entities_as_rows(spark):
    rows = [("Alpha", "concept", "d", 0.9, "doc1", 1), ("alpha ", "concept", "longer", 0.5, "doc2", 2), ("Alpha", "concept", "d", 0.7, "doc1", 3), ("Beta", "person", None, 0.4, "doc2", 4), ("Gamma", "tool", "g", 0.4, None, 5), (None, "tool", "g", 0.4, "doc3", 6)]
    m = spark.createDataFrame(rows, "name string, type string, description string, confidence double, document_id string, seq long")
    ids = {n: spark.range(1).select(T.entity_id(F.lit(n), F.lit(t))).first()[0] for n, t in (("Alpha", "concept"), ("Beta", "person"), ("Gamma", "tool"))}
    sources = graph.entity_sources(m.filter("name is not null"))
    assert {tuple(r) for r in sources.collect()} == {(ids["Alpha"], "doc1", 2, 0.9), (ids["Alpha"], "doc2", 1, 0.5), (ids["Beta"], "doc2", 1, 0.4)}
    entities = graph.canonical_entities(m.filter("name is not null"))
    merged = graph.merge_entities(m.filter("name is not null")).drop("documents")
    assert sorted(map(tuple, entities.collect())) == sorted(map(tuple, merged.collect()))
    links = spark.createDataFrame([("r1", ids["Alpha"], "has", ids["Beta"], 0.9), ("r2", ids["Alpha"], "has", ids["Gamma"], 0.9)], "relation_id string, subject_id string, predicate string, object_id string, confidence double")
    gone = spark.createDataFrame([("doc2",), ("doc2",), ("other",)], "document_id string")
    e, r, s = graph.without_documents(entities, links, sources, gone)
    assert {x["entity_id"] for x in e.collect()} == {ids["Alpha"], ids["Gamma"]}  # one never had a source
    assert [x["relation_id"] for x in r.collect()] == ["r2"] and [(x["entity_id"], x["document_id"]) for x in s.collect()] == [(ids["Alpha"], "doc1")]
    e, r, s = graph.without_documents(entities, links, sources, gone.limit(0))
    assert e.count() == 3 and r.count() == 2 and s.count() == 3
    assert graph.entity_sources(m.limit(0)).count() == 0
