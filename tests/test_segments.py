import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigraph.operators import lexical, segments


def texts(n, seed=0):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "mo", "tira", "run", "play") for b in ("", "s", "ing", "ed", "al", "ize")]
    weight = [1 / (i + 1) for i in range(len(words))]
    return [(f"d{i:04d}", " ".join(r.choices(words, weight, k=r.randint(1, 60)))) for i in range(n)]


@pytest.fixture
def documents(spark):
    return lambda rows: spark.createDataFrame(rows, "chunk_id string, content string")


QUERIES = [(1, "ka mos"), (2, "tira ru"), (3, "playing kas ka"), (4, "nothing"), (5, ""), (6, "plays")]


def pages(index, spark, **options):
    q = spark.createDataFrame(QUERIES, "query_id long, query string")
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 6)) for r in index.search(q, **options).collect())


def fresh(documents, rows, spark, folder, stem, require_all, k, offset):
    built = lexical.TextIndex.build(documents(rows), folder, stem=stem)
    q = spark.createDataFrame(QUERIES, "query_id long, query string")
    found = lexical.ranked(built.matches(q, require_all), k, offset, [F.desc(F.round("score", 9)), F.col("chunk_id")], "chunk_id")
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 6)) for r in found.collect())


@pytest.mark.parametrize("stem, block", [(True, 4), (False, 128)])
def test_an_index_follows_its_collection(spark, documents, tmp_path, monkeypatch, stem, block):
    monkeypatch.setattr(segments, "BLOCK", block)
    rows = dict(texts(160))
    index = segments.SegmentedIndex.create(spark, f"file://{tmp_path}/i", stem=stem)
    assert pages(index, spark) == [] and index.counts() == (0, 0.0)
    index = index.put(documents(texts(160)))
    before, old = index, dict(rows)
    changed = {k: v + " run run" for k, v in list(rows.items())[20:60]} | {"e1": "ka mo mos", "e2": ""}
    rows |= changed
    index = index.put(documents(list(changed.items())))
    gone = list(rows)[50:90] + ["unknown"]
    index = index.remove(documents([(k, "") for k in gone]))
    rows = {k: v for k, v in rows.items() if k not in gone}
    index = index.put(documents([("d0055", "back again ka")]))
    rows["d0055"] = "back again ka"
    assert index.counts()[0] == len(rows)
    for n, options in enumerate([(True, 10, 0), (False, 7, 3)]):
        expected = fresh(documents, list(rows.items()), spark, f"file://{tmp_path}/f{n}", stem, *options)
        assert expected and pages(index, spark, require_all=options[0], k=options[1], offset=options[2]) == expected
        if n == 0:
            index = index.merge(2)
            assert len(index.state["segments"]) == 2
            assert pages(index, spark) == expected
            index = index.merge()
            assert len(index.state["segments"]) == 1 and not index.state["tombstones"]
    # A reader of an older version, and one that opens the folder now.
    assert pages(before, spark) == fresh(documents, list(old.items()), spark, f"file://{tmp_path}/g", stem, True, 10, 0)
    assert pages(segments.SegmentedIndex(spark, index.folder), spark) == pages(index, spark)


def test_blocks_that_cannot_matter_stay_packed(spark, documents, tmp_path):
    rows = [(f"d{i:05d}", "mo " * 50 if i in (7, 8, 9) else "mo " + "filler " * (30 + i % 40)) for i in range(6000)]
    index = segments.SegmentedIndex.create(spark, f"file://{tmp_path}/i", stem=False).put(documents(rows))
    found, counts = index.search_counted(spark.createDataFrame([(1, "mo")], "query_id long, query string"), k=3)
    assert [r["chunk_id"] for r in found.orderBy("rank").collect()] == ["d00007", "d00008", "d00009"]
    c = counts.first()
    assert c["postings"] == 6000 and c["scored"] < 3000


def test_best_places_equals_scoring_everything():
    r = np.random.default_rng(1)
    for require_all in (True, False):
        lists = []
        for share in (0.7, 0.2, 0.05):
            p = np.flatnonzero(r.random(3000) < share)
            lists.append((p, r.integers(1, 9, len(p)).astype(float)))
        dl, dead = r.integers(10, 90, 3000).astype(float), np.flatnonzero(r.random(3000) < 0.1)
        idf, scores, met = [0.3, 1.0, 2.5], np.zeros(3000), np.zeros(3000)
        for (p, tf), w in zip(lists, idf):
            scores[p] += segments.part_of(w, tf, dl[p], 50.0)
            met[p] += 1
        met[dead] = 0
        good = np.flatnonzero(met == 3 if require_all else met > 0)
        best = good[np.lexsort((good, -np.round(scores[good], 9)))][:20]
        terms = []
        for p, tf in lists:
            rows = []
            for a in range(0, len(p), 16):
                q, t = p[a : a + 16], tf[a : a + 16]
                rows.append({"plain": True, "n": len(q), "first": q[0], "last": q[-1], "most": t.max(), "shortest": dl[q].min(), "places": q.astype("<i4").tobytes(), "tfs": t.tobytes(), "lengths": dl[q].tobytes()})
            terms.append(segments.Term(rows, dead))
        places, got, scored = segments.best_places(terms, idf, 50.0, 20, require_all, dead)
        assert places.tolist() == best.tolist() and np.allclose(got, scores[best])
        assert scored < sum(len(p) for p, _ in lists)
