import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigraph.operators import vector, vector_index


@pytest.fixture(scope="module")
def clustered(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + 0.25 * r.normal(size=16)).tolist(), i % 3) for i in range(3000)]
    rows += [(5000, None, 0), (5001, [0.0] * 16, 0), (5002, [1.0, None] + [0.0] * 14, 0), (5003, [float("nan")] * 16, 0), (5004, [1.0, 2.0], 1), (5005, [2.0, 1.0], 1)]
    queries = [(i, (centres[i] + 0.25 * r.normal(size=16)).tolist()) for i in range(40)] + [(100, [0.0] * 16), (101, None), (102, [1.0, 1.9])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, kind int"), spark.createDataFrame(queries, "query_id long, vector array<double>")


@pytest.fixture(scope="module")
def index(spark, clustered, tmp_path_factory):
    return vector_index.VectorIndex.build(clustered[0], f"file://{tmp_path_factory.mktemp('index')}/v", cells=64, parts=8)


def shown(found):
    return sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in found.collect())


def test_every_vector_is_stored_in_its_cell(index):
    assert index.read("vectors").count() == index.read("codes").count() == 3000 and index.read("rest").count() == 2
    cells = index.read("cells")
    assert cells.count() == 64 and cells.agg(F.sum("n")).first()[0] == 3000
    assert {len(r["code"]) for r in index.read("codes").select("code").collect()} == {8}


@pytest.mark.parametrize("options", [{}, {"offset": 5}, {"where": "kind = 1"}, {"least": 0.9}])
def test_exact_mode_equals_a_scan(index, clustered, options):
    vectors, queries = clustered
    mine = vectors.filter(options["where"]) if "where" in options else vectors
    rest = {k: v for k, v in options.items() if k != "where"}
    assert shown(index.search(queries, 10, exact=True, **options)) == shown(vector.knn(mine, queries, 10, **rest))


@pytest.mark.parametrize("options", [{}, {"offset": 5}, {"where": "kind = 1"}])
def test_recall_while_most_cells_are_not_read(index, clustered, options):
    vectors, queries = clustered
    expected = shown(vector.knn(vectors.filter(options["where"]) if "where" in options else vectors, queries, 10, options.get("offset", 0)))
    got = shown(index.search(queries, 10, **options))
    pair = lambda rows: {(q, v) for q, _, v, _ in rows}
    assert len(pair(got) & pair(expected)) >= 0.95 * len(pair(expected))
    assert index.probes(45) < 32


def test_only_visited_cells_are_scanned(index, clustered):
    visited = np.zeros((1, 64), dtype=bool)
    visited[0, 3] = True
    plan = index._cells_of(index.read("codes"), visited)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell#", "").replace("(cell", "cell") or "cell" in plan.split("PartitionFilters")[1][:80]


def test_best_keeps_ties_by_id():
    best = vector.Best(2)
    best.limit = 3
    for ids, scores in (([5, 3], [0.5, 0.5]), ([4, 9], [0.5, 0.4]), ([1], [0.5 + 1e-12])):
        best.add(np.zeros(len(ids), dtype=np.int64), np.array(scores), np.array(ids))
    assert best.rows()[2].tolist() == [1, 3]
    words = vector.Best(2)
    words.add(np.zeros(3, dtype=np.int64), np.array([1.0, 1.0, 1.0]), np.array(["b", "a", "c"], dtype=object))
    assert words.rows()[2].tolist() == ["a", "b"]
