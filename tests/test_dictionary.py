import itertools

import pytest
from pyspark.sql import functions as F

from lexigraph.operators import dictionary, lexical

LETTERS = "abcdefghij"


@pytest.fixture(scope="module")
def terms(spark, tmp_path_factory):
    """100,000 terms of five letters."""
    path = f"file://{tmp_path_factory.mktemp('dictionary')}/terms"
    letter = lambda k: F.substring(F.lit(LETTERS), (F.floor(F.col("id") / 10**k) % 10 + 1).cast("int"), F.lit(1))
    dictionary.write(spark.range(100_000).select(F.concat(*(letter(k) for k in range(5))).alias("term"), "id"), path)
    return spark.read.schema("term string, id long").parquet(path)


def rows_read(df):
    """Rows that the scans of a plan handed on, after pages were left out."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan()
    nodes, read = [text], 0
    while nodes:
        node = nodes.pop()
        if "FileSourceScan" in node.getClass().getSimpleName():
            read += node.metrics().apply("numOutputRows").value()
        children = [node.children().apply(i) for i in range(node.children().size())]
        nodes += children + ([node.executedPlan()] if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else [])
    return read


@pytest.mark.parametrize("exact, begun", [(["abcde"], []), ([], ["abc"]), (["jjjjj", "aaaaa"], ["fff", "ffff", "f0"]), ([x + "bcda" for x in LETTERS + "xy"], ["zz"]), ([], []), (["", "é"], ["abcdefg"])])
def test_a_lookup_reads_few_pages_and_loses_no_term(terms, exact, begun):
    found = dictionary.narrowed(terms, (exact, begun))
    every = ["".join(t) for t in itertools.product(LETTERS, repeat=5)]
    assert sorted(r["term"] for r in found.collect()) == [t for t in every if t in exact or any(t.startswith(b) for b in begun)]
    assert rows_read(found) <= 3 * dictionary.PAGE_ROWS * max(1, len(exact) + len(begun)) and rows_read(terms) == 100_000


def test_shortest_beginnings_and_balanced_conditions(spark):
    names = [f"t{i}" for i in range(900)]
    d = spark.createDataFrame([(n,) for n in names], "term string")
    assert d.filter(dictionary.condition(F.col("term"), names[:450], ["t5", "t51", "t512"])).count() == 450 + len([n for n in names[450:] if n.startswith("t5")])
    assert d.filter(dictionary.condition(F.col("term"), [], [""])).count() == 900


def test_suggestions_from_the_index_equal_those_of_the_table(spark, tmp_path):
    titles = ["The Thing", "thermal paths", "Other thing", "Théâtre", None, "", "!!!", "Zebra", "the thing", "The Thing", "a%b_c"]
    d = spark.createDataFrame([(t,) for t in titles], "title string")
    built = dictionary.TitleIndex.build(d, f"file://{tmp_path}/titles")
    for prefix in ("th", "the", "TH", "thing", "z", "q", "b"):
        assert [r[0] for r in built.suggest(prefix).collect()] == [r[0] for r in lexical.suggest(d, prefix).collect()], prefix
    asked = spark.createDataFrame([(1, "th"), (2, "TH"), (3, "zeb"), (4, None), (5, ""), (6, "none")], "query_id long, prefix string")
    got = sorted((r["query_id"], r["rank"], r["title"]) for r in built.suggest_each(asked, 3).collect())
    first = [r[0] for r in lexical.suggest(d, "th", 3).collect()]
    assert got == [(q, i + 1, t) for q in (1, 2) for i, t in enumerate(first)] + [(3, 1, "Zebra")]
    assert built.suggest_each(asked.limit(0)).count() == 0
    empty = dictionary.TitleIndex.build(d.limit(0), f"file://{tmp_path}/none")
    assert empty.suggest("th").count() == empty.suggest_each(asked).count() == 0


def test_more_than_can_be_pushed(spark, tmp_path, monkeypatch):
    d = spark.createDataFrame([(f"c{i}", f"word{i} shared{i % 3}") for i in range(30)], "chunk_id string, content string")
    q = spark.createDataFrame([(1, "shared1"), (2, "word7 sha"), (3, "word2")], "query_id long, query string")
    built = lexical.TextIndex.build(d, f"file://{tmp_path}/index", stem=False)
    same = lambda: sorted((r["query_id"], r["chunk_id"], round(r["score"], 9)) for r in built.matches(q, False).collect())
    few = same()
    monkeypatch.setattr(dictionary, "MOST_PUSHED", 1)
    assert same() == few and few
