import random

from pyspark.sql import functions as F

from lexigraph.functions import text as T
from lexigraph.operators import lexical


def queries(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id long, query string")


def test_the_best_hits_are_among_those_that_are_kept(spark):
    r = random.Random(3)
    words = ["ka", "mo", "kat", "tira", "run"]
    rows = [(f"d{i:03d}", " ".join(r.choices(words, [5, 4, 3, 2, 1], k=r.randint(0, 12)))) for i in range(300)] + [(f"e{i:03d}", "mo tira") for i in range(40)]
    d = spark.createDataFrame(rows, "document_id string, content string").repartition(3)
    q = queries(spark, "ka mo", "tira", "mo tira", "k", "nothing", "")
    reading = lexical.Reading(d, q)
    for require_all in (True, False):
        order = [F.desc(F.round("score", 9)), F.col("document_id")]
        page = lambda found: sorted((x["query_id"], x["rank"], x["document_id"], round(x["score"], 9)) for x in lexical.ranked(found, 7, by=order).collect())
        every, few = reading.matches(require_all), reading.matches(require_all, 7)
        assert page(every) == page(few) and few.count() < every.count()
        plan = every._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan


def test_texts_of_pages_are_not_shuffled(spark):
    d = spark.createDataFrame([(f"d{i}", f"alpha number{i} and so on") for i in range(50)], "document_id string, content string")
    q = queries(spark, "number7", "alpha")
    hits = lexical.matches(d, q, top=3)
    got = lexical.with_snippets(hits.select("query_id", "document_id"), d, q)
    expected = hits.select("query_id", "document_id").join(d, "document_id").join(q, "query_id").withColumn("w", F.filter(F.split(F.lower("query"), r"\s+"), lambda w: w != "")).select("query_id", "document_id", T.snippet(F.col("content"), F.col("w")).alias("snippet"))
    as_set = lambda df: sorted(map(tuple, df.select("query_id", "document_id", "snippet").collect()))
    assert as_set(got) == as_set(expected)
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
