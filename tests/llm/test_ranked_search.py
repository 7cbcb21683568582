import re
from math import floor, log

import pytest
from compare import SMALL, oracle, rows

from lexigraph.llm import ranked_search
from lexigraph.llm.queries import ORACLE_SQL, QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text)) if text else []


def brute(docs, items, k=20):
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    n_docs, total = len(held), sum(len(w) for _, w in held)
    df = {}
    for _, w in held:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in {x for x in items if x[1]}:
        found = []
        for i, w in held:
            m = 75 + 25 * len(w) * n_docs // total
            score = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * w.count(t) // (1000 * w.count(t) + 12 * m)) for t in terms(text) if t in df)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def ranked(table, spark, docs, items, k=20):
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = ranked_search.rank_documents(table(docs).repartition(3), asked.selectExpr("*", "1 as rank", "2 as score", "3 as part"), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()), key=str)


def test_terms():
    assert ranked_search.terms_of("Ab-c1_é Ü\x00x퟿ ÀB".encode()) == [t.encode() for t in terms("Ab-c1_é Ü\x00x퟿ ÀB")]


@pytest.mark.parametrize("postings, depth", [(1 << 20, 32), (40, 1), (7, 2)])
def test_same_rows_as_brute_force(spark, table, prose, monkeypatch, postings, depth):
    monkeypatch.setattr(ranked_search, "RUN_POSTINGS", postings)
    monkeypatch.setattr(ranked_search, "FIRST_DEPTH", depth)
    docs = [(i, prose(i % 40, 5 + i * 7 % 60)) for i in range(90)]  # equal texts, hence equal scores
    docs += [(5, docs[5][1]), (None, docs[6][1]), (200, None), (201, ""), (202, " -- \x00"), (203, "The THE the " * 5000)]
    items = [(1, prose(3, 8)), (2, "the of the"), (3, None), (4, ""), (5, "nowhere"), (6, docs[6][1]), (6, docs[6][1]), (7, "...")]
    assert ranked(table, spark, docs, items) == brute(docs, items)
    assert ranked(table, spark, docs, items, k=3) == brute(docs, items, 3)


def test_empty_tables(spark, table):
    assert ranked(table, spark, [], [(1, "a")]) == []
    assert ranked(table, spark, [(1, "a")], []) == []


def test_stops_before_the_end_of_the_lists():
    import numpy as np

    n, few = 5000, 50
    ids = np.arange(n)
    tfs = np.where(ids < few, 50, 1).astype("<u4")
    run = ranked_search.Run(ids, np.zeros(n, dtype=bool), np.full(n, 100), np.ones(n, dtype=np.int64), np.zeros(n, dtype="<u4"), tfs, np.array([700]), n, 100 * n)
    none = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int64))
    top, depth = run.search(np.array([0]), np.array([1]), np.array([1]), none, 20)
    assert top[2].tolist() == list(range(20)) and few <= depth < 200
    again, depth = run.search(np.array([0]), np.array([1]), np.array([1]), (top[0] + 10**9, top[1], top[2] + n), 20)
    assert depth == 0 and again[2].tolist() == (top[2] + n).tolist()


def test_registered_query(spark):
    got = QUERIES["op11_ranked_search"](spark, SMALL).toPandas()
    assert len(got) and rows(got) == rows(oracle(ORACLE_SQL["op11_ranked_search"]))
