import random
import re
from collections import Counter
from itertools import permutations
from math import factorial

import pytest
from compare import SMALL, oracle, rows
from pyspark.sql import functions as F

from lexigraph.llm import filter_audit
from lexigraph.llm.queries import ORACLE_SQL, QUERIES


def failures(text, copied):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return "".join(
        letter
        for letter, bad in {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": copied,
        }.items()
        if bad
    )


def brute(docs, labels):
    """Rows by (part, order, step), every order applied to every document."""
    docs = [(i, t or "", s or "") for i, t, s in docs]
    good, bad = ({i for i, q, x in labels if i is not None and (q, x)[at] == 1} for at in (0, 1))
    judged = [(i, s, failures(t, any(j is not None and i is not None and j < i and t == u for j, u, _ in docs))) for i, t, s in docs]
    out, removed = {}, Counter()
    for part in {s for _, s, _ in judged}:
        mine = [(i, f) for i, s, f in judged if s == part]
        for order in map("".join, permutations("ABCDE")):
            left = list(mine)
            for step, letter in enumerate(order, 1):
                gone = [(i, f) for i, f in left if letter in f]
                left = [x for x in left if letter not in x[1]]
                fails = sum(letter in f for _, f in mine)
                out[part, order, step] = [len(left), len(gone), fails - len(gone), sum(f == letter for _, f in mine), sum(i in good for i, _ in gone), sum(i in bad for i, _ in gone)]
                removed[part, letter] += len(gone)
    return {k: (*v, removed[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, docs, labels):
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    for c in ("part", "mask", "n", "good", "bad", "one", "two", "first", "step"):
        df = df.withColumn(c, F.lit(1))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x")).withColumn("part", F.lit(1))
    got = filter_audit.filter_audit(df.repartition(3), marks)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()}


def test_same_rows_as_every_order_applied(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice(["ab", "CD", "e#f", "gh", "i", "jk", "lm"] + [f"w{k}" for k in range(60)]) for _ in range(r.choice([3, 49, 50, 51, 90]))) for _ in range(25)]
    texts += ["", None, "a\x1cb c " * 30, "x\x0b\x0cy\r\n " * 200, " \t", "ABC", "word " * 100_000]
    docs = [(i, r.choice(texts), r.choice(["s", "t", None, ""])) for i in range(120)]
    docs += [(3, docs[3][1], "s"), (3, docs[3][1], "t"), (None, docs[4][1], "s"), (None, docs[4][1], "s"), (None, None, "u")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 130, 2)] + [(2, 1, 0), (2, 1, 1), (None, 1, 1)]
    assert audited(spark, docs, labels) == brute(docs, labels)


def test_one_text_in_many_copies_and_parts(spark):
    docs = [(i, "same words", f"s{i % 3}") for i in range(300)]
    got = audited(spark, docs, [(0, 1, 0), (1, 1, 1), (299, 0, 1)])
    assert got == brute(docs, [(0, 1, 0), (1, 1, 1), (299, 0, 1)])
    assert got["s0", "EABCD", 1][:2] == (1, 99) and got["s1", "EABCD", 1][:2] == (0, 100)


def test_empty_table(spark):
    assert audited(spark, [], [(1, 1, 1)]) == {}


@pytest.mark.parametrize("filters", [1, 3, 4])
def test_zeta_and_shares(spark, filters):
    r = random.Random(filters)
    counts = [r.randint(0, 9) for _ in range(1 << filters)]
    row = spark.range(1).select(filter_audit.zeta(F.array(*(F.lit(c).cast("long") for c in counts)), filters).alias("z")).first()["z"]
    assert row == [sum(c for m, c in enumerate(counts) if m & s == m) for s in range(1 << filters)]
    kept = [sum(c for m, c in enumerate(counts) if not m & s) for s in range(1 << filters)]
    shares = spark.range(1).select(filter_audit.shapley(F.array(*(F.lit(c).cast("long") for c in kept)), filters).alias("s")).first()["s"]
    assert sum(shares) == factorial(filters) * (kept[0] - kept[-1])


def test_registered_query(spark):
    got = QUERIES["op12_filter_audit"](spark, SMALL).toPandas()
    assert len(got) and rows(got) == rows(oracle(ORACLE_SQL["op12_filter_audit"]))
