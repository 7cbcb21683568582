import math
import os
import re
import time
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigraph.llm import decontaminate, language, suffix_tree


def infix_distance(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item, 1):
            new.append(min(new[-1] + 1, row[i] + 1, row[i - 1] + (x != c)))
        row = new
        best = min(best, row[-1])
    return best


@settings(max_examples=300, deadline=None)
@given(st.text("abc ", min_size=1, max_size=12), st.text("abc ", max_size=40))
def test_bit_parallel_distance(item, text):
    assert decontaminate.myers(item, text)[0] == infix_distance(item, text)


def test_places_of_matches():
    item = "abcdefghijklmnopqrstuvwxyz"
    found = decontaminate.Finder([(1, item)], 0.1).find("xx " + item[:9] + "##" + item[9:] + " yy " + item[:-1])
    assert found == [(1, 1, 2, 35, 60)]
    assert decontaminate.Finder([(1, item)], 0.1).find("123" + item[:9] + "##" + item[9:] + "456") == [(1, 2, 2, 3, 31)]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=12), st.text("abc", max_size=30))
def test_the_place_has_the_distance(item, text):
    for i, d, _, start, stop in decontaminate.Finder([(0, item)], 0.3).find(text):
        row = list(range(len(item) + 1))
        for c in text[start:stop]:
            new = [row[0] + 1]
            for k, x in enumerate(item, 1):
                new.append(min(new[-1] + 1, row[k] + 1, row[k - 1] + (x != c)))
            row = new
        assert row[-1] == d


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", min_size=8, max_size=30), min_size=1, max_size=4), st.text("ab", max_size=80))
def test_finder_loses_no_match(items, text):
    rate = 0.15
    found = {(i, d) for i, d, *_ in decontaminate.Finder(list(enumerate(items)), rate).find(text)}
    want = {(i, d) for i, t in enumerate(items) if (d := infix_distance(t, text)) <= int(rate * len(t))}
    assert found == want


def test_contaminated_documents(spark, table, prose):
    items = [(1, prose(500, 30)), (2, prose(501, 25)), (3, None), (4, ""), (5, prose(502, 20)), (5, prose(502, 20))]
    worn = prose(501, 25).replace("the", "teh", 1).upper()
    docs = [(1, prose(1, 50) + " " + items[0][1].replace(" ", "  ") + " end"), (2, "start " + worn), (3, prose(2, 200)), (4, None), (5, ""), (6, items[4][1] * 2), (6, items[4][1] * 2), (None, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = sorted((r["doc_id"] or -1, r["item_id"], r["distance"] == 0) for r in decontaminate.matches(table(docs), bench).collect())
    assert [(a, b) for a, b, _ in got] == [(-1, 1), (1, 1), (2, 2), (6, 5), (6, 5)] and got[1][2]
    d = table(docs)
    clean = decontaminate.keep_clean(d, bench)
    assert clean.columns == d.columns and sorted(r["doc_id"] for r in clean.collect()) == [3, 4, 5]
    assert decontaminate.matches(d, bench.limit(0)).count() == 0 and decontaminate.matches(d.limit(0), bench).count() == 0
    assert decontaminate.keep_clean(d, bench.limit(0)).count() == len(docs)


def test_items_in_several_automata(spark, table, prose, monkeypatch):
    monkeypatch.setattr(decontaminate, "BATCH_CHARS", 100)
    items = [(i, prose(600 + i, 20)) for i in range(7)]
    docs = table([(i, "x " + t) for i, t in items])
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()) == [(i, i) for i in range(7)]


def two_languages(spark, n=120):
    make = lambda i, a: " ".join("".join(a[(i * 7 + j * k) % len(a)] for k in range(1, 4)) for j in range(1, 12))
    rows = [(2 * i, make(i, ["ka", "lo", "mi"]), "xx") for i in range(n)] + [(2 * i + 1, make(i, ["th", "er", "sch"]), "yy") for i in range(n)]
    return spark.createDataFrame(rows + [(9000, None, "xx"), (9001, "", "xx"), (9002, "123 !!", None), (9003, "KALOMI", None), (9004, "kalo " * 400_000, "xx")], "doc_id long, text string, lang string").withColumn("score", F.lit(1))


def test_languages(spark):
    docs = two_languages(spark)
    model = language.learn(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    got = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    assert all(got[i]["lang_pred"] == ("yy" if i % 2 else "xx") for i in range(240))
    assert [got[i]["lang_pred"] for i in (9000, 9001, 9002, 9003, 9004)] == ["und", "und", "und", "xx", "xx"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[9000]["score"] == 0
    kept = language.keep_identified(docs, model)
    assert kept.columns == docs.columns and {9000, 9001, 9002} & {r["doc_id"] for r in kept.collect()} == set()
    empty = language.learn(docs.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in language.predict(docs, empty).collect()} == {"und"} and language.predict(docs.limit(0), model).count() == 0


def test_naive_bayes_by_hand():
    docs = {"a": ["aab", "ab"], "b": ["bbb"]}
    orders, buckets = (1, 2), 64
    counts = {}
    for lang, texts in docs.items():
        found, _, _ = language.features(texts, orders, buckets)
        counts[lang] = sum(np.bincount(h, minlength=buckets + 1)[:buckets] for h in found)
    assert counts["a"].sum() == 5 + 3 and counts["b"].sum() == 3 + 2
    smooth = np.array([counts[x] + 0.5 for x in ("a", "b")])
    model = {"languages": ["a", "b"], "prior": np.log([2 / 3, 1 / 3]), "logs": np.log(smooth) - np.log(smooth.sum(1, keepdims=True)), "orders": orders, "buckets": buckets}
    found, _, _ = language.features(["ba"], orders, buckets)
    total = model["prior"] + sum(model["logs"][:, h[h < buckets]].sum(1) for h in found)
    langs, scores = language.score(["ba", "", None], model)
    assert langs == [["a", "b"][int(total.argmax())], "und", "und"] and math.isclose(scores[0], math.exp(total.max()) / math.fsum(np.exp(total)))


def test_pieces_count_every_ngram_once(monkeypatch):
    text = "the quick brown fox jumps over it"
    whole = [np.bincount(h, minlength=65)[:64] for h in language.features([text], (1, 2, 3), 64)[0]]
    monkeypatch.setattr(language, "PIECE", 7)
    cut, _, before = language.pieces([text], 2)
    found, starts, _ = language.features(cut, (1, 2, 3), 64)
    language._blank(found, starts, before, 64)
    assert all((np.bincount(h, minlength=65)[:64] == w).all() for h, w in zip(found, whole))


def test_suffix_tree_by_hand(spark, table, prose):
    rows = [(i, prose(i % 17, 60 + i % 17) + " " + prose(1000 + i, 20)) for i in range(90)] + [(200, None), (201, ""), (202, "UPPER lower\x0bTab\x1cé É"), (203, prose(3, 9000))]
    words = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None]
    count = Counter(w for i, t in rows if suffix_tree.in_training(i) for w in words(t))
    total, distinct = sum(count.values()), len(count)
    for least in (2, 4):
        want, states = deep_tree_by_hand([(i, " ".join(w for w in words(t) if w).replace("\x1c", "|")) for i, t in rows], 2, least=least)
        assert len(states) > 20
        for r in suffix_tree.score_documents(table(rows).repartition(3), smoothing=2.0, least=least, divergence=4.0).collect():
            i, s = r["doc_id"], words(dict(rows)[r["doc_id"]])
            base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in s)
            assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(s), sum(count[w] > 0 for w in s), total, zlib.crc32(str(i).encode()) % 5 == 1)
            assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], want[i], rel_tol=1e-5), i


def test_documents_that_occur_twice_score_apart(spark, table, prose):
    rows = [(i, prose(i, 120)) for i in range(300) if suffix_tree.in_training(i)]
    twice = rows[:10]
    copies = zip([i for i in range(1000, 1100) if suffix_tree.in_training(i)], twice)
    got = {r["doc_id"]: r["score"] / r["base_score"] for r in suffix_tree.score_documents(table(rows + [(i, t) for i, (_, t) in copies]), depth=8).collect()}
    assert max(got[i] for i, _ in twice) < min(got[i] for i, _ in rows[10:])


def test_suffix_tree_without_training(spark, table):
    held = [i for i in range(200) if not suffix_tree.in_training(i)][:3]
    got = suffix_tree.score_documents(table([(i, "a b c") for i in held])).collect()
    assert len(got) == 3 and all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["score"] == r["base_score"] == 0.0 for r in got)
    assert suffix_tree.score_documents(table([])).count() == 0


def deep_tree_by_hand(rows, depth, smoothing=2.0, least=2, divergence=4.0):
    """Scores with every context of up to ``depth`` words, tested whether or not its suffixes stay; and the retained contexts."""
    streams = {i: (t or "").lower().split() + [None] for i, t in rows}
    train = [s for i, s in streams.items() if suffix_tree.in_training(i)]
    count = Counter(w for s in train for w in s)
    total, distinct = sum(count.values()), len(count)
    followers = {}
    for s in train:
        for i, w in enumerate(s):
            for k in range(1, min(depth, i + 1) + 1):
                context = tuple((["^"] + s)[i + 1 - k : i + 1])
                if context != ("^",):
                    followers.setdefault(context, Counter())[w] += 1
    states = {}

    def p(context, w):
        while context and context not in states:
            context = context[1:]
        if not context:
            return (count[w] + 0.5) / (total + 0.5 * (distinct + 1))
        kept, n = states[context]
        return (kept.get(w, 0) + smoothing * p(context[1:], w)) / (n + smoothing)

    for context in sorted(followers, key=len):
        c = followers[context]
        n, kept = sum(c.values()), {w: k for w, k in c.items() if k >= 2}
        gain = sum(k * math.log((k - 1 + smoothing * p(context[1:], w)) / ((n - 1 + smoothing) * p(context[1:], w))) for w, k in kept.items())
        gain += (n - sum(kept.values())) * math.log(smoothing / (n - 1 + smoothing))
        if n >= least and kept and gain > divergence:
            states[context] = (kept, sum(kept.values()))
    return {i: sum(math.log10(p(tuple((["^"] + s)[max(0, k + 1 - depth) : k + 1]), w)) for k, w in enumerate(s)) for i, s in streams.items()}, states


def test_every_word_is_a_context(spark, table, prose):
    rows = [(i, "the of " + prose(i % 17, 60 + i % 17) + " of the " + prose(1000 + i, 20)) for i in range(90)] + [(200, None), (203, prose(3, 9000))]
    want, states = deep_tree_by_hand(rows, 2)
    assert ("of",) in states
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score_documents(table(rows)).collect()}
    assert all(math.isclose(got[i], x, rel_tol=1e-5) for i, x in want.items())


def test_hot_contexts_are_dealt_over_slots(spark, table, prose, monkeypatch):
    monkeypatch.setattr(suffix_tree, "HOT", 0.01)
    monkeypatch.setattr(suffix_tree, "BLOCK", 2000)
    monkeypatch.setattr(suffix_tree, "SLOT", 500)
    rows = [(i, "the of " + prose(i % 17, 60 + i % 17) + " of the " + prose(1000 + i, 20)) for i in range(90)]
    want, states = deep_tree_by_hand(rows, 2)
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score_documents(table(rows)).collect()}
    assert all(math.isclose(got[i], x, rel_tol=1e-5) for i, x in want.items())

def test_tests_use_exact_counts_of_rare_words(spark, table):
    train = [i for i in range(100) if suffix_tree.in_training(i)]
    common = " ".join(f"w{k}" for k in range(66_000))
    rows = [(i, common) for i in train[:5]] + [(i, "before after") for i in train[5:9]]
    total, distinct = 5 * 66_001 + 4 * 3, 66_003
    gain = lambda c: 4 * math.log((3 + 2 * (q := (c + 0.5) / (total + 0.5 * (distinct + 1)))) / (5 * q))
    middle = (gain(4) + gain(1)) / 2  # "after" occurs 4 times; as rare words used to count once, it would diverge more
    got = {r["doc_id"]: r for r in suffix_tree.score_documents(table(rows), divergence=middle).collect()}
    assert gain(5) < gain(4) < middle and all(math.isclose(got[i]["score"], got[i]["base_score"], rel_tol=1e-6) for i in train[5:9])

def test_longer_contexts_by_hand(spark, table, prose, monkeypatch):
    monkeypatch.setattr(suffix_tree, "BLOCK", 2000)
    monkeypatch.setattr(suffix_tree, "SLOT", 500)
    shared = " a b c d e "
    rows = [(i, prose(i % 17, 30) + " " + " ".join(f"{x} m n o p {y}" for x, y in (("left", "one"), ("right", "two"))) + shared + f"x{i % 3}" + shared + f"x{i % 3} " + prose(1000 + i, 20)) for i in range(90)] + [(200, None), (201, "left m n o p")]
    want, states = deep_tree_by_hand(rows, 8)
    assert max(map(len, states)) > 4
    for hot in (suffix_tree.HOT, 0.01):
        monkeypatch.setattr(suffix_tree, "HOT", hot)
        got = {r["doc_id"]: r["score"] for r in suffix_tree.score_documents(table(rows), depth=8).collect()}
        assert all(math.isclose(got[i], x, rel_tol=1e-5) for i, x in want.items())


def test_rounds_have_slots_for_what_they_test_and_leave_no_shuffle_files(spark, table, prose, monkeypatch):
    models, broadcast = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: models.append(x) or broadcast(self, x))
    monkeypatch.setattr(suffix_tree, "SLOT", 500)
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    size = lambda f: os.path.getsize(f) if os.path.exists(f) else 0
    files = lambda: {f for f in disk.getAllFiles().mkString(" ").split() if "shuffle_" in f and size(f) > 500}  # noqa: E731  # but for sums
    setting = spark.conf.get(suffix_tree._CLEANUP, None)
    docs, before = table([(i, prose(i, 120)) for i in range(100)] + [(i, prose(7, 120)) for i in range(200, 203)]), files()
    scored = suffix_tree.score_documents(docs, depth=8)
    for _ in range(50):  # executors remove them without being waited for
        if not files() - before:
            break
        time.sleep(0.1)
    slots = [m["slots"] for m in models[::2]]
    assert not files() - before and spark.conf.get(suffix_tree._CLEANUP, None) == setting
    assert slots[1] > 10 and slots[-1] * 5 < slots[1] and len(scored.collect()) == 103
