import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigraph.llm import lines, ngram_join, similar
from lexigraph.llm.components import UnionFind, components


def test_components_of_paths_stars_and_loops(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(1000, x) for x in range(1001, 1400)] + [(5000 + i, 5000 + (i + 1) % 7) for i in range(7)] + [(9, 9), (-5, -9), (-5, -9)]
    links += [(20_000 + r.randrange(300), 20_000 + r.randrange(300)) for _ in range(200)]
    sets = UnionFind()
    for a, b in links:
        sets.link(a, b)
    df = spark.createDataFrame(links + [(None, 1), (2, None)], "a long, b long").repartition(6)
    got = {x["node"]: x["root"] for x in components(df).collect()}
    want = {x: sets.find(x) for x in sets.parent}
    alone = {a for a, b in links if a == b}
    assert {k: v for k, v in want.items() if k in got} == got and set(want) - set(got) <= alone | {k for k in want if want[k] == k and k in alone}
    assert components(df.limit(0)).count() == 0


def changed(text, seed, n):
    r = random.Random(seed)
    words = text.split(" ")
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return " ".join(words)


def word_sets(rows, n=5):
    out = {}
    for i, t in rows:
        w = t.split() if t else []
        k = min(n, len(w))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if k else set()
    return out


def brute(sets, threshold=0.8):
    links, find = dict.fromkeys(sets, 0), UnionFind()
    for i in sets:
        find.find(i)
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and both >= threshold * (len(sets[a]) + len(sets[b]) - both):
            links[a] += 1
            links[b] += 1
            find.link(a, b)
    return {i: (find.find(i), links[i]) for i in sets}


def family(prose):
    base = prose(77, 160)
    rows = [(i, prose(i, 30 + i)) for i in range(25)]
    rows += [(100 + i, changed(base, i, 1 + i % 6)) for i in range(300)]  # larger than a tile
    rows += [(500 + i, prose(2, 32)) for i in range(40)] + [(600, None), (601, None), (602, ""), (603, " \n"), (604, ""), (605, "two words"), (606, "two words"), (607, "two  words"), (608, "one")]
    return rows


def test_join_equals_brute_force(spark, table, prose):
    rows = family(prose)
    want = brute(word_sets(rows))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.ngram_jaccard_join(table(rows).repartition(5)).collect()}
    assert got == want


def test_one_of_each_class_stays(spark, table, prose):
    rows = family(prose)
    want = {i for i, (c, _) in brute(word_sets(rows)).items() if c == i}
    docs = table(rows)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == want
    none = ngram_join.keep_one(table([(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f")]))
    assert [r["doc_id"] for r in none.collect()] == [3]
    assert ngram_join.ngram_jaccard_join(table([])).count() == 0


def test_one_of_repeated_rows_stays(spark, table):
    text, other = "alpha beta gamma delta epsilon\nsecond line of it", "quite another text that has no copy"
    rows = [(1, text)] * 3 + [(2, text), (3, other), (4, " "), (4, " ")]
    assert sorted(r["doc_id"] for r in ngram_join.keep_one(table(rows).repartition(3)).collect()) == [1, 3, 4, 4]
    assert [r["text"] for r in ngram_join.keep_one(table([(None, text)] * 3)).collect()] == [text]
    both = ngram_join.keep_one(lines.dedup_lines(table([(None, text), (None, text), (5, other), (5, other)])).drop("n_lines", "removed"))
    assert sorted(r["text"] for r in both.collect()) == [text, other] and both.count() == 2


def test_prefixes_are_shortened_to_the_recall():
    n = ngram_join.prefix_length(24, 0.8, 0.999)
    assert 1 - (1 - 0.8**n) ** 24 >= 0.999 > 1 - (1 - 0.8 ** (n + 1)) ** 24


def test_walks_stop_where_the_least_similarity_allows():
    for m in range(1, 60):
        values = [i / (m + n - i) for n in range(1, 90) for i in range(min(m, n) + 1)]
        assert abs(ngram_join.least_similarity(m, 0.8) - min(v for v in values if v >= 0.8 - 1e-9)) < 1e-9
    assert ngram_join.stop_of(3, 24, 0.8, 0.999) == ngram_join.stop_of(7, 24, 0.8, 0.999) == 64 and ngram_join.stop_of(5000, 24, 0.8, 0.999) == 56


def test_tries_link_whom_a_walker_meets():
    r = random.Random(5)
    for trial in range(60):
        rows = [(r.randrange(3) << 56 | r.randrange(2) << 48 | r.randrange(2) << 8 | r.randrange(3), i, r.choice([16, 56, 64])) for i in range(r.randrange(1, 40))]
        want = UnionFind()
        for (k, a, s), (m, b, t) in itertools.combinations(rows, 2):
            if k >> 64 - min(s, t) == m >> 64 - min(s, t):
                want.link(a, b)
        keys, nodes, stops = (np.array(c, dtype=d) for c, d in zip(zip(*rows), (np.uint64, np.int64, np.uint8)))
        got = UnionFind()
        half = len(rows) // 2  # two tasks, then the slots
        left = [similar._linked(keys[i], nodes[i], stops[i], (64, 56, 16)) for i in (slice(0, half), slice(half, None))]
        whole = similar._linked(*(np.concatenate(c) for c in list(zip(*left))[:3]), (64, 56, 16))
        for _, _, _, a, b in [*left, whole]:
            for x, y in zip(a.tolist(), b.tolist()):
                got.link(x, y)
        assert [got.find(i) for i in nodes.tolist()] == [want.find(i) for i in nodes.tolist()]


def test_recall_at_the_threshold():
    """Random pairs of similarity 0.8 to 0.82, short and long: at least 99.5 of 100 meet in a tree, at the stop of either."""
    r = np.random.default_rng(11)
    met = total = 0
    for size, pairs in ((9, 700), (150, 700), (5000, 60)):
        for _ in range(pairs):
            same = -(-8 * size // 9)
            both = r.integers(0, 1 << 63, 2 * size - same, dtype=np.uint64)
            a, b = both[:size], np.concatenate([both[:same], both[size:]])
            assert 0.8 <= same / len(both) < 0.83
            x, y = ngram_join.labels([a, b], 24)
            shift = np.uint64(64 - ngram_join.stop_of(size, 24, 0.8, 0.999))
            met, total = met + bool((x >> shift == y >> shift).any()), total + 1
    assert met / total >= 0.995


def test_texts_of_one_hash_stay_apart(spark, table, monkeypatch):
    """As if the first hash of all texts were the same."""
    monkeypatch.setattr(ngram_join, "identity", lambda: (F.lit(7).cast("long"), F.xxhash64(F.lit(1), F.col("text"))))
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "quite another text of words"), (4, None), (5, "")]
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in ngram_join.ngram_jaccard_join(table(rows)).collect()}
    assert got == {1: (1, 1, 2), 2: (1, 1, 2), 3: (3, 0, 1), 4: (4, 0, 1), 5: (5, 0, 1)}
    assert sorted(r["doc_id"] for r in ngram_join.keep_one(table(rows)).collect()) == [1, 3, 4, 5]


def line_sets(texts, n=8):
    return {t: {t[i : i + n] for i in range(max(1, len(t) - n + 1))} for t in texts}


def brute_lines(rows):
    texts = sorted({x.strip() for _, t in rows if t for x in t.split("\n") if x.strip()})
    classes = brute(line_sets(texts))
    seen, gone = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        gone[i] = []
        for k, x in enumerate(t.split("\n") if t else []):
            if x.strip():
                c = classes[x.strip()][0]
                if c in seen:
                    gone[i].append(k)
                seen.add(c)
    return gone


class _Text(UnionFind):
    pass


def test_lines_equal_brute_force(spark, table, prose):
    long, mid = prose(1, 120).replace("\n", " "), prose(2, 34).replace("\n", " ")
    rows = [(i, "\n".join([prose(100 + i, 12).replace("\n", " "), changed(long, i, i % 4), "  Shared footer line, the same everywhere. ", "", changed(mid, i, i % 2), mid + " " + "pad" * (i % 9), "ab", "x"])) for i in range(40)]
    rows += [(90, None), (91, ""), (92, "\n\n"), (93, "one line only"), (94, "one line only"), (95, prose(3, 5000))]
    docs = table(rows).repartition(4)
    got = {r["doc_id"]: r for r in lines.dedup_lines(docs).collect()}
    want = brute_lines(rows)
    assert {i: r["removed"] for i, r in got.items()} == want
    assert got[90]["text"] is None and got[92]["text"] == "\n\n" and got[94]["text"] == "" and got[95]["text"] == rows[-1][1]
    assert lines.dedup_lines(table([])).count() == 0


def test_repeated_rows_keep_the_same_lines(spark, table):
    got = lines.dedup_lines(table([(1, "alpha beta gamma\nother line here"), (1, "alpha beta gamma\nother line here"), (2, "alpha beta gamma")])).orderBy("doc_id").collect()
    assert [r["removed"] for r in got] == [[], [], [0]]


def test_lines_of_one_hash_stay_apart(spark, table, monkeypatch):
    real = lines.line_node
    monkeypatch.setattr(lines, "line_node", lambda line: 7 if line.startswith("hash") else real(line))
    rows = [(1, "hash of one kind"), (2, "hash of a very different other kind"), (3, "hash of one kind\nmore")]
    got = {r["doc_id"]: r["removed"] for r in lines.dedup_lines(table(rows)).collect()}
    assert got == {1: [], 2: [], 3: [0]}


def test_signatures_overlap_between_short_and_long_lines():
    r = random.Random(8)
    a = "".join(r.choice("abcdefghijklmnop") for _ in range(230))
    values, owner = lines.signatures([a, a[:150], a + a])
    assert list(owner).count(0) == 2 and list(owner).count(1) == 1 and list(owner).count(2) == 1 and len(values) == 4


@pytest.mark.parametrize("key", [(1, 0, 0), (1, 0, 1)])
def test_few_sets_have_the_links_of_many(key, monkeypatch):
    rng = np.random.default_rng(5)
    for _ in range(60):
        base = rng.integers(0, 1 << 60, rng.integers(0, 40)).astype(np.uint64)
        sets = [np.unique(np.where(rng.random(len(base)) < 0.1, rng.integers(0, 1 << 60, len(base)).astype(np.uint64), base)) for _ in range(rng.integers(2, similar.FEW + 1))]
        rows = [(int(rng.integers(-(1 << 60), 1 << 60)), int(rng.integers(0, 2)), int(rng.integers(1, 5)), "") for _ in sets]
        few = similar._compare(rows, key, sets, 0.8)
        with monkeypatch.context() as m:
            m.setattr(similar, "FEW", 0)
            assert sorted(few, key=str) == sorted(similar._compare(rows, key, sets, 0.8), key=str)


def test_groups_that_are_compared_share_calls():
    """Sets of many small groups are made together, and each group is compared by itself."""
    calls = []

    def shingles(texts):
        calls.append(len(texts))
        return lines.shingles(texts)

    groups = [((g, 0, 0), [(10 * g + i, 0, 1, f"line of group {g:05d} " * 3 + "." * i) for i in range(2)]) for g in range(50)]
    found = list(similar.compared(groups, shingles, 0.8))
    assert calls == [100] and sorted(f for f in found if f[1] is not None) == [(10 * g + 1, 10 * g, 0) for g in range(50)]


def test_line_deduplication_leaves_no_shuffle_files_before_it_is_read(spark):
    def kept():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle_") and n.endswith(".data")}

    docs = spark.createDataFrame([(i, f"a line that many documents share, word for word\nline of its own number {i * 7919}") for i in range(60)], "doc_id long, text string")
    before = kept()
    left = lines.dedup_lines(docs)
    assert not kept() - before
    assert left.filter("size(removed) > 0").count() == 59


def test_large_components_meet_by_rare_values_with_the_links_of_all_pairs(spark, monkeypatch):
    r = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    texts = {}
    for i in range(120):
        base = [r.choice(words) for _ in range(14)]
        for k in range(r.randint(1, 4)):
            texts[" ".join(base[: 14 - k] + [f"x{i}y{k}"] * (k > 1))] = i
    rows = [(i % 2, n, 1, t) for n, (t, i) in enumerate(texts.items())]
    make = lambda t: lines.shingles(t, 8)
    table = spark.createDataFrame(rows, "root long, node long, weight long, text string")
    every = components(similar.in_tiles(table.withColumn("tiles", F.lit(3)), make, 0.8).filter("b is not null").select("a", "b"))
    some = components(similar.in_prefixes(table, make, 0.8))
    as_set = lambda df: {tuple(x) for x in df.collect()}
    assert as_set(every) and as_set(every) == as_set(some)


def test_line_deduplication_gives_the_same_by_rare_values(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"line {i % 7} of a text that goes on and on, number {i // 3}, in the same words\nanother one {i}") for i in range(200)], "doc_id long, text string")
    removed = lambda: sorted((x["doc_id"], x["removed"]) for x in lines.dedup_lines(docs).collect())
    before = removed()
    monkeypatch.setattr(similar, "MOST_TILES", 0)
    assert removed() == before and any(x for _, x in before)
