import random
import re

import numpy as np
import pytest
from compare import SMALL

from lexigraph.llm import collisions, grouped
from lexigraph.llm.queries import QUERIES


def sets_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[j : j + 3]) for j in range(max(1, len(w) - 2))} if w else set()


def brute(docs):
    """By place: size of the set, least id in reach."""
    sets = [sets_of(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        near = {j for x in s for j in where.get(x, ())}
        for j in near:
            common = len(s & sets[j])
            if 100 * common >= 85 * (len(s) + len(sets[j]) - common):
                root[max(find(i), find(j))] = min(find(i), find(j))
        for x in s:
            where.setdefault(x, []).append(i)
    least = {}
    for i, (d, _) in enumerate(docs):
        known = [x for x in (least.get(find(i)), d) if x is not None]
        least[find(i)] = min(known, default=None)
    return sorted(((d, len(s), least[find(i)] if s else d, not s or d == least[find(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=str)


def deduplicated(table, docs):
    got = collisions.near_duplicates(table(docs).repartition(3))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted(map(tuple, got.collect()), key=str)


def changed(text, seed, share):
    r = random.Random(seed)
    return " ".join(f"x{seed}_{i}" if r.random() < share else w for i, w in enumerate(text.split()))


@pytest.mark.parametrize("rows, size", [(256, 1 << 20), (3, 600)])
def test_same_components_as_brute_force(spark, table, prose, monkeypatch, rows, size):
    for name, value in (("LIST_ROWS", rows), ("SET_ROWS", rows), ("SET_SIZE", size)):
        monkeypatch.setattr(collisions, name, value)
    docs = []
    for g in range(6):
        base = prose(g, 40 + 60 * g)
        docs += [(100 * g + i, changed(base, 100 * g + i, share)) for i, share in enumerate([0, 0.01, 0.015, 0.02, 0.025, 0.03, 0.04, 0.08])]
    docs += [(1000 + i, changed(docs[0][1] + " " + prose(50, 60), i, 0.02)) for i in range(4)]
    docs += [(2000, None), (2001, ""), (2002, " \t\x0b"), (2003, "one"), (2004, "ONE\n"), (2005, "one two"), (2006, "two one"), (2007, "one two"), (2008, "a b " * 30_000), (2009, "A B " * 29_000)]
    docs += [(5, docs[5][1]), (5, prose(9, 80)), (None, docs[9][1]), (None, "only here is it said"), (None, "only here is it said"), (3000, docs[3][1].upper())]
    assert deduplicated(table, docs) == brute(docs)


def test_large_group_in_chunks_of_bounded_size(spark, table, prose, monkeypatch):
    """600 near copies and some texts that are near to few of them, with chunks of 16 texts."""
    monkeypatch.setattr(collisions, "SET_ROWS", 16)
    base = prose(77, 150)
    docs = [(i, changed(base, i, 0.01 if i % 10 else 0.05)) for i in range(600)]
    assert deduplicated(table, docs) == brute(docs)


def test_empty_table(table):
    assert deduplicated(table, []) == []


def test_no_pair_at_the_threshold_is_lost():
    """Random pairs of similarity 0.85 to 0.87 collide often enough, and share a pair of their prefixes."""
    r = np.random.default_rng(3)
    missed = 0
    for size in (9, 40, 300, 2000):
        for _ in range(150):
            common = int(np.ceil(0.85 * size + 1e-9))
            both = [np.unique(r.integers(0, 1 << 63, common, dtype=np.uint64))]
            rest = [r.integers(0, 1 << 63, x, dtype=np.uint64) for x in ((size - common) // 2, (size - common + 1) // 2)]
            a, b = collisions.signatures([np.concatenate(both + [x]) for x in rest], 64)
            missed += (a == b).sum() < 40
    assert missed == 0


def test_spread_links_compares_each_place_with_what_is_left():
    groups, asked = np.array([0, 1, 0, 2, 1, 0, 2]), []

    def alike(i, js):
        asked.extend((i, int(j)) for j in js)
        return groups[js] == groups[i]

    links = grouped.spread_links(len(groups), alike)
    assert len(links) == len(groups) - 3 and all(groups[a] == groups[b] for a, b in links)
    assert len(asked) == len(set(asked))


def test_registered_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op13_minhash_dedup"](spark, SMALL).collect()), key=str) == brute(docs)
