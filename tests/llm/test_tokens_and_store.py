import functools
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexigraph.llm import packing, store, tokens
from lexigraph.llm.tokens import WordEncoder, encoder


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@settings(max_examples=150, deadline=None)
@given(text=st.text(st.one_of(st.sampled_from(" \t\n\r\x0b\x0c\x1c\x85  ab.,'sé́Σß🎉日"), st.characters()), max_size=40))
def test_words_give_the_ids_of_the_whole_text(name, text):
    text = text.encode("utf-8", "ignore").decode()
    e = encoder(name)
    assert e.encode([text])[0].tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def expected(rows, name, end):
    e = encoder(name)
    return [(i, np.array(e.tokenizer.encode(t or "", add_special_tokens=False).ids + [end], dtype="<u4")) for i, t in rows]


def test_store_round_trip(spark, table, prose, tmp_path):
    shared = prose(9, 900)
    rows = [(i, prose(i, 40 + 13 * i)) for i in range(12)] + [(20, None), (21, ""), (22, prose(1, 53)), (23, shared + " tail one"), (24, "head " + shared), (25, prose(5, 12_000)), (3, "same id, other text"), (26, prose(2, 66)), (26, prose(2, 66)), (27, "ends <|endoftext|> here <|startoftext|>")]
    path = f"file://{tmp_path}/store"
    got = store.token_store(table(rows), path=path).toPandas()
    assert len(got) == len(rows)
    want = expected(rows, "word_bpe_49k.json", 1)
    assert sorted(zip(got.doc_id, got.n_tokens, got.ids_crc32)) == sorted((i, len(x), zlib.crc32(x.tobytes())) for i, x in want)
    ordered = got.sort_values("start")
    assert ordered.doc_id.is_monotonic_increasing and (ordered.start == ordered.n_tokens.cumsum() - ordered.n_tokens).all()
    back = store.reconstruct(spark, path, [25, 24, 20])
    assert all((back[i] == x).all() for i, x in want if i in back)
    chunks = store._read(spark, path, "chunk")
    assert chunks.count() == chunks.select("address").distinct().count() and chunks.count() < sum(got.n_chunks)


def test_store_of_nothing(spark, table):
    assert store.token_store(table([])).count() == 0


def test_damage_is_found(spark, table, prose, tmp_path):
    path = f"file://{tmp_path}/store"
    store.token_store(table([(1, prose(1, 50))]), path=path)
    bad = store._recipes(spark, path).selectExpr("part", "row", "doc_id", "row_key", "start", "n_tokens + 1 as n_tokens", "root", "addresses", "lengths").collect()
    spark.createDataFrame(bad, store.RECIPES).write.mode("overwrite").parquet(f"{path}/recipes")
    with pytest.raises(ValueError, match="manifest"):
        store.verify(spark, path)
    with pytest.raises(Exception, match="damaged"):
        store.read(spark, path).collect()


@given(st.binary(max_size=200), st.binary(max_size=200))
def test_checksums_combine(a, b):
    shifted = store.crc_shift(np.array([zlib.crc32(a)]), np.array([len(b)]))[0]
    assert int(shifted) ^ zlib.crc32(b) == zlib.crc32(a + b)


@given(st.lists(st.binary(max_size=4), max_size=40))
def test_streamed_root_is_the_tree_root(leaves):
    roots = store.Roots()
    for x in leaves:
        roots.add(x)
    if len(leaves) in (0, 1, 2, 4, 8, 16, 32):
        assert roots.root() == store.merkle(leaves)
    other = store.Roots()
    for x in leaves:
        other.add(x)
    assert roots.root() == other.root()


@given(st.lists(st.integers(0, 49_000), max_size=3000))
def test_cuts_cover_the_stream(ids):
    x = np.array(ids, dtype="<u4")
    ends = store.cuts(x)
    assert (ends[-1] if ends else 0) == len(x) and ends == sorted(set(ends)) and all(b - a <= store.MOST for a, b in zip([0, *ends], ends))


def test_a_shared_passage_is_cut_alike(prose):
    r = np.random.default_rng(1)
    passage = r.integers(0, 49_000, 30_000).astype("<u4")
    a, b = (np.concatenate([r.integers(0, 49_000, n).astype("<u4"), passage]) for n in (17, 4001))
    chunks = [{x[i:j].tobytes() for i, j in zip([0, *store.cuts(x)], store.cuts(x))} for x in (a, b)]
    assert len(chunks[0] & chunks[1]) > 0.7 * min(map(len, chunks))


@given(st.lists(st.integers(1, 5000), max_size=60), st.sampled_from([64, 1024]))
def test_packing_keeps_every_token_once(lengths, capacity):
    rows = packing.pack(lengths, capacity)
    for item, n in enumerate(lengths):
        at = 0
        for start, length in sorted((r[1], r[2]) for r in rows if r[0] == item):
            assert start == at
            at += length
        assert at == n
    used = {}
    for _, _, length, s, offset in sorted(rows, key=lambda r: (r[3], r[4])):
        assert offset == used.get(s, 0)
        used[s] = offset + length
    assert all(u <= capacity for u in used.values()) and len(used) == -(-sum(lengths) // capacity) or not lengths


def test_short_pieces_are_spread_by_cost():
    rows = packing.pack([600] * 4 + [100] * 12, 1024)
    big = [r[3] for r in rows if r[0] < 4 and r[2] == 600]
    assert len(set(big)) == len(big)


def test_no_rest_is_cut_while_a_sequence_has_room():
    r = random.Random(5)
    lengths = [min(1023, int(r.lognormvariate(5.8, 0.9)) + 1) for _ in range(1500)]
    rows = packing.pack(lengths, 1024)
    room, cost = [1024] * -(-sum(lengths) // 1024), [0.0] * -(-sum(lengths) // 1024)
    waiting, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        s = min((s for s in range(len(room)) if room[s] >= n), key=lambda s: (cost[s], s), default=None)
        if s is None:
            waiting.append(i)
        else:
            want[i] = s
            room[s] -= n
            cost[s] += n + n * n / 512
    assert {r[0]: r[3] for r in rows if r[0] in want and r[2] == lengths[r[0]]} == want and len(waiting) < 150


def test_packed_documents(spark, table, prose):
    rows = [(i, prose(i, 30 * i)) for i in range(20)] + [(30, None), (31, ""), (32, prose(3, 4000)), (None, "no id"), (5, "twice"), (5, "twice")]
    got = packing.pack_documents(table(rows)).toPandas()
    want = sorted((-1 if i is None else i, len(x)) for i, x in expected(rows, "byte_bpe_50k.json", 0))
    assert got.length.sum() == sum(n for _, n in want)
    ids = dict(expected(rows, "byte_bpe_50k.json", 0))
    one = got[got.doc_id == 32]
    assert all(zlib.crc32(ids[32][s : s + n].tobytes()) == c for s, n, c in zip(one.start, one.length, one.ids_crc32))
    assert packing.pack_documents(table([])).count() == 0


def test_words_met_once_are_not_held():
    """A worker's memory goes to words that come again; most words of a corpus don't."""
    encode = WordEncoder("byte_bpe_50k.json")
    once = [f"w{i}x y{i}" for i in range(1000)]
    first = encode.encode(once)
    assert len(encode.words) < 20
    again = encode.encode(once)
    assert all((a == b).all() for a, b in zip(first, again)) and len(encode.words) > 1900
    assert all((a == b).all() for a, b in zip(again, encode.encode(once)))
    assert encode.words.keep + encode.pieces.keep <= 800_000


def test_each_distinct_word_of_a_run_is_looked_up_once():
    encoder, asked = tokens.WordEncoder("word_bpe_49k.json"), []

    class Counting(tokens._Cache):
        def __getitem__(self, key):
            asked.append(key)
            return super().__getitem__(key)

    encoder.words = Counting(encoder._word, 100, 1 << 10)
    texts = ["Some words, some WORDS it's (its) é É. a1b2 'quoted' x' \x1c", None, "", " \t\n", "words\x0bcafé's end ", "some words", "x <|endoftext|> y", "日本 words,"] * 3
    for _ in range(3):
        asked.clear()
        got = encoder.encode(texts)
        assert [g.tolist() for g in got] == [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert len(asked) == len(set(asked)) > 10
    assert encoder.encode([]) == [] and encoder.encode([None])[0].tolist() == []
