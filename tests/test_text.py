import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigraph.functions import text as T
from lexigraph.functions.stemmer import stem
from lexigraph.operators import chunkers


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def windows(n, size, overlap):
    step, out, pos = size - overlap, [], 0
    if n == 0:
        return []
    if n <= size:
        return [(0, n)]
    while pos < n:
        end = min(pos + size, n)
        out.append((pos, end))
        if end == n and n - pos <= overlap:
            break
        pos = pos + step if end < n else n - overlap if end - pos > overlap else n
    return out


@pytest.mark.parametrize("n", [0, 1, 999, 1000, 1001, 1900, 1901, 2500, 5400])
def test_windows(spark, n):
    got = [tuple(w) for w in spark.range(1).select(T.windows(F.lit(n), 1000, 100).alias("w")).first()["w"]]
    assert got == windows(n, 1000, 100)
    if n:
        covered = sorted(got)
        assert covered[0][0] == 0 and max(e for _, e in covered) == n and all(b[0] <= a[1] for a, b in zip(covered, covered[1:]))


def test_fixture_windows(spark):
    got = spark.range(1).select(T.windows(F.lit(2500), 1000, 100).alias("w")).first()["w"]
    assert [tuple(w) for w in got] == [(0, 1000), (900, 1900), (1800, 2500), (2400, 2500)]


@pytest.mark.parametrize("n,size,overlap,count", [(100, 1000, 100, 1), (1000, 500, 50, 3), (500, 500, 50, 1)])
def test_estimate(spark, n, size, overlap, count):
    assert spark.range(1).select(T.chunk_estimate(F.lit(n), size, overlap).alias("x")).first()["x"] == count


def test_chunks_of_short_and_empty_texts(spark):
    short = one(spark, T.fixed_chunks(F.col("t")), t="This is a short piece of content.")
    assert [(c["index"], c["content"]) for c in short] == [(0, "This is a short piece of content.")]
    assert one(spark, T.fixed_chunks(F.col("t")), t="") == []
    assert one(spark, T.fixed_chunks(F.col("t")), t=None) is None


def test_cleaning(spark):
    assert one(spark, T.clean(F.col("t")), t="A  b\t c \n\n\n\n x.....y\n- 42 -\nCopyright © 2020 Someone. Rest") == "A b c\n\nx y\n\n. Rest"
    assert one(spark, T.fix_pdf(F.col("t")), t="exam-\nple\n 12 \nend\fx") == "example\n\nend\nx"
    assert one(spark, T.fix_ocr(F.col("t")), t="The diSerent ofSce , and so.Yes") == "The different office, and so. Yes"
    many = "\n".join(["Header line"] * 4 + [f"line number {i}" for i in range(21)])
    assert one(spark, T.repeated_lines(F.col("t")), t=many) == ["Header line"]
    assert "Header" not in one(spark, T.without_repeated_lines(F.col("t")), t=many)


def test_sentences_and_packing(spark):
    assert one(spark, T.sentences(F.col("t")), t='One. Two! "Three" x. four\nFive') == ["One.", "Two!", '"Three" x. four', "Five"]
    text = " ".join(f"Sentence number {i} is here." for i in range(30))
    packed = one(spark, T.sentence_chunks(F.col("t"), 200, 50), t=text)
    assert len(packed) > 3 and all(len(p) <= 260 for p in packed) and all(f"number {i} is" in " ".join(packed) for i in range(30))


def test_identifiers(spark):
    a = one(spark, T.entity_id(F.col("n"), F.lit("concept")), n=" Big  Data ")
    assert a == one(spark, T.entity_id(F.col("n"), F.lit("concept")), n="big data") and a.startswith("ent_") and len(a) == 20
    r = T.relation_id(F.col("a"), F.lit("uses"), F.col("b"))
    assert one(spark, r, a="x", b="y") != one(spark, r, a="y", b="x")


def test_globs_titles_types(spark):
    assert one(spark, T.matches_any(F.col("n"), ["*.md", ".pdf"]), n="a.pdf") and not one(spark, T.matches_any(F.col("n"), ["*.md"]), n="a.mdx")
    assert one(spark, T.title(F.col("p"), F.col("t")), p="/x/a.md", t="intro\n# Head line\n") == "Head line"
    assert one(spark, T.title(F.col("p"), F.col("t")), p="/x/a.pdf", t="abc\nLong enough\n") == "Long enough"
    assert one(spark, T.title(F.col("p"), F.col("t")), p="/x/a.txt", t="# no") == "a.txt"
    assert one(spark, T.mime_type(F.col("p")), p="/x/a.JSON") == "application/json" and one(spark, T.mime_type(F.col("p")), p="/x/noext") == "text/plain"


def test_tokens_and_snippets(spark):
    assert one(spark, T.tokens(F.col("t")), t="Café-au-LAIT 3x!") == ["cafe", "au", "lait", "3x"]
    assert one(spark, T.tokens(F.col("t")), t=None) == []
    assert one(spark, T.graph_tokens(F.col("t")), t="What is the AI of Docker, docker 7x?") == ["ai", "docker"]
    text = "x" * 400 + " needle " + "y" * 400
    s = one(spark, T.snippet(F.col("t"), F.array(F.lit("needle"))), t=text)
    assert s.startswith("...") and s.endswith("...") and "needle" in s and len(s) == 3 + 150 + 6 + 150 + 3
    assert one(spark, T.snippet(F.col("t"), F.array(F.lit("absent"))), t="short") == "short"
    assert one(spark, T.semantic_snippet(F.col("t"), 20), t="Ten chars. And then some more") == "Ten chars. And then..."
    assert one(spark, T.bytes_text(F.lit(1536)), t="") == "1.5 KB"


@pytest.mark.parametrize("word,expected", [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("running", "run"), ("electricity", "electr"), ("adjustment", "adjust"), ("generalization", "gener"), ("controll", "control"), ("is", "is"), ("çà", "çà")])
def test_stems(word, expected):
    assert stem(word) == expected


@settings(max_examples=200, deadline=None)
@given(st.text("abcdefghijklmnopqrstuvwxyz", max_size=20))
def test_stems_never_grow_by_more_than_a_letter(word):
    assert len(stem(word)) <= len(word) + 1


def test_structured_chunks(spark):
    go = "package x\n" + "\n".join(f"func f{i}() {{\n{'  body()' * 40}\n}}" for i in range(3)) + "\ntype A struct {\n" + " field int\n" * 60 + "}"
    md = "before\n" + "\n".join(f"## Part {i}\n" + "Words are here. " * 30 for i in range(3))
    pdf = "\n\n".join("A paragraph of some length stands here. " * 12 for _ in range(5))
    d = spark.createDataFrame([("g", "a.go", go), ("m", "a.md", md), ("p", "a.pdf", pdf), ("t", "a.txt", "small"), ("e", "b.txt", ""), ("n", "c.txt", None)], "document_id string, path string, content string")
    got = {}
    for r in chunkers.chunk_by_type(d).orderBy("document_id", "chunk_index").collect():
        got.setdefault(r["document_id"], []).append((r["chunk_index"], r["block"], r["content"]))
    assert set(got) == {"g", "m", "p", "t"}
    assert [b for _, b, _ in got["g"]] == ["", "function", "function", "function", "class"] and got["g"][1][2].startswith("func f0")
    assert [b for _, b, _ in got["m"]] == ["", "Part 0", "Part 1", "Part 2"]
    assert all(len(c) <= 1000 for x in got.values() for _, _, c in x) and [i for i, *_ in got["p"]] == list(range(len(got["p"])))


def test_long_texts_are_cut_and_embedded_in_time(spark):
    import time

    from lexigraph.operators import vector

    text = "some words of a long text, one after the other.\n" * 40_000
    begin = time.time()
    got = one(spark, T.fixed_chunks(F.col("t")), t=text)
    assert len(got) == -(-(len(text.strip()) - 1000) // 900) + 2 and got[5]["content"] == text.strip()[4500:5500].strip(" \n")
    vectors = one(spark, vector.hashing_embedder(64)(F.col("t")), t="A b a c")
    tokens = one(spark, F.transform(T.tokens(F.col("t")), lambda x: F.struct(F.pmod(F.xxhash64(x), F.lit(64)), F.pmod(F.hash(x), F.lit(2)))), t="A b a c")
    expected = [0.0] * 64
    for slot, less in tokens:
        expected[slot] += -1.0 if less else 1.0
    assert vectors == expected and sum(map(abs, one(spark, vector.hashing_embedder(64)(F.col("t")), t=None))) == 0
    one(spark, F.size(vector.hashing_embedder(64)(F.col("t"))), t=text)
    assert time.time() - begin < 60
