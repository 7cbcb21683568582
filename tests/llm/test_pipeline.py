import corpus_pipeline
import __spark_entry__
from compare import SMALL, oracle, rows
from pyspark.sql import functions as F

from lexigraph.llm import decontaminate, packing
from lexigraph.llm.queries import ORACLE_SQL, QUERIES
from lexigraph.llm.tokens import encoder


def test_sql_expressible_queries_match(spark):
    for name, sql in ORACLE_SQL.items():
        assert rows(QUERIES[name](spark, SMALL).toPandas()) == rows(oracle(sql)), name


def test_everything_is_registered():
    names = set(__spark_entry__.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "packing"]


def test_stages_decide_as_meant(spark, prose, tmp_path):
    item = prose(900, 30)
    docs = [(i, prose(i, 60), "en") for i in range(30)]
    docs += [(100, prose(3, 60) + " more", "en"), (101, "12 34 -- 56", "en"), (102, None, "en"), (103, "lead " + item + " tail words", "en")]
    docs += [(104, prose(40, 80).replace("\n", " "), "en"), (105, prose(40, 80).replace("\n", " ") + " end of it", "en"), (106, prose(41, 60) + "\n" + prose(4, 60), "en")]
    df = spark.createDataFrame([(i, t, lang, "s", len(t) if t else None) for i, t, lang in docs], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    sf = str(tmp_path)

    def ids(frame):
        assert frame.columns == df.columns
        return {r["doc_id"] for r in frame.collect()}

    known = stages["language_id"](spark, df, sf)
    assert ids(known) == {i for i, *_ in docs} - {101, 102}
    lined = {r["doc_id"]: r for r in stages["line_dedup"](spark, known, sf).collect()}
    assert set(range(30)) <= set(lined) and all(lined[i]["text"] == t and lined[i]["n_chars"] == len(t) for i, t, _ in docs[:30])
    assert 105 not in lined and lined[106]["text"].strip() == prose(41, 60) and lined[106]["n_chars"] == len(lined[106]["text"])
    one = stages["ngram_jaccard_join"](spark, df.filter("doc_id in (104, 105, 1, 2)"), sf)
    assert ids(one) == {1, 2, 104}
    clean = stages["benchmark_decontamination"](spark, df, sf)
    assert ids(clean) == {i for i, *_ in docs} - {103}
    packed = corpus_pipeline.run(spark, sf).toPandas()
    assert set(packed.doc_id) == set(lined) - {103}
    texts = {i: r["text"] for i, r in lined.items()}
    assert packed.length.sum() == sum(len(encoder("byte_bpe_50k.json").encode([texts[i]])[0]) + 1 for i in set(packed.doc_id))
    assert packed.groupby("sequence_id").length.sum().max() <= 1024


def test_stages_keep_other_columns_and_take_empty_tables(spark, table, prose, tmp_path):
    docs = table([(i, prose(i, 60)) for i in range(6)] + [(7, prose(3, 60)), (8, None), (None, ""), (2, prose(2, 60))]).withColumn("lang", F.lit("en"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, prose(5, 60)), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = {r["doc_id"]: r.asDict() for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns and kept.schema == docs.schema, name
        for r in kept.collect():
            new, old = r.asDict(), before[r["doc_id"]]
            assert all(new[c] == old[c] for c in docs.columns if c not in ("text", "n_chars")), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_test_table_contamination_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    texts = [(r["doc_id"], decontaminate.normal(r["text"])) for r in docs.select("doc_id", "text").collect()]
    held = {(d, r["item_id"]) for r in items.collect() for d, t in texts if decontaminate.normal(r["text"]) in t}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, items).collect()}
    assert held <= got and held


def test_packing_of_the_test_table(spark):
    got = packing.pack_documents(spark.read.parquet(f"{SMALL}/documents.parquet")).toPandas()
    assert got.length.sum() / 1024 / got.sequence_id.nunique() > 0.98
