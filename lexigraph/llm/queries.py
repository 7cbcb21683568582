"""The queries of the corpus operators, over whole tables and with production parameters."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collisions, decontaminate, filter_audit, language, lines, ngram_join, packing, ranked_search, search, sharding, store, suffix_tree, urls
from .common import fold_of, table


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.token_store(table(spark, sf_dir, "documents"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_documents(table(spark, sf_dir, "documents"), depth=8)


def op4_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.lpt_shards(table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op6_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


#: The dated list entries of the URL query (host, action, moment).
LIST_ENTRIES = [
    ("ads-track.example.com", "add", "2023-12-01 00:00:00"),
    ("ads-track.example.com", "remove", "2024-04-10 12:00:00"),
    ("ads-track.example.com", "add", "2024-08-01 00:00:00"),
    ("adult-x.example.com", "add", "2024-02-01 00:00:00"),
    ("casino-win.example.net", "add", "2024-01-15 06:30:00"),
    ("casino-win.example.net", "remove", "2024-11-01 00:00:00"),
    ("cheap-pills.example.com", "add", "2023-06-01 00:00:00"),
    ("cheap-pills.example.net", "add", "2023-06-01 00:00:00"),
    ("free-bets.example.net", "add", "2024-06-01 00:00:00"),
    ("free-bets.example.net", "add", "2024-07-01 00:00:00"),
    ("spam-farm.example.org", "add", "2024-03-03 03:03:03"),
    ("blog.thther.example.org", "add", "2024-05-01 00:00:00"),
    ("tionsh.example.net", "add", "2024-03-01 00:00:00"),
    ("tionsh.example.net", "remove", "2024-03-08 00:00:00"),
    ("tionsh.example.net", "add", "2024-09-01 00:00:00"),
    ("tionsh.example.net", "remove", "2024-09-15 00:00:00"),
]


def op7_url_list_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have no fetch time; here page n is fetched 37 * n minutes, modulo a year, after the start of 2024."""
    entries = spark.createDataFrame(LIST_ENTRIES, "host string, action string, at string").select("host", "action", F.col("at").cast("timestamp_ntz").alias("listed_at"))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    fetched = start + F.make_dt_interval(mins=(F.col("page_id") * 37 % (366 * 1440)).cast("int"))
    return urls.url_list_join(table(spark, sf_dir, "pages").select("page_id", "url", fetched.alias("fetched_at")), entries)


OP7_SQL = f"""
WITH entries(host, action, listed_at) AS (
  SELECT h, a, CAST(t AS TIMESTAMP) FROM (VALUES {", ".join(str(e) for e in LIST_ENTRIES)}) v(h, a, t)),
intervals AS (
  SELECT host, action, listed_at AS valid_from, lead(listed_at) OVER (PARTITION BY host ORDER BY listed_at) AS valid_to
  FROM (SELECT host, listed_at, max(action) AS action FROM entries GROUP BY host, listed_at)),
seen AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]+)', 1)), '') AS host,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(page_id * 37 % (366 * 1440)) AS fetched_at
  FROM pages),
hits AS (
  SELECT s.host, s.fetched_at, i.host AS matched, i.valid_from,
         row_number() OVER (PARTITION BY s.host, s.fetched_at ORDER BY length(i.host) DESC) AS n
  FROM (SELECT DISTINCT host, fetched_at FROM seen) s
  JOIN intervals i ON i.action = 'add' AND (s.host = i.host OR ends_with(s.host, '.' || i.host))
   AND i.valid_from <= s.fetched_at AND (i.valid_to IS NULL OR s.fetched_at < i.valid_to))
SELECT s.page_id, s.host, s.fetched_at, h.matched IS NOT NULL AS blocked, h.matched, h.valid_from AS listed_at
FROM seen s LEFT JOIN hits h ON h.host = s.host AND h.fetched_at = s.fetched_at AND h.n = 1
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", F.size("removed").alias("n_removed"), "removed", "text")


def op9_edit_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold_of(F.col("doc_id")) == 0
    model = language.learn(docs, ~held_out)
    return language.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
sized AS (SELECT row_no, doc_id, terms, len(terms) AS n FROM d WHERE len(terms) > 0),
facts AS (SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS total FROM sized),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
postings AS (SELECT row_no, term, count(*) AS tf FROM (SELECT row_no, unnest(terms) AS term FROM sized) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * documents + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM postings, facts GROUP BY term, documents),
scored AS (
  SELECT a.item_id, s.row_no, s.doc_id, CAST(sum(a.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * s.n * f.documents) // f.total)))) AS BIGINT) AS score
  FROM asked a JOIN weights w USING (term) JOIN postings p USING (term) JOIN sized s USING (row_no), facts f GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= 20
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Every order is applied to every document.
OP12_SQL = rf"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first_id FROM texts),
failed AS (
  SELECT doc_id, part,
         CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN first_id < doc_id THEN 'E' ELSE '' END AS fails,
         doc_id IN (SELECT l.doc_id FROM labels l WHERE quality = 1 AND l.doc_id IS NOT NULL) AS good, doc_id IN (SELECT l.doc_id FROM labels l WHERE toxic = 1 AND l.doc_id IS NOT NULL) AS bad
  FROM words),
steps AS (
  SELECT o AS filter_order, CAST(i AS INTEGER) AS step, o[i] AS letter, o[1:i - 1] AS earlier
  FROM (VALUES {", ".join(f"('{''.join(p)}')" for p in permutations("ABCDE"))}) v(o), range(1, 6) r(i)),
judged AS (
  SELECT part, filter_order, step, letter, good, bad, fails, contains(fails, letter) AS own, regexp_matches(fails, '[' || earlier || '_]') AS gone
  FROM failed, steps),
counted AS (
  SELECT part, filter_order, step, letter, count(*) FILTER (NOT gone AND NOT own) AS kept, count(*) FILTER (NOT gone AND own) AS removed, count(*) FILTER (gone AND own) AS redundant,
         count(*) FILTER (fails = letter) AS unique_fails, count(*) FILTER (NOT gone AND own AND good) AS good_lost, count(*) FILTER (NOT gone AND own AND bad) AS toxic_lost
  FROM judged GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM counted
"""


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_store": op1_token_store,
    "op2_topk_search": op2_topk_search,
    "op3_suffix_tree_lm": op3_suffix_tree_lm,
    "op4_lpt_shards": op4_lpt_shards,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_sequence_packing": op6_sequence_packing,
    "op7_url_list_join": op7_url_list_join,
    "op8_line_dedup": op8_line_dedup,
    "op9_edit_decontamination": op9_edit_decontamination,
    "op10_language_id": op10_language_id,
    "op11_ranked_search": op11_ranked_search,
    "op12_filter_audit": op12_filter_audit,
    "op13_minhash_dedup": op13_minhash_dedup,
}

OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""

ORACLE_SQL = {"op2_topk_search": OP2_SQL, "op7_url_list_join": OP7_SQL, "op11_ranked_search": OP11_SQL, "op12_filter_audit": OP12_SQL}
