"""DuckDB SQL of the column functions, for the oracles; the same rules and fixed values, in the other engine's spelling."""

from __future__ import annotations

from ..functions import values as V

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def trimmed(e: str) -> str:
    return f"trim({e}, {WS})"


def replaced(e: str, rules: list[tuple[str, str]]) -> str:
    for pattern, by in rules:
        pattern = pattern.replace("(?d)", "")
        by = by.replace("$1", "\\1").replace("$2", "\\2")
        e = f"regexp_replace({e}, {lit(pattern)}, {lit(by)}, 'g')"
    return e


def hash_id(prefix: str, e: str) -> str:
    return f"'{prefix}' || substr(sha256({e}), 1, 16)"


PATH = "source || '/' || CAST(doc_id AS VARCHAR) || '.txt'"
FIRST_LINE = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {trimmed('x')}), lambda x: length(x) > 3 AND length(x) < 200)[1]"
MARKDOWN_TITLE = trimmed(r"regexp_extract(text, '(?:^|\n)[ \t\f\r]*# ([^\n]*)', 1)")
#: The collection of documents.
DOCS = f"""docs AS (SELECT {hash_id('doc_', PATH)} AS document_id, doc_id, source AS source_id, {PATH} AS path,
  coalesce({FIRST_LINE}, CAST(doc_id AS VARCHAR) || '.txt') AS title, strlen(text) AS size, text AS content FROM documents)"""
READY = trimmed("replace(content, chr(13) || chr(10), chr(10))")
CHUNKS = f"""chunks AS (
  SELECT document_id, {hash_id('chunk_', "document_id || ':' || CAST(i - 1 AS VARCHAR) || ':' || w[i].t")} AS chunk_id, CAST(i - 1 AS INTEGER) AS chunk_index,
         CAST(w[i].b AS INTEGER) AS start_char, CAST(w[i].e AS INTEGER) AS end_char, w[i].t AS content
  FROM (SELECT document_id, w, unnest(range(1, len(w) + 1)) AS i FROM (
    SELECT document_id, list_filter(list_transform(x, lambda p: {{'b': p.b, 'e': p.e, 't': {trimmed('substring(c, p.b + 1, p.e - p.b)')}}}), lambda p: p.t <> '') AS w FROM (
      SELECT document_id, c, CASE WHEN n = 0 THEN [] WHEN n <= 1000 THEN [{{'b': CAST(0 AS BIGINT), 'e': n}}]
        ELSE list_concat(list_transform(range(0, CAST(ceil((n - 1000) / 900.0) AS BIGINT) + 1), lambda k: {{'b': k * 900, 'e': least(k * 900 + 1000, n)}}), [{{'b': n - 100, 'e': n}}]) END AS x
      FROM (SELECT document_id, c, CAST(length(c) AS BIGINT) AS n FROM (SELECT document_id, {READY} AS c FROM docs))))))"""


def tokens(e: str) -> str:
    return rf"list_filter(regexp_split_to_array(strip_accents(lower(coalesce({e}, ''))), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


#: The query table of the lexical searches: the first three words of every benchmark item.
ASKED = "asked AS (SELECT item_id AS query_id, array_to_string(string_split(text, ' ')[1:3], ' ') AS query FROM benchmark)"
TERMS = f"""terms AS (SELECT query_id, n_terms, t.term AS term, t.p AS is_prefix FROM (
  SELECT query_id, len(ts) AS n_terms, unnest(ts) AS t FROM (
    SELECT query_id, list_distinct(list_transform(range(1, len(w) + 1), lambda i: {{'term': w[i], 'p': i = len(w) AND length(w[i]) >= 2}})) AS ts FROM (SELECT query_id, {tokens('query')} AS w FROM asked))))"""
POSTINGS = f"""fields AS (SELECT document_id, {tokens('content')} AS a, {tokens('title')} AS b, {tokens('path')} AS c FROM docs),
lengths AS (SELECT document_id, len(a) + len(b) + len(c) AS dl FROM fields),
stats AS (SELECT count(*) AS n, avg(dl) AS mean FROM lengths),
occurrences AS (SELECT document_id, unnest(a) AS token, 0.5 AS weight FROM fields UNION ALL SELECT document_id, unnest(b), 1.0 FROM fields UNION ALL SELECT document_id, unnest(c), 1.0 FROM fields),
postings AS (SELECT document_id, token, sum(weight) AS weight FROM occurrences GROUP BY ALL)"""
SCORED = """wanted AS (SELECT DISTINCT term, is_prefix FROM terms),
hits AS (SELECT w.term, w.is_prefix, p.document_id, sum(p.weight) AS tf FROM wanted w JOIN postings p ON CASE WHEN w.is_prefix THEN starts_with(p.token, w.term) ELSE p.token = w.term END GROUP BY ALL),
rare AS (SELECT term, is_prefix, count(*) AS df FROM hits GROUP BY ALL),
parts AS (SELECT h.term, h.is_prefix, h.document_id,
  greatest(ln((s.n - r.df + 0.5) / (r.df + 0.5)), 1e-6) * CAST(h.tf AS DOUBLE) * 2.2 / (CAST(h.tf AS DOUBLE) + 1.2 * (0.25 + 0.75 * l.dl / s.mean)) AS part
  FROM hits h JOIN rare r USING (term, is_prefix) JOIN lengths l USING (document_id) CROSS JOIN stats s),
matched AS (SELECT t.query_id, p.document_id, sum(p.part) AS score, count(*) AS matched, max(t.n_terms) AS n_terms FROM parts p JOIN terms t USING (term, is_prefix) GROUP BY ALL)"""
BM25 = ",\n".join([DOCS, ASKED, TERMS, POSTINGS, SCORED])


#: The same over chunks: in these tables document_id is the chunk's id.
BM25_CHUNKS = ",\n".join([DOCS, CHUNKS, "units AS (SELECT c.chunk_id AS document_id, c.content, d.title, d.path FROM chunks c JOIN docs d USING (document_id))", ASKED, TERMS, POSTINGS.replace("FROM docs)", "FROM units)", 1), SCORED])


def page(source: str, limit: int = 10, order: str = "score DESC, document_id") -> str:
    return f"(SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS INTEGER) AS rank FROM {source}) WHERE rank <= {limit})"


#: Named vectors and the query vectors of the semantic searches: the mean vector of each label.
VECTORS = """vectors AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
asked_vectors AS (SELECT label AS query_id, list_transform(range(1, 65), lambda i: round(list_avg(list_transform(l, lambda x: x[i])), 9)) AS vector FROM (SELECT label, list(v) AS l FROM vectors GROUP BY label))"""
NEAR = """near AS (SELECT q.query_id, v.vec_id, list_cosine_similarity(v.v, q.vector) AS score FROM vectors v CROSS JOIN asked_vectors q)"""


def any_of(e: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({e}, {lit(p)})" for p in patterns) + ")"


def query_type(e: str, has_entities: str) -> str:
    return f"CASE WHEN contains({e}, '\"') OR contains({e}, '''') THEN 'exact_quote' WHEN {any_of(e, V.CONCEPTUAL)} THEN 'conceptual' WHEN {any_of(e, V.FACTUAL)} THEN 'factual' WHEN {has_entities} THEN 'entity' ELSE 'exploratory' END"


def names(words: list[str]) -> str:
    return "[" + ", ".join(lit(w) for w in words) + "]"


#: The graph that the star-schema tables make: places, suppliers, customers and parts, and what links them.
ENTITY = hash_id("ent_", r"regexp_replace(trim(lower(name)), '[ \t\n\f\r]+', ' ', 'g') || '|' || type")
GRAPH = f"""named AS (
  SELECT r_name AS name, 'location' AS type, 'region' AS description, 0.95 AS confidence, 'r' || r_regionkey AS key FROM region
  UNION ALL SELECT n_name, 'location', 'nation', 0.9, 'n' || n_nationkey FROM nation
  UNION ALL SELECT s_name, 'organization', 'supplier', 0.5 + round(abs(s_acctbal) / 25000, 2), 's' || s_suppkey FROM supplier
  UNION ALL SELECT c_name, 'person', lower(c_mktsegment), 0.5 + round(abs(c_acctbal) / 25000, 2), 'c' || c_custkey FROM customer
  UNION ALL SELECT p_name || ' ' || p_brand || ' ' || p_partkey, 'technology', lower(p_type), 0.5 + p_size / 100.0, 'p' || p_partkey FROM part),
entities AS (SELECT {ENTITY} AS entity_id, name, type, description, CAST(confidence AS DOUBLE) AS confidence, key FROM named),
pairs AS (
  SELECT 'n' || n_nationkey AS a, 'part_of' AS predicate, 'r' || n_regionkey AS b, 0.9 AS confidence FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'relates_to', 'n' || s_nationkey, 0.8 FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 'relates_to', 'n' || c_nationkey, 0.7 FROM customer
  UNION ALL SELECT DISTINCT 's' || l_suppkey, 'contains', 'p' || l_partkey, 0.6 FROM lineitem),
relations AS (SELECT s.entity_id AS subject_id, p.predicate, o.entity_id AS object_id, CAST(p.confidence AS DOUBLE) AS confidence FROM pairs p JOIN entities s ON s.key = p.a JOIN entities o ON o.key = p.b)"""
#: Queries to the graph.
GRAPH_ASKED = [("g1", "suppliers of ASIA"), ("g2", "nation in the machinery segment"), ("g3", "blue bolt"), ("g4", "what is Brand#17"), ("g5", "nothing here matches qqqq")]
GRAPH_QUERIES = "asked(query_id, query) AS (VALUES " + ", ".join(f"({lit(a)}, {lit(b)})" for a, b in GRAPH_ASKED) + ")"


def graph_tokens(e: str) -> str:
    return rf"list_filter(regexp_split_to_array(regexp_replace(lower({e}), '[^a-z0-9\-\s]', ' ', 'g'), '\s+'), lambda w: w <> '' AND NOT list_contains({names(V.STOP_WORDS)}, w) AND (length(w) > 2 OR regexp_matches(w, '^[a-z]{{2}}\z')))"


#: Scores of the candidates ``cand``, and the best twenty of each query.
ENTITY_SCORES = """each AS (SELECT *, list_transform(tokens, lambda w: CASE WHEN lower(name) = w THEN 1.0 WHEN starts_with(lower(name), w) THEN 0.8 WHEN contains(lower(name), w) THEN 0.6 WHEN contains(lower(description), w) THEN 0.3 ELSE 0.0 END) AS s FROM cand),
scored AS (SELECT query_id, entity_id, name, type, confidence, CASE WHEN len(s) = 0 THEN confidence ELSE 0.7 * CAST(list_sum(s) AS DOUBLE) * (0.5 + 0.5 * len(list_filter(s, lambda x: x > 0)) / len(s)) + 0.3 * confidence END AS score FROM each),
found AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, entity_id) AS INTEGER) AS rank FROM scored) WHERE rank <= 20)"""
ENTITY_HITS = f"""tok AS (SELECT query_id, {graph_tokens('query')} AS tokens FROM asked),
cand AS (SELECT * FROM (SELECT t.query_id, t.tokens, e.*, row_number() OVER (PARTITION BY t.query_id ORDER BY e.confidence DESC, e.entity_id) AS r
  FROM entities e JOIN tok t ON len(t.tokens) > 0 AND len(list_filter(t.tokens, lambda w: contains(lower(e.name || chr(10) || e.description), w))) > 0) WHERE r <= 60),
{ENTITY_SCORES}"""
