"""The knowledge graph: extraction results validated and resolved, entity search, relations, neighbourhoods and statistics.

Scores are positive, higher is better; names match by Unicode lower case. Edges refer to canonical entity ids.
"""

from __future__ import annotations

import json
from math import isfinite

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..sources.shared import written
from .fusion import RANK_CONSTANT

# extraction


def prompt_safe(c: Column, most: int = 5000) -> Column:
    """A text for a prompt: cut to ``most`` characters, with strings that could leave its frame filtered out."""
    cut = F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)
    for d in V.DANGEROUS:
        cut = F.regexp_replace(cut, "(?i)" + "".join("\\" + ch if not ch.isalnum() and ch not in " _" else ch for ch in d), "[FILTERED]")
    return cut


def alias_type(c: Column, aliases: dict[str, list[str]], default: str) -> Column:
    out = F.lit(default)
    low = F.lower(c)
    for kind, names in aliases.items():
        out = F.when(low.isin(names), kind).otherwise(out)
    return out


def entity_type(c: Column) -> Column:
    return alias_type(c, V.ENTITY_ALIASES, "concept")


def relation_type(c: Column) -> Column:
    return alias_type(c, V.RELATION_ALIASES, "relates_to")


def normal_name(c: Column) -> Column:
    spaced = F.regexp_replace(F.regexp_replace(T.trimmed(c), r"[\x00-\x1F\x7F-\x9F]", ""), r"[ \t\n\f\r]+", " ")
    return F.substring(F.btrim(spaced, F.lit(".,;:!?\"'()[]{}<>")), 1, 500)


def normal_description(c: Column) -> Column:
    plain = F.regexp_replace(T.trimmed(c), r"[\x00-\x09\x0B\x0C\x0E-\x1F\x7F-\x9F]", "")
    return F.when(F.length(plain) > 2000, F.concat(F.substring(plain, 1, 2000), F.lit("..."))).otherwise(plain)


def suspicious(c: Column) -> Column:
    out = F.lit(False)
    for p in V.SUSPICIOUS:
        out = out | c.rlike(p)
    return F.coalesce(out, F.lit(False))


def valid_entities(extracted: DataFrame, least: float = 0.5) -> DataFrame:
    """``chunk_id, document_id, entity_id, name, type, description, confidence`` of the acceptable rows of ``extracted (chunk_id, document_id, name, type, description, confidence)``."""
    kind = F.when(F.col("type").isin(list(V.ENTITY_ALIASES)), F.col("type")).otherwise("concept")
    shaped = extracted.filter(F.col("name").isNotNull() & (F.col("name") != "") & (F.length("name") <= 500) & F.col("confidence").between(max(0.0, least), 1.0))
    shaped = shaped.select("chunk_id", "document_id", normal_name(F.col("name")).alias("name"), kind.alias("type"), normal_description(F.coalesce("description", F.lit(""))).alias("description"), "confidence", F.col("description").alias("_raw"))
    good = shaped.filter((F.col("name") != "") & ~suspicious(F.col("name")) & ~suspicious(F.col("_raw"))).drop("_raw")
    return good.withColumn("entity_id", T.scoped_entity_id(F.col("name"), F.col("type"), F.col("document_id")))


def valid_relations(extracted: DataFrame, entities: DataFrame, least: float = 0.5) -> DataFrame:
    """``relation_id, subject_id, predicate, object_id, chunk_id, confidence`` of the rows of ``extracted (chunk_id, subject, predicate, object, confidence)`` whose ends are entities of the same chunk, by canonical id; no loops."""
    ends = entities.select("chunk_id", "name", T.entity_id(F.col("name"), F.col("type")).alias("id")).groupBy("chunk_id", "name").agg(F.max("id").alias("id"))
    rows = extracted.filter(F.col("confidence").between(max(0.0, least), 1.0)).select("chunk_id", normal_name(F.col("subject")).alias("s"), relation_type(F.coalesce("predicate", F.lit(""))).alias("predicate"), normal_name(F.col("object")).alias("o"), "confidence")
    rows = rows.join(ends.select("chunk_id", F.col("name").alias("s"), F.col("id").alias("subject_id")), ["chunk_id", "s"])
    rows = rows.join(ends.select("chunk_id", F.col("name").alias("o"), F.col("id").alias("object_id")), ["chunk_id", "o"]).filter("subject_id <> object_id")
    return rows.select(T.relation_id(F.col("subject_id"), F.col("predicate"), F.col("object_id")).alias("relation_id"), "subject_id", "predicate", "object_id", "chunk_id", "confidence")


RESPONSE = "struct<entities:array<struct<name:string,type:string,description:string,confidence:double>>,relations:array<struct<subject:string,predicate:string,object:string,confidence:double>>>"


def parse_response(raw: str | None) -> dict | None:
    """A model's answer as a dictionary: escapes repaired, the first balanced object, or the entities that a cut answer still holds; null where there is none."""
    if not raw:
        return None
    for mark in "_*#[]":
        raw = raw.replace("\\" + mark, mark)
    start = raw.find("{")
    if start < 0:
        return None
    try:
        found, _ = json.JSONDecoder(strict=False).raw_decode(raw[start:])
    except RecursionError:  # nested too deeply to be an answer
        return None
    except ValueError:
        found = _salvage(raw[start:])
    return found if isinstance(found, dict) else None


def _salvage(raw: str) -> dict | None:
    at = raw.find('"entities"')
    begin = raw.find("[", at) if at >= 0 else -1
    end = raw.rfind("}")
    while begin >= 0 and end > begin:
        try:
            return {"entities": json.loads(raw[begin : end + 1] + "]", strict=False), "relations": []}
        except RecursionError:
            return None
        except ValueError:
            end = raw.rfind("}", 0, end)
    return None


def _as_text(x) -> str | None:
    if isinstance(x, list):
        return ", ".join(_as_text(v) or "" for v in x)
    if isinstance(x, float):
        return f"{x:.0f}"
    return None if x is None else str(x)


def _as_confidence(x) -> float:
    try:
        number = float(x)
    except (TypeError, ValueError, OverflowError):
        return 0.8
    return number if isfinite(number) else 0.8


def _listed(answer: dict | None, name: str) -> list[dict]:
    """The objects of a list of the answer; anything else is none."""
    found = (answer or {}).get(name)
    return [x for x in found if isinstance(x, dict)] if isinstance(found, list) else []


def parse_responses(responses: DataFrame, least: float = 0.7, most_entities: int = 20, most_relations: int = 50) -> DataFrame:
    """``chunk_id, parsed, entities, relations`` of ``responses (chunk_id, raw)``; rows under the confidence go, then the lists are cut to their limits."""

    @F.pandas_udf(RESPONSE)
    def parsed(raw: pd.Series) -> pd.DataFrame:
        rows = []
        for r in raw:
            d = parse_response(r)
            e = [{"name": _as_text(x.get("name")), "type": _as_text(x.get("type")), "description": _as_text(x.get("description")), "confidence": _as_confidence(x.get("confidence"))} for x in _listed(d, "entities")]
            s = [{"subject": _as_text(x.get("subject")), "predicate": _as_text(x.get("predicate")), "object": _as_text(x.get("object")), "confidence": _as_confidence(x.get("confidence"))} for x in _listed(d, "relations")]
            rows.append((e, s) if d is not None else (None, None))
        return pd.DataFrame(rows, columns=["entities", "relations"])

    keep = lambda c, most: F.slice(F.filter(c, lambda x: x["confidence"] >= least), 1, most)
    out = responses.select("chunk_id", parsed("raw").alias("p"))
    return out.select("chunk_id", F.col("p.entities").isNotNull().alias("parsed"), keep(F.col("p.entities"), most_entities).alias("entities"), keep(F.col("p.relations"), most_relations).alias("relations"))


# resolution


def merge_entities(mentions: DataFrame) -> DataFrame:
    """One row per canonical entity of ``mentions (name, type, description, confidence, document_id, seq)``: first name, longest description, most confidence, all documents."""
    return _merged(mentions, F.array_sort(F.collect_set("document_id")).alias("documents"))


def _merged(mentions: DataFrame, *more: Column) -> DataFrame:
    keyed = mentions.withColumn("entity_id", T.entity_id(F.col("name"), F.col("type")))
    best = F.max_by("description", F.struct(F.length("description"), -F.col("seq")))
    return keyed.groupBy("entity_id").agg(F.min_by("name", "seq").alias("name"), F.first("type").alias("type"), best.alias("description"), F.max("confidence").alias("confidence"), *more, F.count(F.lit(1)).alias("mentions"))


def canonical_entities(mentions: DataFrame) -> DataFrame:
    """As ``merge_entities``, without the documents: a row stays small, however many documents name its entity. ``entity_sources`` has them."""
    return _merged(mentions)


def entity_sources(mentions: DataFrame) -> DataFrame:
    """``entity_id, document_id, mentions, confidence``: one row for each entity and document that names it; mentions without a document are no source."""
    keyed = mentions.filter("document_id is not null").select(T.entity_id(F.col("name"), F.col("type")).alias("entity_id"), "document_id", "confidence")
    return keyed.groupBy("entity_id", "document_id").agg(F.count(F.lit(1)).alias("mentions"), F.max("confidence").alias("confidence"))


def without_documents(entities: DataFrame, relations: DataFrame, sources: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, relations and sources without the documents of ``gone``: an entity goes with the last document that names it, a relation with either of its entities. An entity that never had a source stays."""
    left = sources.join(gone.select("document_id").distinct(), "document_id", "left_anti").select(*sources.columns)
    orphans = sources.select("entity_id").distinct().join(left.select("entity_id").distinct(), "entity_id", "left_anti")
    return (*detach(entities, relations, orphans), left)


def duplicate_entities(entities: DataFrame) -> DataFrame:
    """``name_key, type, copies, canonical_name, description`` of entities (name, type, description, confidence) that differ only in case and outer space."""
    key = T.trimmed(F.lower(F.col("name")))
    rows = entities.withColumn("name_key", key)
    return rows.groupBy("name_key", "type").agg(F.count(F.lit(1)).alias("copies"), F.min_by("name", F.struct(-F.col("confidence"), F.col("name"))).alias("canonical_name"), F.max_by("description", F.struct(F.length("description"), F.col("description"))).alias("description")).filter("copies > 1")


def last_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    columns = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("r")).select(key, "r.*")


def pending(chunks: DataFrame, status: DataFrame) -> DataFrame:
    """Chunks that have no status yet, or an error."""
    return chunks.join(status.select("chunk_id", "status"), "chunk_id", "left").filter(F.col("status").isNull() | (F.col("status") == "error"))


def error_class(message: Column) -> Column:
    low = F.lower(message)
    out = None
    for name, marks in V.ERROR_CLASSES:
        hit = F.lit(False)
        for m in marks:
            hit = hit | low.contains(m)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("Other")


# query

#: Postings lists that are intersected for a token, the shortest ones.
LISTS = 3


def grams(c: Column) -> Column:
    """The distinct pieces of one, two and three characters of a text."""
    cut = lambda n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substr(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(cut(1), cut(2), cut(3)))


def entity_text(entities: DataFrame) -> Column:
    """What tokens of a query are looked for in."""
    return F.lower(F.concat_ws("\n", "name", "description"))


def gram_postings(entities: DataFrame) -> DataFrame:
    """``gram, entity_id``: an index of names and descriptions that can be stored and given to searches."""
    return entities.select("entity_id", F.explode(grams(entity_text(entities))).alias("gram"))


def match_score(name: Column, description: Column, confidence: Column, tokens: Column) -> Column:
    """How well an entity meets tokens: exact name 1, beginning .8, part .6, description .3 each; with coverage, and .3 of the confidence."""
    low, about = F.lower(name), F.lower(F.coalesce(description, F.lit("")))
    each = F.transform(tokens, lambda t: F.when(low == t, 1.0).when(low.startswith(t), 0.8).when(low.contains(t), 0.6).when(about.contains(t), 0.3).otherwise(0.0))
    total = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
    hit = F.size(F.filter(each, lambda x: x > 0))
    return F.when(F.size(tokens) == 0, confidence).otherwise(0.7 * total * (0.5 + 0.5 * hit / F.size(tokens)) + 0.3 * confidence)


def looked_for(queries: DataFrame) -> DataFrame:
    """``query_id, tokens, needles, by_name`` of ``queries (query_id, query)``: the texts that make an entity a candidate.

    With ``hints`` (an array column, where there is one) these are parts of names; else the tokens; without tokens the whole query. A query without any text finds nothing.
    """
    none = F.array().cast("array<string>")
    tokens = F.coalesce(T.graph_tokens(F.col("query")), none)
    hints = F.coalesce(F.array_distinct(F.filter(F.transform("hints", lambda h: F.lower(h)), lambda h: h != "")), none) if "hints" in queries.columns else none
    whole = F.when(F.col("query") != "", F.array(F.lower("query"))).otherwise(none)
    return queries.select("query_id", tokens.alias("tokens"), hints.alias("_hints"), whole.alias("_whole")).select(
        "query_id", "tokens", F.when(F.size("_hints") > 0, F.col("_hints")).when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.col("_whole")).alias("needles"), (F.size("_hints") > 0).alias("by_name")
    )


def of_sources(entities: DataFrame, documents: DataFrame, source_ids: list[str]) -> DataFrame:
    """The entities that a document of these sources holds: ``document_id`` of an entity, or one of its array ``documents``."""
    mine = documents.filter(F.col("source_id").isin(source_ids)).select("document_id").distinct()
    if "documents" not in entities.columns:
        return entities.join(mine, "document_id", "left_semi")
    held = entities.select("entity_id", F.explode("documents").alias("document_id")).join(mine, "document_id", "left_semi").select("entity_id").distinct()
    return entities.join(held, "entity_id", "left_semi")


def entity_candidates(entities: DataFrame, queries: DataFrame, most: int = 60, postings: DataFrame | None = None) -> DataFrame:
    """``query_id, tokens`` and the entity: those that hold what is looked for (``looked_for``), the ``most`` confident of each query.

    The pieces of a needle (of three characters; shorter ones, if it has no more) are looked up in ``postings``; entities that are in the shortest of their lists are candidates, and only in these the needle is looked for.
    """
    asked = looked_for(queries).filter(F.size("needles") > 0)
    words = asked.select(F.explode("needles").alias("token")).distinct()
    pieces = words.select("token", F.explode(F.filter(grams(F.col("token")), lambda g: F.length(g) == F.least(F.length("token"), F.lit(3)))).alias("gram"))
    lists = written((gram_postings(entities) if postings is None else postings).join(pieces.select("gram").distinct(), "gram", "left_semi"), "gram-postings")
    sizes = lists.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = Window.partitionBy("token").orderBy(F.coalesce("n", F.lit(0)), "gram")
    chosen = pieces.join(sizes, "gram", "left").withColumn("_r", F.row_number().over(rarest)).filter(F.col("_r") <= LISTS)
    asked_lists = chosen.groupBy("token").agg(F.count(F.lit(1)).alias("lists"))
    met = chosen.join(lists, "gram").groupBy("token", "entity_id").agg(F.count(F.lit(1)).alias("n")).join(asked_lists, "token").filter(F.col("n") == F.col("lists"))
    held = met.select("token", "entity_id").join(entities, "entity_id").filter(F.contains(entity_text(entities), F.col("token"))).select("token", "entity_id", "confidence", F.contains(F.lower("name"), F.col("token")).alias("in_name"))
    wanted = asked.select("query_id", "by_name", F.explode("needles").alias("token"))
    pairs = held.join(wanted, "token").filter(F.col("in_name") | ~F.col("by_name")).select("query_id", "entity_id", "confidence").distinct()
    first = Window.partitionBy("query_id").orderBy(F.desc("confidence"), "entity_id")
    best = pairs.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= most).select("query_id", "entity_id")
    return best.join(asked.select("query_id", "tokens"), "query_id").join(entities, "entity_id")


def search_entities(entities: DataFrame, queries: DataFrame, limit: int = 20, postings: DataFrame | None = None) -> DataFrame:
    """``query_id, entity_id, name, type, score, rank``: entities whose name or description holds a token of ``queries (query_id, query)``; with hints, whose name holds a hint.

    As many as three times the limit (fifty at least) of the most confident are scored.
    """
    cut = entity_candidates(entities, queries, max(3 * limit, 50), postings)
    scored = cut.withColumn("score", match_score(F.col("name"), F.col("description"), F.col("confidence"), F.col("tokens")))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "entity_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("query_id", "entity_id", "name", "type", "score", "rank")


def fuse_entities(lexical: DataFrame, semantic: DataFrame, limit: int = 20) -> DataFrame:
    """Reciprocal-rank fusion of two ranked entity lists ``(query_id, entity_id, rank)``; what both hold counts 1.2 times."""
    both = lexical.select("query_id", "entity_id", F.col("rank").alias("a")).join(semantic.select("query_id", "entity_id", F.col("rank").alias("b")), ["query_id", "entity_id"], "full_outer")
    part = lambda r: F.coalesce(F.lit(0.5) / (RANK_CONSTANT + F.col(r)), F.lit(0.0))
    score = (part("a") + part("b")) * F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1.2).otherwise(1.0)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), F.least("a", "b"), "entity_id")
    return both.withColumn("score", score).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("query_id", "entity_id", "score", "rank")


def relations_of(hits: DataFrame, relations: DataFrame, entities: DataFrame, limit: int = 50) -> DataFrame:
    """``query_id, subject, predicate, object, confidence, rank``: relations with an end among a query's entities ``hits (query_id, entity_id)``, by confidence."""
    wanted = hits.select("query_id", "entity_id").distinct()
    touching = relations.join(wanted, F.col("subject_id") == F.col("entity_id")).drop("entity_id").unionByName(relations.join(wanted, F.col("object_id") == F.col("entity_id")).drop("entity_id"))
    names = entities.select("entity_id", "name")
    named = touching.join(names.select(F.col("entity_id").alias("subject_id"), F.col("name").alias("subject")), "subject_id", "left").join(names.select(F.col("entity_id").alias("object_id"), F.col("name").alias("object")), "object_id", "left")
    rows = named.select("query_id", F.coalesce("subject", "subject_id").alias("subject"), "predicate", F.coalesce("object", "object_id").alias("object"), "confidence").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("confidence"), "subject", "predicate", "object")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def undirected(relations: DataFrame) -> DataFrame:
    """``a, b`` for both directions of every relation, each once, without loops."""
    one = relations.select(F.col("subject_id").alias("a"), F.col("object_id").alias("b"))
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()


def neighbours(seeds: DataFrame, relations: DataFrame, entities: DataFrame, limit: int = 20) -> DataFrame:
    """``seed, entity_id, name, confidence, rank``: entities one step from each of ``seeds (entity_id)``, by confidence."""
    next_to = undirected(relations).join(seeds.select(F.col("entity_id").alias("a")).distinct(), "a")
    named = next_to.select(F.col("a").alias("seed"), F.col("b").alias("entity_id")).join(entities.select("entity_id", "name", "confidence"), "entity_id")
    order = Window.partitionBy("seed").orderBy(F.desc("confidence"), "entity_id")
    return named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def k_hop(seeds: DataFrame, relations: DataFrame, hops: int = 2) -> DataFrame:
    """``seed, entity_id, hops``: everything within ``hops`` steps (1 to 5), with the least number of steps; not the seed itself.

    Edges and each step's new pairs are written, so that a step reads what was found and not how it was found.
    """
    edges = written(undirected(relations), "edges")
    frontier = seeds.select(F.col("entity_id").alias("seed"), "entity_id").distinct().withColumn("hops", F.lit(0))
    reached = frontier
    for step in range(1, min(max(hops, 1), 5) + 1):
        out = frontier.join(edges, F.col("entity_id") == F.col("a")).select("seed", F.col("b").alias("entity_id")).distinct()
        frontier = written(out.join(reached.select("seed", "entity_id"), ["seed", "entity_id"], "left_anti").withColumn("hops", F.lit(step)), "frontier")
        reached = reached.unionByName(frontier)
    return reached.filter("hops > 0")


def graph_stats(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """``kind, label, n``: entities and relations, in all (null label) and by type."""
    rows = entities.select(F.lit("entity").alias("kind"), F.col("type").alias("label")).unionByName(relations.select(F.lit("relation").alias("kind"), F.col("predicate").alias("label")))
    return rows.groupingSets([["kind"], ["kind", "label"]], "kind", "label").agg(F.count(F.lit(1)).alias("n"))


def context(hits: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """``query_id, context``: entities and relations of each query as text, ten and fifteen at most, and how many more there are."""
    about = F.when(F.length("description") > 100, F.concat(F.substring("description", 1, 100), F.lit("..."))).otherwise(F.col("description"))
    line = F.concat(F.lit("- **"), F.col("name"), F.lit("** ("), F.col("type"), F.lit(")"), F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(": "), about)).otherwise(""), F.lit("\n"))
    named = hits.select("query_id", "entity_id", "rank").join(entities.select("entity_id", "name", "type", "description"), "entity_id")

    def listed(rows: DataFrame, text: Column, most: int, what: str) -> DataFrame:
        g = rows.select("query_id", "rank", text.alias("line")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("x"))
        body = F.array_join(F.transform(F.slice("x", 1, most), lambda r: r["line"]), "")
        more = F.when(F.size("x") > most, F.concat(F.lit("... and "), (F.size("x") - most).cast("string"), F.lit(f" more {what}\n"))).otherwise("")
        return g.select("query_id", F.concat(body, more).alias(what))

    first = listed(named, line, 10, "entities")
    second = listed(relations, F.concat(F.lit("- "), "subject", F.lit(" → "), "predicate", F.lit(" → "), "object", F.lit("\n")), 15, "relationships")
    both = first.join(second, "query_id", "left")
    return both.select("query_id", F.concat(F.lit("## Entities\n"), "entities", F.when(F.col("relationships").isNotNull(), F.concat(F.lit("\n## Relationships\n"), "relationships")).otherwise("")).alias("context"))


# point reads, filters, deletes, constraints


def entity_by_name(entities: DataFrame, name: str) -> DataFrame:
    """The one entity of a name, else the most confident whose name holds it; case counts in neither."""
    low = F.lower("name")
    exact = (low == name.lower()).cast("int")
    return entities.filter(low.contains(name.lower())).orderBy(F.desc(exact), F.desc("confidence"), "entity_id").limit(1)


def entity(entities: DataFrame, entity_id: str) -> DataFrame:
    return entities.filter(F.col("entity_id") == entity_id)


def find_entities(entities: DataFrame, name: str | None = None, kind: str | None = None, least: float = 0.0, document_id: str | None = None, limit: int = 50) -> DataFrame:
    """Entities by part of the name, type, confidence and document (a column document_id or an array documents), the most confident first."""
    out = entities.filter(F.col("confidence") >= least)
    if name:
        out = out.filter(F.lower("name").contains(name.lower()))
    if kind:
        out = out.filter(F.col("type") == kind)
    if document_id:
        out = out.filter(F.array_contains("documents", document_id) if "documents" in entities.columns else F.col("document_id") == document_id)
    return out.orderBy(F.desc("confidence"), "entity_id").limit(limit)


def put_relations(relations: DataFrame, new: DataFrame) -> DataFrame:
    """``relations`` with new ones in the place of those of the same id; loops are refused."""
    kept = new.filter(F.col("subject_id") != F.col("object_id"))
    return relations.join(kept.select("relation_id").distinct(), "relation_id", "left_anti").unionByName(kept.dropDuplicates(["relation_id"]), allowMissingColumns=True)


def detach(entities: DataFrame, relations: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without the entities ``gone (entity_id)`` and the relations that touch them."""
    ids = gone.select("entity_id").distinct()
    left = relations.join(ids.select(F.col("entity_id").alias("subject_id")), "subject_id", "left_anti").join(ids.select(F.col("entity_id").alias("object_id")), "object_id", "left_anti")
    return entities.join(ids, "entity_id", "left_anti"), left.select(*relations.columns)


def entity_faults(entities: DataFrame) -> DataFrame:
    """One row: how many entities break each rule."""
    c = F.col("confidence")
    return entities.agg(
        F.count_if(F.coalesce("name", F.lit("")) == "").alias("no_name"), F.count_if(F.length("name") > 500).alias("long_name"), F.count_if(F.length("description") > 2000).alias("long_description"),
        F.count_if(~F.coalesce(F.col("type").isin(list(V.ENTITY_ALIASES)), F.lit(False))).alias("bad_type"), F.count_if(~F.coalesce(c.between(0.0, 1.0), F.lit(False))).alias("bad_confidence"),
    )


def relation_faults(relations: DataFrame) -> DataFrame:
    """One row: how many relations break each rule."""
    c = F.col("confidence")
    return relations.agg(
        F.count_if(F.coalesce("subject_id", F.lit("")) == "").alias("no_subject"), F.count_if(F.coalesce("object_id", F.lit("")) == "").alias("no_object"),
        F.count_if(~F.coalesce(F.col("predicate").isin(list(V.RELATION_ALIASES)), F.lit(False))).alias("bad_predicate"), F.count_if(~F.coalesce(c.between(0.0, 1.0), F.lit(False))).alias("bad_confidence"),
    )


# the extraction stage


def extraction_prompt(title: Column, section: Column, content: Column, most_entities: int = 20, most_relations: int = 50, least: float = 0.7) -> Column:
    """The text that asks a model for the entities and relations of a chunk, with its inputs made safe."""
    kinds, links = ", ".join(V.ENTITY_ALIASES), ", ".join(V.RELATION_ALIASES)
    safe = lambda c: prompt_safe(F.coalesce(c, F.lit("")))
    return F.concat(
        F.lit("List the entities that the text names, and how they relate.\n<document_context>\nDocument: "), safe(title), F.lit("\nSection: "), safe(section), F.lit("\n</document_context>\n<text_to_analyze>\n"), safe(content),
        F.lit(f"\n</text_to_analyze>\n<extraction_rules>\nTypes of entities: {kinds}.\nTypes of relations: {links}.\nAt most {most_entities} entities and {most_relations} relations, each with a confidence of {least:.2f} to 1.\n</extraction_rules>\n<output_format>\nJSON: "),
        F.lit('{"entities": [{"name", "type", "description", "confidence"}], "relations": [{"subject", "predicate", "object", "confidence"}]}\n</output_format>'),
    )


def valid_requests(chunks: DataFrame, most: int = 10_240) -> DataFrame:
    """Chunks that may be asked about: with content, of a bounded number of bytes."""
    return chunks.filter((F.coalesce("content", F.lit("")) != "") & (F.octet_length("content") <= most))


def extract(responses: DataFrame, documents_of: DataFrame, least: float = 0.7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, relations and status rows of models' answers ``responses (chunk_id, raw, error)`` for chunks ``documents_of (chunk_id, document_id)``.

    Entities are merged under canonical ids, relations kept once; a chunk is completed, or an error with its message.
    """
    parsed = parse_responses(responses.filter(F.col("error").isNull()), least).join(documents_of.select("chunk_id", "document_id"), "chunk_id")
    e = parsed.select("chunk_id", "document_id", F.explode("entities").alias("e")).select("chunk_id", "document_id", "e.name", entity_type(F.col("e.type")).alias("type"), "e.description", "e.confidence")
    good = valid_entities(e)
    r = parsed.select("chunk_id", F.explode("relations").alias("r")).select("chunk_id", "r.subject", "r.predicate", "r.object", "r.confidence")
    links = last_by(valid_relations(r, good), "relation_id", "confidence")
    counts = good.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("entity_count"))
    status = responses.join(parsed.select("chunk_id", "parsed"), "chunk_id", "left").join(counts, "chunk_id", "left")
    done = F.col("error").isNull() & F.coalesce("parsed", F.lit(False))
    message = F.when(~done, F.coalesce("error", F.lit("no JSON found")))
    status = status.select("chunk_id", F.when(done, "completed").otherwise("error").alias("status"), F.coalesce("entity_count", F.lit(0)).alias("entity_count"), message.alias("error_message"))
    return merge_entities(good.withColumn("seq", F.xxhash64("chunk_id", "name"))), links, status


def retry_list(chunks: DataFrame, status: DataFrame, documents: DataFrame) -> DataFrame:
    """``chunk_id, error_message, class, title``: chunks whose extraction failed, with their document's title where it is known."""
    failed = chunks.select("chunk_id", "document_id").join(status.filter("status = 'error'").select("chunk_id", "error_message"), "chunk_id")
    return failed.join(documents.select("document_id", "title"), "document_id", "left").select("chunk_id", "error_message", error_class(F.col("error_message")).alias("class"), "title")


#: Classes of errors after which another try may help.
RETRYABLE = ("Timeout", "Connection", "Incomplete JSON")


def retryable(kind: Column) -> Column:
    """Whether another try may help: what the network or a cut answer caused."""
    return kind.isin(*RETRYABLE)


#: Answers after which a chunk isn't asked about again; seconds of the longest wait.
ATTEMPTS, LONGEST_WAIT = 5, 16


def status_upsert(history: DataFrame, most: int = ATTEMPTS) -> DataFrame:
    """``chunk_id, status, attempts, entity_count, error_message, updated_at, wait_seconds`` of all answers ``history (chunk_id, at, status, entity_count, error_message)``.

    The last answer wins; of answers at one time a completed one, then that of more entities, then that of the greater message. The wait before the next attempt doubles with each answer; it is null where another one is of no use, or was the last.
    """
    rank = F.struct("at", (F.col("status") == "completed").alias("done"), F.coalesce("entity_count", F.lit(-1)).alias("n"), F.coalesce("error_message", F.lit("")).alias("m"))
    last = history.groupBy("chunk_id").agg(F.count(F.lit(1)).cast("int").alias("attempts"), F.max_by(F.struct("at", "status", "entity_count", "error_message"), rank).alias("r"))
    rows = last.select("chunk_id", "r.status", "attempts", "r.entity_count", "r.error_message", F.col("r.at").alias("updated_at"))
    again = (F.col("status") == "error") & retryable(error_class(F.coalesce("error_message", F.lit("")))) & (F.col("attempts") < most)
    return rows.withColumn("wait_seconds", F.when(again, F.least(F.pow(F.lit(2.0), F.col("attempts") - 1), F.lit(float(LONGEST_WAIT))).cast("int")))


def answer_order(answer: tuple) -> tuple:
    """The order of ``status_upsert`` for one answer ``(at, status, entity_count, error_message)``."""
    at, status, count, message = answer
    return at, status == "completed", -1 if count is None else count, message or ""


def wait_of(status: str, message: str | None, attempts: int, most: int = ATTEMPTS) -> int | None:
    """The wait of ``status_upsert`` for one row."""
    low = (message or "").lower()
    kind = next((name for name, marks in V.ERROR_CLASSES if any(m in low for m in marks)), "Other")
    return min(1 << (attempts - 1), LONGEST_WAIT) if status == "error" and kind in RETRYABLE and attempts < most else None


def extraction_rates(chunks: DataFrame, status: DataFrame) -> DataFrame:
    """One row: chunks, those completed, their share in percent, and entities for each completed chunk; null where there is nothing to divide by."""
    both = chunks.select("chunk_id").join(status, "chunk_id", "left")
    done = F.coalesce(F.col("status") == "completed", F.lit(False))
    sums = both.agg(F.count(F.lit(1)).alias("chunks"), F.count_if(done).alias("completed"), F.sum(F.when(done, F.col("entity_count"))).alias("found"))
    return sums.select("chunks", "completed", F.try_divide(F.lit(100.0) * F.col("completed"), F.col("chunks")).alias("percent"), F.try_divide(F.col("found").cast("double"), F.col("completed")).alias("entities_each"))


def as_json(rows: DataFrame) -> Column:
    """All columns of a row as JSON."""
    return F.to_json(F.struct(*rows.columns))


ENTITY = "entity_id string, name string, type string, description string, confidence double"
RELATION = "relation_id string, subject_id string, predicate string, object_id string, confidence double"


def from_json(c: Column, schema: str = ENTITY) -> Column:
    """An entity or relation of its JSON; null where it is none."""
    return F.from_json(c, schema)
