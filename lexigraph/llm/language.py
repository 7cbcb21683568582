"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; everything that is not a letter counts as one kind of gap. Character n-grams of all orders in ``orders`` are hashed
into ``buckets`` columns. Counts for each language give a matrix of log probabilities, which is broadcast (its size is checked),
and texts are scored in numpy, batch by batch and whole, however long they are.

Null or letterless texts get ``und`` with score 0, as does every text when nothing was learned. Rows whose language or text is null teach
nothing. Ties go to the alphabetically first language. Repeated rows count and are answered each time. Other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, slices

UNKNOWN = "und"
#: Codes of a piece; longer texts are taken in pieces that overlap by the longest order less one.
PIECE = 1 << 20
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Of each code point, whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def features(texts: list[str], orders: tuple[int, ...], buckets: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of some texts: for each order the bucket of every n-gram (``buckets`` where there is none), the start of each text, and whether it has letters."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer(("\0".join(low) + "\0").encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    is_letter = letters()[codes]
    codes[~is_letter] = 32
    lengths = np.fromiter(map(len, low), dtype=np.int64, count=len(low)) + 1
    ends = np.cumsum(lengths)
    starts = ends - lengths
    codes[ends - 1] = 0
    broken = codes == 0
    found = []
    for n in orders:
        h = np.zeros(len(codes), dtype=np.int64)
        bad = broken.copy()
        for back in range(n):
            h[back:] += codes[: len(codes) - back] * (0x9E3779B1 * (2 * back + 1) ** 3 & 0x7FFFFFFF)
            bad[back:] |= broken[: len(codes) - back]
        bad[: n - 1] = True
        h = (h ^ (h >> 15)) * 0x2545F491 >> 7
        h = (h & 0x7FFFFFFF) % buckets
        h[bad] = buckets
        found.append(h)
    return found, starts, np.logical_or.reduceat(is_letter, starts)


def pieces(texts: list[str | None], overlap: int) -> tuple[list[str], list[int], list[int]]:
    """Texts cut into pieces; of each piece the text it is of and the number of codes that the piece before it has counted."""
    cut, owner, seen = [], [], []
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t or "")), PIECE):
            before = min(at, overlap)
            cut.append((t or "")[at - before : at + PIECE])
            owner.append(i)
            seen.append(before)
    return cut, owner, seen


def _blank(found: list[np.ndarray], starts: np.ndarray, seen: list[int], buckets: int) -> None:
    for at, n in zip(starts, seen):
        if n:
            for h in found:
                h[at : at + n] = buckets


def learn(docs: DataFrame, use: Column, orders: tuple[int, ...] = (1, 2, 3), buckets: int = 1 << 15, chunk: int = 1 << 12, rows: int = 200_000, limit: int = 1 << 28) -> dict:
    """The model of the rows for which ``use`` holds: languages, log priors and log probabilities.

    ``rows`` bounds the sample it is fitted on: where more rows qualify, those whose text and id hash below the matching
    fraction are used. ``limit`` bounds the matrix in bytes; more languages than that allows are an error.
    """
    some = docs.filter(use & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    n = some.count()
    if n > rows:
        some = some.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int((1 << 20) * rows / n))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        sums: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for langs, texts in slices(batches, 1):
            for lang in set(langs):
                mine = [t for x, t in zip(langs, texts) if x == lang]
                cut, _, before = pieces(mine, max(orders) - 1)
                found, starts, _ = features(cut, orders, buckets)
                _blank(found, starts, before, buckets)
                total = sums.setdefault(lang, np.zeros(buckets, dtype=np.int64))
                for h in found:
                    total += np.bincount(h, minlength=buckets + 1)[:buckets]
                seen[lang] = seen.get(lang, 0) + len(mine)
        yield from _counted(((lang, at // chunk, sums[lang][at : at + chunk], seen[lang] if not at else 0) for lang in sums for at in range(0, buckets, chunk)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], list] = {}
        for batch in batches:
            for lang, part, counts, docs_seen in zip(*(c.to_pylist() for c in batch.columns)):
                s = sums.setdefault((lang, part), [np.zeros(chunk, dtype=np.int64), 0])
                s[0] += np.frombuffer(counts, dtype="<i8")
                s[1] += docs_seen
        yield from _counted(((lang, part, c, d) for (lang, part), (c, d) in sums.items()))

    schema = "lang string, part int, counts binary, docs long"
    counted = some.select("lang", "text").mapInArrow(count, schema).repartition("lang", "part").mapInArrow(add, schema)
    languages = sorted(r[0] for r in some.select("lang").distinct().limit(limit // (8 * buckets) + 1).collect())
    if len(languages) * buckets * 8 > limit:
        raise ValueError(f"more than {limit // (8 * buckets)} languages: use fewer buckets or a larger limit")
    matrix = np.zeros((len(languages), buckets))
    prior = np.zeros(len(languages))
    for r in counted.collect():
        k = languages.index(r["lang"])
        matrix[k, r["part"] * chunk : (r["part"] + 1) * chunk] += np.frombuffer(r["counts"], dtype="<i8")
        prior[k] += r["docs"]
    smooth = matrix + 0.5
    logs = np.log(smooth) - np.log(smooth.sum(axis=1, keepdims=True))
    return {"languages": languages, "prior": np.log(prior) - np.log(prior.sum()) if len(languages) else prior, "logs": logs, "orders": orders, "buckets": buckets}


def _counted(rows) -> Iterator[pa.RecordBatch]:
    for lang, part, counts, docs in rows:
        yield pa.record_batch([pa.array([lang]), pa.array([part], pa.int32()), pa.array([np.ascontiguousarray(counts, dtype="<i8").tobytes()], pa.binary()), pa.array([docs], pa.int64())], names=["lang", "part", "counts", "docs"])


def score(texts: list[str | None], model: dict) -> tuple[list[str], list[float]]:
    """The language of each text and its posterior probability."""
    languages, buckets = model["languages"], model["buckets"]
    if not texts:
        return [], []
    cut, owner, before = pieces(texts, max(model["orders"]) - 1)
    found, starts, lettered = features(cut, model["orders"], buckets)
    _blank(found, starts, before, buckets)
    owner = np.array(owner)
    any_letter = np.zeros(len(texts), dtype=bool)
    np.logical_or.at(any_letter, owner, lettered)
    if not languages:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    total = np.tile(model["prior"], (len(texts), 1))
    for k in range(len(languages)):
        row = np.append(model["logs"][k], 0.0)
        by_piece = sum(np.add.reduceat(row[h], starts) for h in found)
        np.add.at(total[:, k], owner, by_piece)
    best = total.argmax(axis=1)
    shifted = np.exp(total - total.max(axis=1, keepdims=True))
    posterior = 1 / shifted.sum(axis=1)
    return [languages[b] if ok else UNKNOWN for b, ok in zip(best, any_letter)], [float(p) if ok else 0.0 for p, ok in zip(posterior, any_letter)]


def predict(docs: DataFrame, model: dict, key: str = "doc_id") -> DataFrame:
    """``key, lang_pred, score`` of every row; only the text is read for it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for batch in batches:
            langs, scores = [], []
            for (texts,) in slices(iter([batch.select(["text"])]), 0):
                a, b = score(texts, shared.value)
                langs += a
                scores += b
            yield pa.record_batch([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[key, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    return docs.select(key, "text").mapInArrow(run, StructType([StructField(key, kind), StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def keep_identified(docs: DataFrame, model: dict, least: float = 0.5) -> DataFrame:
    """The documents, unchanged, whose text has a language with a posterior of ``least`` or more; only ``text`` decides."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for batch in batches:
            keep = []
            for (texts,) in slices(iter([batch.select(["text"])]), 0):
                langs, scores = score(texts, shared.value)
                keep += [x != UNKNOWN and s >= least for x, s in zip(langs, scores)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
