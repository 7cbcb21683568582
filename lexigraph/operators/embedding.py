"""Embedding by a model that takes lists of texts: stated batches, failures as rows, both counted by the job that writes them.

A model is loaded once in each Python worker and then stays there. A batch that fails, or whose answer is no list of finite vectors of one length, gives rows with an error and doesn't stop the job; its rows have no vector afterwards, so
the next run takes them again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.shared import fresh_folder
from .vector import entity_text

#: Gives one vector for each text.
Model = Callable[[list[str]], Sequence[Sequence[float]]]
#: Characters of a batch, beyond which it is sent before it has its number of texts.
MOST = 1 << 20
_loaded: dict[str, Model] = {}


@dataclass
class Vectorized:
    """Vectors ``vec_id, embedding`` with what was carried, failures ``vec_id, error``, and the number of each."""

    vectors: DataFrame
    failures: DataFrame
    vectorized: int
    failed: int


def _asked(model: Model, texts: list[str]) -> list[np.ndarray]:
    out = [np.asarray(v, dtype=np.float32) for v in model(texts)]
    if len(out) != len(texts):
        raise ValueError(f"{len(out)} vectors for {len(texts)} texts")
    if any(v.ndim != 1 or v.size == 0 or v.size != out[0].size or not np.isfinite(v).all() for v in out):
        raise ValueError("no finite vectors of one length")
    return out


def answers(model: Model, texts: list[str], isolate: bool) -> list[tuple[np.ndarray | None, str | None]]:
    """A vector or an error for each text. With ``isolate`` a batch that fails is halved until only texts that fail by themselves are left."""
    try:
        return [(v, None) for v in _asked(model, texts)]
    except Exception as error:  # whatever a model raises is its answer
        if not isolate or len(texts) == 1:
            return [(None, f"{type(error).__name__}: {error}")] * len(texts)
    half = len(texts) // 2
    return answers(model, texts[:half], True) + answers(model, texts[half:], True)


def embed(rows: DataFrame, load: Callable[[], Model], name: str, key: str, text: str, carry: Sequence[str] = (), size: int = 20, isolate: bool = False) -> DataFrame:
    """``vec_id, carry..., embedding, error`` of ``rows``: each has an embedding or an error. ``name`` is the model's, under which a worker keeps it. A null text isn't sent."""
    if size < 1:
        raise ValueError("a batch has one text or more")
    mine = rows.select(F.col(key).alias("vec_id"), *carry, F.make_valid_utf8(F.col(text)).alias("_text"))
    kept = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in mine.schema][:-1])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in mine.schema if f.name != "_text") + ", embedding array<float>, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded.get(name)
        if model is None:
            model = _loaded[name] = load()

        def sent(held: list[tuple]) -> pa.RecordBatch:
            texts = [t for *_, t in held if t is not None]
            got = iter(answers(model, texts, isolate)) if texts else iter(())
            found = [next(got) if t is not None else (None, "no text") for *_, t in held]
            columns = [pa.array([h[i] for h in held], f.type) for i, f in enumerate(kept)]
            return pa.record_batch([*columns, pa.array([v for v, _ in found], pa.list_(pa.float32())), pa.array([e for _, e in found], pa.string())], names=[*kept.names, "embedding", "error"])

        held, characters = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                characters += len(row[-1] or "")
                if len(held) == size or characters > MOST:
                    yield sent(held)
                    held, characters = [], 0
        if held:
            yield sent(held)

    return mine.mapInArrow(run, schema)


def vectorize(rows: DataFrame, load: Callable[[], Model], name: str, key: str = "chunk_id", text: str = "content", carry: Sequence[str] = (), size: int = 20, isolate: bool = False) -> Vectorized:
    """Embed ``rows`` once, into the shared folder."""
    seen, path = Observation(), fresh_folder(rows.sparkSession, "embedded")
    done = F.col("error").isNull()
    every = embed(rows, load, name, key, text, carry, size, isolate)
    every.observe(seen, F.count_if(done).alias("vectorized"), F.count_if(~done).alias("failed")).write.parquet(path)
    back = rows.sparkSession.read.schema(every.schema).parquet(path)
    return Vectorized(back.filter(done).drop("error"), back.filter(~done).select("vec_id", "error"), seen.get["vectorized"], seen.get["failed"])


def vectorize_entities(entities: DataFrame, load: Callable[[], Model], name: str, size: int = 20, isolate: bool = False) -> Vectorized:
    """Vectors with types of entities ``(entity_id, name, type, description)``, from their names and descriptions."""
    return vectorize(entities.select("entity_id", "type", entity_text(F.col("name"), F.col("description")).alias("content")), load, name, "entity_id", "content", ["type"], size, isolate)
