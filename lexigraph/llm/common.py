"""Helpers shared by the corpus operators: shared folders, bounded text batches, row keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shuffles_dropped

#: Caches of this process's operators.
CACHES: list[dict] = []


def only(*mine: dict) -> None:
    """Empty the caches of other operators: a Python worker is used again by later stages, and its memory is theirs."""
    for c in CACHES:
        if not any(c is m for m in mine):
            c.clear()
    release()


def release() -> None:
    """Give memory that Python and Arrow have freed back to the machine, which else keeps it for this process."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and all runs on one machine (tests) a temporary folder is made and set; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lexigraph-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage is cut, lost executors cost nothing, and the shuffle files of the write go at its end."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
        taken.add(n.lower())
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def slices(batches: Iterator[pa.RecordBatch], text: int, limit: int = 1 << 20, rows: int = 4096) -> Iterator[list[list]]:
    """Columns as Python lists, in runs of at most ``rows`` rows and about ``limit`` characters of column ``text``.

    A run holds at least one row, so a longer text stands alone; null texts stay ``None``.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            columns = [c.to_pylist() for c in batch.slice(at, rows).columns]
            begin = size = 0
            for i, t in enumerate(columns[text]):
                n = len(t) if t else 0
                if size and size + n > limit:
                    yield [c[begin:i] for c in columns]
                    begin, size = i, 0
                size += n
            if begin < len(columns[text]):
                yield [c[begin:] for c in columns]
