"""A folder of files as a Spark data source, ``folder``: ``path, name, size, modified_at, content, error``.

Spark's own binary-file source lists every folder before any row can be left out, and a file that can't be read ends the job. Here excluded folders are left out before they are entered, tasks are planned by bytes, only files whose names fit
are opened, and a file that can't be read is a row without content and with its ``error``. Folders of one level are listed side by side. The listing is the driver's, as it is with Spark's file sources: names, sizes and times, no content.

A folder that can't be listed ends the read, as its files would seem deleted otherwise. Links to folders are not followed, as they could lead in circles. Larger files than ``most_bytes`` are left out.
An empty folder gives no rows; an empty file is a row, which Spark's binary-file source leaves out. The path must mean the same to the driver and all executors: a mounted folder, or a store that pyarrow reads by its address.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text as T

SCHEMA = "path string, name string, size long, modified_at timestamp, content binary, error string"
#: Bytes of files that one task reads, what opening a file counts as, and bytes of contents that a task holds before it hands them on.
TASK_BYTES, OPEN_BYTES, BATCH_BYTES = 128 << 20, 4 << 20, 16 << 20
#: Rows that are handed on together where no contents are read.
BATCH_ROWS = 10_000
#: Folders that are listed at a time.
LISTERS = 16


@dataclass(frozen=True)
class Listed:
    """A file as its folder lists it; ``size`` is null for what is no file that could be read, such as a link to nothing."""

    path: str
    size: int | None
    micros: int | None


@dataclass
class Share(InputPartition):
    """The files of one task."""

    files: list[Listed]


def _patterns(globs: list[str]) -> list[re.Pattern]:
    return [re.compile(T.glob_regex(g).removesuffix("\\z")) for g in globs]


def _store(folder: str) -> tuple[fs.FileSystem, str, str]:
    """The store of an address, the folder in it, and what stands before a path of it in the addresses that Spark gives."""
    bare = re.sub(r"^file:(//)?", "", folder)
    if bare.startswith("/"):
        return fs.LocalFileSystem(), bare.rstrip("/") or "/", "file:"
    store, path = fs.FileSystem.from_uri(folder)
    return store, path.rstrip("/"), folder.rstrip("/").removesuffix(path.rstrip("/"))


def _entries(store: fs.FileSystem, folder: str) -> list[tuple[str, Listed | None]]:
    """Names in a folder, with null for folders; without links to folders. A link to nothing is a file that can't be read."""
    if not isinstance(store, fs.LocalFileSystem):
        return [(i.base_name, None if i.type == fs.FileType.Directory else _listed(i)) for i in store.get_file_info(fs.FileSelector(folder))]
    out: list[tuple[str, Listed | None]] = []
    with os.scandir(folder) as entries:
        for e in entries:
            if e.is_dir(follow_symlinks=False):
                out.append((e.name, None))
            elif not e.is_dir():
                try:
                    stat = e.stat()
                    out.append((e.name, Listed(e.path, stat.st_size, _millis(stat.st_mtime_ns))))
                except OSError:
                    out.append((e.name, Listed(e.path, None, None)))
    return out


def listing(folder: str, patterns: list[str], excludes: list[str], most_bytes: int) -> list[Listed]:
    """The files below ``folder`` whose names fit, by path; excluded folders are not entered."""
    store, root, _ = _store(folder)
    fitting, left_out = _patterns(patterns), _patterns(excludes)
    out: list[Listed] = []
    level = [root]
    with ThreadPoolExecutor(LISTERS) as pool:
        while level:
            below: list[str] = []
            for parent, entries in zip(level, pool.map(lambda d: _entries(store, d), level)):
                for name, file in entries:
                    if file is None:
                        if not any(p.fullmatch(name) for p in left_out):
                            below.append(f"{parent.rstrip('/')}/{name}")
                    elif any(p.fullmatch(name) for p in fitting) and (file.size is None or file.size <= most_bytes):
                        out.append(file)
            level = below
    return sorted(out, key=lambda f: f.path)


def named(folder: str, paths: list[str], most_bytes: int) -> list[Listed]:
    """Some files by their addresses, whatever lies beside them."""
    store, _, prefix = _store(folder)
    infos = store.get_file_info([p.removeprefix(prefix) for p in paths])
    return [_listed(i) for i in infos if i.type != fs.FileType.File or i.size is None or i.size <= most_bytes]


def _listed(info: fs.FileInfo) -> Listed:
    return Listed(info.path, info.size, _millis(info.mtime_ns)) if info.type == fs.FileType.File else Listed(info.path, None, None)


def _millis(nanos: int | None) -> int | None:
    """Whole milliseconds, as Spark's file sources give them, in microseconds."""
    return None if nanos is None else nanos // 1_000_000 * 1000


def shares(files: list[Listed], task_bytes: int = TASK_BYTES, open_bytes: int = OPEN_BYTES) -> list[Share]:
    """Files in order, cut into tasks of about ``task_bytes``; a larger file has a task to itself."""
    out, held = [], 0
    for f in files:
        weight = (f.size or 0) + open_bytes
        if not out or held + weight > task_bytes:
            out.append(Share([]))
            held = 0
        out[-1].files.append(f)
        held += weight
    return out


class FolderReader(DataSourceReader):
    def __init__(self, folder: str, patterns: list[str], excludes: list[str], most_bytes: int, content: bool, task_bytes: int, paths: list[str] | None = None):
        self.folder, self.patterns, self.excludes, self.most_bytes, self.content, self.task_bytes, self.paths = folder, patterns, excludes, most_bytes, content, task_bytes, paths

    def partitions(self) -> list[Share]:
        files = listing(self.folder, self.patterns, self.excludes, self.most_bytes) if self.paths is None else named(self.folder, self.paths, self.most_bytes)
        if self.content:
            return shares(files, self.task_bytes) or [Share([])]
        return [Share(files[i : i + BATCH_ROWS]) for i in range(0, len(files), BATCH_ROWS)] or [Share([])]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        store, _, prefix = _store(self.folder)
        rows, held = [], 0
        for f in partition.files:
            content, error = None, None
            if self.content or f.size is None:
                try:
                    with store.open_input_stream(f.path) as stream:
                        content = stream.read(self.most_bytes + 1) if self.content else None  # never more, should it have grown
                    if content is not None and len(content) > self.most_bytes:
                        content, error = None, "larger than when it was listed"
                except OSError as e:
                    error = f"{type(e).__name__}: {e}"
            rows.append((prefix + f.path, f.path.rpartition("/")[2], f.size, f.micros, content, error))
            held += len(content or b"")
            if held >= BATCH_BYTES or len(rows) == BATCH_ROWS:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.string(), pa.int64(), pa.timestamp("us", tz="UTC"), pa.binary(), pa.string()]
    names = ["path", "name", "size", "modified_at", "content", "error"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


class FolderSource(DataSource):
    """Options: ``path``; ``patterns`` and ``excludes`` of names, and addresses of files (``only``) where not all are to be read, as JSON arrays; ``content`` (false: no file is opened); ``most_bytes``; ``task_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        get = self.options.get
        several = lambda key: json.loads(get(key, "null"))
        content, most, task = get("content", "true").lower() == "true", int(get("most_bytes", str(2**31 - 2))), int(get("task_bytes", str(TASK_BYTES)))
        return FolderReader(get("path"), several("patterns") or ["*"], several("excludes") or [], most, content, task, several("only"))


def read(spark: SparkSession, folder: str, patterns: list[str], excludes: list[str], most_bytes: int, content: bool = True, task_bytes: int = TASK_BYTES, paths: list[str] | None = None) -> DataFrame:
    """The files of a folder and those below it, whose names fit a pattern; or those of ``paths``, which the folder was seen to hold."""
    spark.dataSource.register(FolderSource)
    options = {"patterns": json.dumps(patterns), "excludes": json.dumps(excludes), "most_bytes": most_bytes, "content": str(content).lower(), "task_bytes": task_bytes}
    if paths is not None:
        options["only"] = json.dumps(paths)
    return spark.read.format("folder").options(**options).load(folder)
