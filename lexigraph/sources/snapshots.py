"""Numbered versions of a set of tables in a folder: all of a commit is visible, or nothing.

Data go to new folders first. The manifest of a version, one file that names them, is written last; Spark's committer moves it into place when its only task is done. Readers take the highest version there is and stay with the
folders that it names, so what a later commit writes doesn't reach them. A commit that stops half-way leaves folders that no manifest names. Versions are numbered without gaps. One driver at a time is meant
to commit; a commit that starts from a version that is no longer the last one fails, and of two that overlap the one that readers don't see fails, and may be repeated.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import files

MANIFEST = "version long, batch string, token string, state string"


class Conflict(RuntimeError):
    """Another commit took the version."""


@dataclass
class Manifests:
    """The versions of a folder; a version's state is a JSON object."""

    spark: SparkSession
    folder: str

    def rows(self) -> DataFrame:
        """One row for each version; of overlapping commits the one with the least token."""
        try:
            every = self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifests/*")
        except AnalysisException:  # no version yet
            return self.spark.createDataFrame([], MANIFEST)
        return every.groupBy("version").agg(F.min_by(F.struct("batch", "token", "state"), "token").alias("m")).select("version", "m.*")

    def latest(self) -> tuple[int, dict]:
        row = self.rows().orderBy(F.desc("version")).first()
        return (row["version"], json.loads(row["state"])) if row else (0, {})

    def _of(self, version: int):
        return self.rows().filter(F.col("version") == version).first()

    def state(self, version: int) -> dict:
        if (row := self._of(version)) is None:
            raise KeyError(f"no version {version}")
        return json.loads(row["state"])

    def of_batch(self, batch: str) -> int | None:
        row = self.rows().filter(F.col("batch") == batch).first()
        return row["version"] if row else None

    def commit(self, base: int, state: dict, batch: str | None = None) -> int:
        """Make ``state`` version ``base + 1``."""
        version, token = base + 1, uuid.uuid4().hex
        if self._of(version) is not None:
            raise Conflict(f"version {version} exists")
        self.spark.createDataFrame([(version, batch, token, json.dumps(state))], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifests/{version:012d}")
        if self._of(version)["token"] != token:
            raise Conflict(f"version {version} was taken meanwhile")
        return version


@dataclass
class SnapshotStore:
    """Tables by name, in versions. A table is a list of parts, and of keys that are gone from the parts before a number: a change writes what it brings, and nothing else."""

    spark: SparkSession
    folder: str

    @property
    def manifests(self) -> Manifests:
        return Manifests(self.spark, self.folder)

    def latest(self) -> int:
        """The number of the last version; 0 where there is none."""
        return self.manifests.latest()[0]

    def _begin(self, batch: str | None, base: int | None) -> tuple[int | None, int, dict]:
        if batch is not None and (done := self.manifests.of_batch(batch)) is not None:
            return done, 0, {}
        version, state = self.manifests.latest()
        if base is not None and base != version:
            raise Conflict(f"made from version {base}, but the last one is {version}")
        return None, version, state

    def _written(self, name: str, df: DataFrame, partition: str | None = None) -> str:
        path = f"{self.folder}/data/{name}-{uuid.uuid4().hex}"
        files.write_table(df, path, partition)
        return path

    def commit(self, tables: dict[str, DataFrame], batch: str | None = None, partition: dict[str, str] | None = None, base: int | None = None) -> int:
        """A new version in which these tables have these rows and no others; tables that aren't given stay as they are. A batch that is committed already is not committed again. Returns the version.

        ``base`` is the version that the tables were made from, the last one by default.
        """
        done, version, state = self._begin(batch, base)
        if done is not None:
            return done
        for name, df in tables.items():
            state[name] = {"schema": df.schema.jsonValue(), "parts": [{"number": version + 1, "path": self._written(name, df, (partition or {}).get(name))}], "gone": []}
        return self.manifests.commit(version, state, batch)

    def change(self, put: dict[str, DataFrame], gone: dict[str, DataFrame], batch: str | None = None, base: int | None = None) -> int:
        """A new version: rows whose keys are in ``gone`` (one column, named as the table's) leave, then those of ``put`` come. Work and files grow with the change, not with the tables."""
        done, version, state = self._begin(batch, base)
        if done is not None:
            return done
        for name, keys in gone.items():
            if name in state:
                entry = {"key": keys.columns[0], "kind": keys.schema[0].dataType.simpleString(), "before": version + 1, "path": self._written(f"{name}-gone", keys.distinct())}
                state[name] = state[name] | {"gone": [*state[name]["gone"], entry]}
        for name, df in put.items():
            mine = state.get(name, {"schema": df.schema.jsonValue(), "parts": [], "gone": []})
            columns = StructType.fromJson(mine["schema"]).names
            state[name] = mine | {"parts": [*mine["parts"], {"number": version + 1, "path": self._written(name, df.select(*columns))}]}
        return self.manifests.commit(version, state, batch)

    def _table(self, entry: dict) -> DataFrame:
        schema = StructType.fromJson(entry["schema"])
        out = None
        for part in entry["parts"]:
            df = self.spark.read.schema(schema).parquet(part["path"]).select(*(f"`{c}`" for c in schema.names))
            for g in entry["gone"]:
                if g["before"] > part["number"]:
                    df = df.join(self.spark.read.schema(f"`{g['key']}` {g['kind']}").parquet(g["path"]), g["key"], "left_anti")
            df = df.select(*(f"`{c}`" for c in schema.names))
            out = df if out is None else out.unionByName(df)
        return self.spark.createDataFrame([], schema) if out is None else out

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table of a version, the last one by default; the DataFrame stays with that version."""
        return self._table((self.manifests.latest()[1] if version is None else self.manifests.state(version))[name])

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        """All tables of one version."""
        state = self.manifests.latest()[1] if version is None else self.manifests.state(version)
        return {name: self._table(t) for name, t in state.items()}

    def compact(self, partition: dict[str, str] | None = None) -> int:
        """A new version with the same rows, each table in one part. Reads get slower with every change until then."""
        version = self.latest()
        return self.commit(self.tables(version), partition=partition, base=version)

    def diff(self, name: str, old: int, new: int, key: str) -> DataFrame:
        """``key, change`` between two versions of a table: added, updated or removed rows; keys are unique."""
        before, after = self.read(name, old), self.read(name, new)
        marked = lambda df, mark: df.select(F.col(key), F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias(mark))
        both = marked(before, "_old").join(marked(after, "_new"), key, "full_outer")
        change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "updated")
        return both.select(key, change.alias("change")).filter("change is not null")

    def clean(self, keep: int = 2) -> int:
        """Empty the folders that none of the last ``keep`` versions names; returns how many. Readers of older versions, and they alone, lose rows."""
        states = [json.loads(r["state"]) for r in self.manifests.rows().orderBy("version").collect()]
        named = lambda some: {x["path"] for state in some for t in state.values() for x in (*t["parts"], *t["gone"])}
        gone = named(states[:-keep]) - named(states[-keep:])
        for path in gone:
            self.spark.range(0).write.mode("overwrite").parquet(path)
        return len(gone)
