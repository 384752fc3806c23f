"""Sources over folders of Parquet: one read as it lies, one written in versions."""

from __future__ import annotations

import json
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.errors import Conflict, Refused
from tidewater.sources.base import ALL_VERBS, Capable, TableDesc, Verb
from tidewater.staging import shared_dir

scratch = shared_dir


class Files:
    """What Hadoop's file systems do, so that any store that Spark reads will do."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.no_options = spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)  # so it doesn't overwrite

    def at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def names(self, path: str) -> list[str]:
        fs, p = self.at(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def exists(self, path: str) -> bool:
        fs, p = self.at(path)
        return fs.exists(p)

    def delete(self, path: str) -> None:
        fs, p = self.at(path)
        fs.delete(p, True)

    def read(self, path: str) -> str:
        fs, p = self.at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put_if_absent(self, path: str, text: str) -> bool:
        """Write a small file beside its place and move it there, unless there is one already."""
        fs, new = self.at(f"{path}.{uuid.uuid4().hex}")
        stream = fs.create(new)
        stream.write(bytearray(text.encode()))
        stream.close()
        _, p = self.at(path)
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.conf).rename(new, p, self.no_options)
            return True
        except Exception as e:
            fs.delete(new, False)
            if "FileAlreadyExistsException" not in str(e):
                raise
            return False


class ParquetDirSource(Capable):
    """Each `<name>.parquet` under a folder, a file or a folder, is a table of schema main. Only SELECT."""

    def __init__(self, spark: SparkSession, path: str, **capable):
        super().__init__(**capable)
        self.spark, self.path = spark, path.rstrip("/")

    def tables(self, schema: str) -> list[str]:
        return [n.removesuffix(".parquet") for n in Files(self.spark).names(self.path) if n.endswith(".parquet")] if schema == "main" else []

    def describe(self, schema: str, table: str) -> TableDesc:
        return TableDesc(table, self.frame(self.spark, schema, table).schema, row_ids=True)

    def frame(self, spark: SparkSession, schema: str, table: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{table}.parquet")


class VersionedSource(Capable):
    """Tables that can be written. `<root>/<schema>/<table>/` holds folders of Parquet files, and `_table.<n>.json` for each
    version: the files that are in it, and the table's description. The highest n counts.

    An append adds a folder; a change writes anew only the files that hold rows it touches. `commit` publishes by putting
    the next `_table.<n>.json` where none is, and refuses with Conflict if another writer was there first, so no write is
    lost. The last `keep` versions stay readable; the files of older ones are removed.
    """

    def __init__(self, spark: SparkSession, root: str, verbs: dict[str, frozenset[Verb]] | None = None, returning: bool = True, creates: bool = True, keep: int = 3, **capable):
        super().__init__(**capable)
        self.spark, self.root, self.files, self.verbs, self.returning, self.creates, self.keep = spark, root.rstrip("/"), Files(spark), verbs or {}, returning, creates, keep
        self.staged: dict[tuple[str, str], dict] = {}

    def at(self, schema: str, table: str) -> str:
        return f"{self.root}/{schema}/{table}"

    def schemas(self) -> list[str]:
        return self.files.names(self.root) or ["main"]

    def schema_verbs(self, schema: str) -> frozenset[Verb]:
        return frozenset({Verb.CREATE}) if self.creates else frozenset()

    def tables(self, schema: str) -> list[str]:
        names = {*self.files.names(f"{self.root}/{schema}"), *(t for s, t in self.staged if s == schema)}
        return sorted(n for n in names if not (self.current(schema, n) or {"dropped": True})["dropped"])

    def versions(self, schema: str, table: str) -> list[int]:
        names = [n.split(".") for n in self.files.names(self.at(schema, table)) if n.startswith("_table.")]
        return sorted(int(n[1]) for n in names if len(n) == 3 and n[2] == "json")

    def published(self, schema: str, table: str, n: int) -> dict:
        return json.loads(self.files.read(f"{self.at(schema, table)}/_table.{n}.json"))

    def current(self, schema: str, table: str) -> dict | None:
        """The version that this source sees: its own staged one, or the last published one."""
        if (schema, table) in self.staged:
            return self.staged[schema, table]
        there = self.versions(schema, table)
        return self.published(schema, table, there[-1]) if there else None

    def meta(self, schema: str, table: str) -> dict:
        found = self.current(schema, table)
        if found is None or found["dropped"]:
            raise Refused(f"no table {schema}.{table}")
        return found

    def describe(self, schema: str, table: str) -> TableDesc:
        m = self.meta(schema, table)
        return TableDesc(table, T.StructType.fromJson(m["schema"]), self.verbs.get(table, ALL_VERBS - {Verb.CREATE}), self.returning, tuple(m["key"]), defaults=m["defaults"], row_ids=True)

    def frame(self, spark: SparkSession, schema: str, table: str) -> DataFrame:
        return self.read(schema, table, self.meta(schema, table)["files"])

    def read(self, schema: str, table: str, files: list[str]) -> DataFrame:
        """The rows of some files of a table."""
        kind = T.StructType.fromJson(self.meta(schema, table)["schema"])
        paths = [f"{self.at(schema, table)}/{f}" for f in files]
        if not paths:  # a file without rows, so that the files' metadata have columns here, too
            paths = [f"{self.at(schema, table)}/empty-{zlib.crc32(kind.json().encode())}"]
            if not self.files.exists(paths[0]):
                self.spark.createDataFrame([], kind).write.mode("overwrite").parquet(paths[0])
        return self.spark.read.schema(kind).parquet(*paths)

    # Writes, seen by this source alone until `commit`

    def stage(self, schema: str, table: str, rows: DataFrame, key: tuple[str, ...] = (), defaults: dict | None = None) -> None:
        """A table of these rows, in place of any that is there."""
        was = self.current(schema, table)
        self.put(schema, table, was, self.write(schema, table, rows), rows.schema.jsonValue(), list(key), defaults or {})

    def stage_files(self, schema: str, table: str, gone: list[str], files: list[str]) -> None:
        """Without the files `gone` and with `files`, which `write` gave."""
        was = self.meta(schema, table)
        self.put(schema, table, was, [f for f in was["files"] if f not in set(gone)] + files)

    def stage_schema(self, schema: str, table: str, kind: T.StructType) -> None:
        """The same files under other columns: a column that a file lacks is null there."""
        was = self.meta(schema, table)
        self.put(schema, table, was, was["files"], kind.jsonValue())

    def drop_files(self, schema: str, table: str, files: list[str]) -> None:
        """Delete what `write` wrote and no version holds."""
        for folder in {f.split("/")[0] for f in files}:
            self.files.delete(f"{self.at(schema, table)}/{folder}")

    def stage_drop(self, schema: str, table: str) -> None:
        was = self.meta(schema, table)
        self.put(schema, table, was, [], dropped=True)

    def put(self, schema: str, table: str, was: dict | None, files: list[str], kind: dict | None = None, key: list[str] | None = None, defaults: dict | None = None, dropped: bool = False) -> None:
        base = was["base"] if was and "base" in was else was["n"] if was else 0
        old = was or {"schema": None, "key": [], "defaults": {}}
        self.staged[schema, table] = {
            "n": base + 1, "base": base, "files": files, "dropped": dropped, "schema": kind if kind is not None else old["schema"],
            "key": key if key is not None else old["key"], "defaults": defaults if defaults is not None else old["defaults"],
        }

    def write(self, schema: str, table: str, rows: DataFrame) -> list[str]:
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{self.at(schema, table)}/{folder}")
        return [f"{folder}/{n}" for n in self.files.names(f"{self.at(schema, table)}/{folder}") if n.endswith(".parquet")]

    def file_of(self, path: Column) -> Column:
        """A file's name in a version, from its whole path."""
        return F.substring_index(path, "/", -2)

    def commit(self) -> None:
        """Publish. If a table has moved on since its version was read, nothing is published and Conflict is raised; between two
        tables of one commit another writer may still come first, which is reported in the same way."""
        staged, self.staged = self.staged, {}
        for (schema, table), m in staged.items():
            there = self.versions(schema, table)
            if (there[-1] if there else 0) != m["base"]:
                self.discard(staged)
                raise Conflict(f"{schema}.{table} was changed by another writer")
        while staged:
            (schema, table), m = next(iter(staged.items()))
            if not self.files.put_if_absent(f"{self.at(schema, table)}/_table.{m['n']}.json", json.dumps({k: v for k, v in m.items() if k != "base"})):
                self.discard(staged)
                raise Conflict(f"{schema}.{table} was changed by another writer")
            del staged[schema, table]
            self.vacuum(schema, table)

    def vacuum(self, schema: str, table: str) -> None:
        """Remove the files that only versions before the last `keep` hold."""
        there = self.versions(schema, table)
        old, kept = there[: -self.keep], there[-self.keep :]
        if old:
            used = {f.split("/")[0] for n in kept for f in self.published(schema, table, n)["files"]}
            for n in old:
                for folder in {f.split("/")[0] for f in self.published(schema, table, n)["files"]} - used:
                    self.files.delete(f"{self.at(schema, table)}/{folder}")
                self.files.delete(f"{self.at(schema, table)}/_table.{n}.json")

    def rollback(self) -> None:
        staged, self.staged = self.staged, {}
        self.discard(staged)

    def discard(self, staged: dict[tuple[str, str], dict]) -> None:
        """Delete what was written for versions that will not be."""
        for (schema, table), m in staged.items():
            there = self.versions(schema, table)
            used = {f.split("/")[0] for n in there for f in self.published(schema, table, n)["files"]}
            for folder in {f.split("/")[0] for f in m["files"]} - used:
                self.files.delete(f"{self.at(schema, table)}/{folder}")
