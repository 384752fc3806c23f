"""Tables that are DataFrames of the session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.errors import Refused
from tidewater.sources.base import Capable, TableDesc, Verb


class MemorySource(Capable):
    """frames: table -> DataFrame, all in schema main. Only SELECT."""

    def __init__(self, frames: dict[str, DataFrame], verbs: dict[str, frozenset[Verb]] | None = None, **capable):
        super().__init__(**capable)
        self.frames, self.verbs = dict(frames), verbs or {}

    def tables(self, schema: str) -> list[str]:
        return sorted(self.frames) if schema == "main" else []

    def describe(self, schema: str, table: str) -> TableDesc:
        if schema != "main" or table not in self.frames:
            raise Refused(f"no table {schema}.{table}")
        return TableDesc(table, self.frames[table].schema, self.verbs.get(table, frozenset({Verb.SELECT})))

    def frame(self, spark: SparkSession, schema: str, table: str) -> DataFrame:
        return self.frames[table]
