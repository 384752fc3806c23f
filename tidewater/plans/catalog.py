"""Attached sources, their descriptions, and the views that stand for their tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.errors import NotAllowed, Refused, StaleSchema
from tidewater.sources.base import Source, TableDesc, Verb


def barrier(df: DataFrame) -> DataFrame:
    """df, into which Spark moves no predicate: it takes all rows as a sample, and filters don't pass a sample. So what a
    query asks for never runs on a row that a policy hides. No copy is made and columns are still pruned."""
    return df.sample(withReplacement=False, fraction=1.0, seed=0)


@dataclass
class Attachment:
    """A source under a name. Descriptions are asked for on first use and kept until `refresh`."""

    alias: str
    source: Source
    known: dict[tuple[str, str], TableDesc] = field(default_factory=dict)
    listed: dict[str, list[str]] = field(default_factory=dict)

    def schemas(self) -> list[str]:
        return self.source.schemas()

    def tables(self, schema: str) -> list[str]:
        if schema not in self.listed:
            self.listed[schema] = self.source.tables(schema)
        return self.listed[schema]

    def find(self, names: list[str]) -> tuple[str, str] | None:
        """(schema, table) of [table] or [schema, table], without regard to case."""
        low = [n.lower() for n in names]
        schema = next((s for s in self.schemas() if s.lower() == (low[0] if len(low) == 2 else "main")), None)
        table = next((t for t in self.tables(schema) if t.lower() == low[-1]), None) if schema else None
        return (schema, table) if table else None

    def describe(self, schema: str, table: str) -> TableDesc:
        if (schema, table) not in self.known:
            self.known[schema, table] = self.source.describe(schema, table)
        return self.known[schema, table]

    def refresh(self, schema: str | None = None) -> None:
        self.known = {} if schema is None else {k: v for k, v in self.known.items() if k[0] != schema}
        self.listed = {} if schema is None else {k: v for k, v in self.listed.items() if k != schema}

    def allowed(self, schema: str, table: str, verb: Verb) -> TableDesc:
        desc = self.describe(schema, table)
        if verb not in desc.verbs:
            raise NotAllowed(f"{self.alias}.{schema}.{table} doesn't allow {verb.value}")
        return desc

    def rows(self, spark: SparkSession, schema: str, table: str, verb: Verb = Verb.SELECT, reads_rows: bool = True, row_id: bool = False) -> DataFrame:
        """The table's rows that may be seen, after a check that it still has the columns that it was described with; with
        `rowid`, the name of a row's file and its place there, if asked for."""
        desc = self.describe(schema, table)
        df = self.source.frame(spark, schema, table)
        was, now = ([(f.name, f.dataType) for f in s.fields] for s in (desc.schema, df.schema))
        if was != now:
            raise StaleSchema(f"{self.alias}.{schema}.{table} was described as {was} and now is {now}; refresh {self.alias}")
        if row_id:
            if not desc.row_ids:
                raise Refused(f"{self.alias}.{schema}.{table} has no rowid")
            df = df.select("*", F.concat_ws("#", F.substring_index("_metadata.file_path", "/", -2), "_metadata.row_index").alias("rowid"))
            was = [*was, ("rowid", df.schema["rowid"].dataType)]
        policy = self.source.policy(schema, table, verb, reads_rows)
        if policy is None:
            return df
        seen = policy(df)
        if [(f.name, f.dataType) for f in seen.schema.fields] != was:
            raise Refused(f"the row policy of {self.alias}.{schema}.{table} doesn't give the table's columns" + " and its rowid" * row_id)
        return barrier(seen)

    def view(self, schema: str, table: str) -> str:
        return f"{self.alias}__{schema}__{table}".lower()
