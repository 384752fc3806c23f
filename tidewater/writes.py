"""Writes on a source's table: each makes a new version of the table from what it changes, or refuses and changes nothing."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.errors import NotAllowed, Refused
from tidewater.sources.base import Verb
from tidewater.staging import staged

#: A row's id within a version of a table: its file and its place in it.
ID = ("_tidewater_file", "_tidewater_row")


def with_ids(rows: DataFrame) -> DataFrame:
    return rows.select("*", F.col("_metadata.file_path").alias(ID[0]), F.col("_metadata.row_index").alias(ID[1]))


class Default:
    """Stands for a column's default in a statement. Sources set defaults themselves, so using it as a value is refused."""


DEFAULT = Default()


@dataclass
class Result:
    """How many rows a write touched, and those rows if they were asked for."""

    count: int | None
    rows: DataFrame | None


@dataclass
class When:
    """An action of a merge: `matched` with action update, delete, nothing or error; or not matched, with insert, nothing or
    error. `condition` and values see the target as t and the source as s."""

    matched: bool
    action: str
    values: dict[str, str] | None = None
    condition: str = "true"


class Writer:
    def __init__(self, engine, at, schema: str, table: str):
        self.engine, self.spark, self.at, self.schema, self.table = engine, engine.spark, at, schema, table
        self.name = f"{at.alias}.{schema}.{table}"

    def allowed(self, verb: Verb, returning: bool, reads_rows: bool = False):
        desc = self.at.allowed(self.schema, self.table, verb)
        if reads_rows and verb is not Verb.INSERT and Verb.SELECT not in desc.verbs:
            raise NotAllowed(f"{self.name} doesn't allow SELECT, and this {verb.value} reads its rows")
        if returning and not desc.returning:
            raise Refused(f"{self.name} can't return rows")
        return desc

    # Files and ids. A row's id is its file and its place there, which hold as long as the file is in the table.

    def source(self):
        if not hasattr(self.at.source, "stage_files"):
            raise Refused(f"{self.at.alias} takes no writes")
        return self.at.source

    def all_rows(self) -> DataFrame:
        return with_ids(self.source().frame(self.spark, self.schema, self.table))

    def target(self, verb: Verb, reads_rows: bool) -> DataFrame:
        """The rows that may be written, with ids."""
        rows = self.all_rows()
        policy = self.at.source.policy(self.schema, self.table, verb, reads_rows)
        seen = policy(rows) if policy else rows
        if not set(ID) <= set(seen.columns):
            raise Refused(f"the row policy of {self.name} hides the rows' ids")
        return seen

    def typed(self, desc, value: Callable[[str], Column]) -> Column:
        """A row of the table as one struct, from a column for each name."""
        return F.struct(*[value(f.name).cast(f.dataType).alias(f.name) for f in desc.schema.fields])

    def hooked(self, verb: Verb, desc, rows: DataFrame | None) -> DataFrame | None:
        """The rows that the source lets through."""
        given = self.at.source.writing(verb, self.table, rows)
        if rows is not None and (given is None or given.columns != rows.columns):
            raise Refused(f"{self.name}: the source's hook doesn't give the table's columns")
        return given

    def apply(self, verb: Verb, desc, ids: DataFrame | None, new: DataFrame | None, keys_change: bool) -> None:
        """Put written tables in effect: rows of these ids go, new ones come. Only files that hold such ids are written anew."""
        source = self.source()
        if new is not None and desc.key and keys_change:
            self.check_keys(desc, ids, new)
        gone, kept = [], None
        if ids is not None:
            gone = [r[0] for r in ids.select(source.file_of(F.col(ID[0]))).distinct().collect()]  # names of touched files
            if gone:
                kept = with_ids(source.read(self.schema, self.table, gone)).join(ids.select(*ID), list(ID), "left_anti").drop(*ID)
        new = self.hooked(verb, desc, new)
        rows = new if kept is None else kept if new is None else kept.unionByName(new)
        files = source.write(self.schema, self.table, rows) if rows is not None else []
        self.stage(gone, files)

    def stage(self, gone: list[str], files: list[str]) -> None:
        self.source().stage_files(self.schema, self.table, gone, files)
        self.at.refresh(self.schema)
        self.engine.ended(self.at)

    def check_keys(self, desc, ids: DataFrame | None, new: DataFrame) -> None:
        """Refuse new rows whose key is null, there twice, or that of a row that stays."""
        keys = new.select(*[F.col(f"`{k}`") for k in desc.key])
        if not keys.where(" OR ".join(f"`{k}` IS NULL" for k in desc.key)).isEmpty():
            raise Refused(f"{self.name}: a key would be null")
        there = self.all_rows().select(*[F.col(f"`{k}`") for k in desc.key], *ID)
        if ids is not None:
            there = there.join(ids.select(*ID), list(ID), "left_anti")
        twice = keys.groupBy(*desc.key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        if not twice.isEmpty() or not there.join(keys, list(desc.key), "left_semi").isEmpty():
            raise Refused(f"{self.name}: a key would be there twice")

    def returned(self, rows: DataFrame, returning: bool) -> Result:
        return Result(rows.count(), rows if returning else None)

    # Statements

    def insert(self, rows: DataFrame, columns: list[str] | None = None, returning: bool = False, on_conflict: str | None = None, conflict: dict[str, str] | None = None) -> Result:
        """Columns that aren't named get the source's defaults. on_conflict: nothing or update, by the table's key; rows have
        to name every column then. `conflict` says what an update sets (all columns if None), with the new row as s.

        The rows are written once, into a folder of their own, and checked there; no other file is read but for keys."""
        desc = self.allowed(Verb.INSERT, returning)
        known = [f.name for f in desc.schema.fields]
        columns = [next((k for k in known if k.lower() == c.lower()), c) for c in columns or rows.columns]
        if unknown := [c for c in columns if c not in known]:
            raise Refused(f"{self.name} has no columns {unknown}")
        if len(columns) != len(rows.columns) or len(set(columns)) < len(columns):
            raise Refused(f"{len(rows.columns)} values for the columns {columns}")
        named = rows.toDF(*columns)
        if on_conflict:
            if set(columns) != set(known):
                raise Refused("ON CONFLICT has to name every column")
            if not desc.key:
                raise Refused(f"{self.name} has no key to conflict on")
            values = conflict or {c: f"s.`{c}`" for c in known}
            actions = [When(True, "update", values) if on_conflict == "update" else When(True, "nothing"), When(False, "insert", {c: f"s.`{c}`" for c in known})]
            done = self.merge(named, " AND ".join(f"t.`{k}` = s.`{k}`" for k in desc.key), actions, returning)
            return Result(done.count, done.rows.drop("merge_action") if returning else None)
        full = named.select(self.typed(desc, lambda c: F.col(f"`{c}`") if c in columns else F.lit(desc.defaults.get(c))).alias("_new")).select("_new.*")
        source = self.source()
        files = source.write(self.schema, self.table, self.hooked(Verb.INSERT, desc, full))
        written = source.read(self.schema, self.table, files)
        try:
            if desc.key:
                self.check_keys(desc, None, written)
        except Refused:
            source.drop_files(self.schema, self.table, files)
            raise
        result = self.returned(staged(written) if returning else written, returning)
        self.stage([], files)
        return result

    def insert_defaults(self, returning: bool = False) -> Result:
        """INSERT DEFAULT VALUES."""
        desc = self.allowed(Verb.INSERT, returning)
        row = self.spark.range(1).select(*[F.lit(desc.defaults.get(f.name)).cast(f.dataType).alias(f.name) for f in desc.schema.fields])
        return self.insert(row, returning=returning)

    def narrowed(self, values: dict[str, object]) -> dict[str, str]:
        """Without columns that are set to themselves, unless that is all there is."""
        if any(v is DEFAULT or isinstance(v, Default) for v in values.values()):
            raise Refused("DEFAULT as a value")
        real = {c: v for c, v in values.items() if re.sub(r"[`\s]", "", v).lower() not in (c.lower(), f"t.{c.lower()}", f"{self.table}.{c}".lower())}
        return real or dict(list(values.items())[:1])

    def known(self, desc, values: dict[str, str]) -> dict[str, str]:
        names = {f.name.lower(): f.name for f in desc.schema.fields}
        if unknown := [c for c in values if c.lower() not in names]:
            raise Refused(f"{self.name} has no columns {unknown}")
        return {names[c.lower()]: v for c, v in values.items()}

    def once(self, ids: DataFrame) -> None:
        if not ids.groupBy(*ID).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty():
            raise Refused(f"a row of {self.name} is matched twice")

    def update(self, values: dict[str, str], where: str = "true", using: DataFrame | None = None, on: str = "true", returning: bool = False) -> Result:
        """values and where see the target as t, and `using` (UPDATE ... FROM, joined by `on`) as s. What changes is computed
        once, into a table; then the files that hold it are written anew."""
        reads = returning or using is not None or where != "true" or any(re.search(r"[A-Za-z_`]", re.sub(r"'[^']*'", "", v)) for v in values.values() if isinstance(v, str))
        desc = self.allowed(Verb.UPDATE, returning, reads)
        values = self.known(desc, self.narrowed(values))
        t, condition = self.target(Verb.UPDATE, reads).alias("t"), F.expr(f"({on}) AND ({where})")
        hit = t.where(condition) if using is None else t.join(using.alias("s"), condition)
        new = self.typed(desc, lambda c: F.expr(values[c]) if c in values else F.col(f"t.`{c}`"))
        return self.changed(desc, hit.select(*[F.col(f"t.{i}") for i in ID], new.alias("_new")), values, returning)

    def changed(self, desc, changes: DataFrame, values: dict[str, str], returning: bool) -> Result:
        """An update, from ids and the rows that come in their place (`_new`)."""
        changes = staged(changes)
        self.once(changes)
        rows = changes.select("_new.*")
        result = self.returned(rows, returning)
        self.apply(Verb.UPDATE, desc, changes, rows, bool({*desc.key} & {*values}))
        return result

    def delete(self, where: str = "true", using: DataFrame | None = None, on: str = "true", returning: bool = False) -> Result:
        reads = returning or using is not None or where != "true"
        desc = self.allowed(Verb.DELETE, returning, reads)
        t, condition = self.target(Verb.DELETE, reads).alias("t"), F.expr(f"({on}) AND ({where})")
        gone = t.where(condition) if using is None else t.join(using.alias("s"), condition, "left_semi")
        return self.removed(desc, gone.select(*ID, *([F.struct(*[F.col(f"t.`{f.name}`") for f in desc.schema.fields]).alias("_old")] if returning else [])), returning)

    def removed(self, desc, gone: DataFrame, returning: bool) -> Result:
        """A deletion, from ids and, for `returning`, the rows (`_old`)."""
        gone = staged(gone)
        result = self.returned(gone.select("_old.*") if returning else gone, returning)
        self.apply(Verb.DELETE, desc, gone, None, False)
        return result

    def merge(self, source: DataFrame, on: str, actions: list[When], returning: bool = False, t: str = "t", s: str = "s") -> Result:
        """Actions are tried in order; the first whose condition holds is done. Returned rows have merge_action. t and s are the
        names by which the target and the source go. Source and target are joined once, into a table of what is to be done."""
        verbs = {"update": Verb.UPDATE, "delete": Verb.DELETE, "insert": Verb.INSERT}
        for a in actions:
            if a.action not in ("update", "delete", "insert", "nothing", "error") or a.matched and a.action == "insert" or not a.matched and a.action in ("update", "delete"):
                raise Refused(f"a merge can't {a.action} rows that are {'' if a.matched else 'not '}matched")
        desc = self.allowed(Verb.UPDATE if any(a.action == "update" for a in actions) else Verb.INSERT, returning)
        for a in actions:
            if a.action in verbs:
                self.at.allowed(self.schema, self.table, verbs[a.action])
        if self.at.source.policy(self.schema, self.table, Verb.UPDATE, True) is not None:
            raise Refused(f"MERGE into {self.name}, which has a row policy")
        joined = source.alias(s).join(self.all_rows().alias(t), F.expr(on), "left")
        hit = F.col(f"`{t}`.{ID[1]}").isNotNull()
        chosen = F.lit(None).cast("int")
        for k, a in reversed(list(enumerate(actions))):
            chosen = F.when((hit if a.matched else ~hit) & F.coalesce(F.expr(a.condition), F.lit(False)), F.lit(k)).otherwise(chosen)
        set_by = {k: self.known(desc, self.narrowed(a.values) if a.action == "update" else a.values) for k, a in enumerate(actions) if a.action in ("update", "insert")}

        def value(name: str) -> Column:
            out = F.col(f"`{t}`.`{name}`")
            for k, a in enumerate(actions):
                if a.action == "insert" or a.action == "update" and name in set_by[k]:
                    out = F.when(F.col("_do") == k, (F.expr(set_by[k][name]) if name in set_by[k] else F.lit(desc.defaults.get(name))).cast(desc.schema[name].dataType)).otherwise(out)
            return out

        plan = joined.withColumn("_do", chosen)
        plan = staged(plan.select(*[F.col(f"`{t}`.{i}") for i in ID], "_do", self.typed(desc, value).alias("_new")))
        self.once(plan.where(f"{ID[1]} IS NOT NULL"))
        of = lambda kind: [k for k, a in enumerate(actions) if a.action == kind]
        if not plan.where(F.col("_do").isin(of("error"))).isEmpty():
            raise Refused("an action of the merge is an error")
        gone = plan.where(F.col("_do").isin(of("update") + of("delete")))
        new = plan.where(F.col("_do").isin(of("update") + of("insert")))
        kind = F.when(F.col("_do").isin(of("delete")), "DELETE").when(F.col("_do").isin(of("update")), "UPDATE").otherwise("INSERT")
        result = self.returned(plan.where(F.col("_do").isin(of("update") + of("delete") + of("insert"))).select("_new.*", kind.alias("merge_action")), returning)
        keys_change = bool(of("insert")) or any({*desc.key} & {*set_by[k]} for k in of("update"))
        self.apply(Verb.UPDATE if of("update") else Verb.INSERT, desc, gone, new.select("_new.*"), keys_change)
        return result
