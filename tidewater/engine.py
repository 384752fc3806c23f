"""The engine: sources under names, queries that are placed on them, writes, and transactions."""

from __future__ import annotations

import itertools
import threading
import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.errors import Refused
from tidewater.plans import dialect, explain, names
from tidewater.plans.catalog import Attachment
from tidewater.plans.placement import Node, Placer, Slice, analysed
from tidewater.plans.statements import Statements, is_statement
from tidewater.sources.base import Source, TableDesc, Verb
from tidewater.writes import Result, Writer


class Running:
    """An action that is under way. `cancel` ends it from any thread; `result` waits and raises what the action raised."""

    def __init__(self, engine: Engine, group: str, run: Callable[[], object]):
        self.context, self.group, self.value, self.error = engine.spark.sparkContext, group, None, None
        self.begun = threading.Event()

        def act() -> None:
            self.context.setJobGroup(group, group, interruptOnCancel=True)
            self.begun.set()
            try:
                self.value = run()
            except BaseException as e:
                self.error = e

        self.thread = InheritableThread(target=act, daemon=True)
        self.thread.start()

    def cancel(self) -> None:
        """Also ends jobs that the action has yet to begin."""
        self.begun.wait()
        self.context.cancelJobGroupAndFutureJobs(self.group) if hasattr(self.context, "cancelJobGroupAndFutureJobs") else self.context.cancelJobGroup(self.group)

    def result(self, timeout: float | None = None) -> object:
        self.thread.join(timeout)
        if self.thread.is_alive():
            raise TimeoutError(f"{self.group} is still running")
        if self.error is not None:
            raise self.error
        return self.value


class Engine:
    """`attach` sources, then ask `sql` for alias.table or alias.schema.table, like any other table.

    SQL has the meaning that sources give it (see `plans.dialect`), and placement says which part of a query each source
    runs, but never changes the answer. Writes and definitions are SQL, too, or methods. `slices` has what was placed, in order.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.attached, self.slices = spark, {}, []
        self.views: dict[str, tuple[Attachment, str, str]] = {}
        self.bodies: dict[str, str] = {}
        self.open = self.has_functions = False
        self.id = uuid.uuid4().hex[:8]
        self.jobs, self.numbers = itertools.count(), itertools.count()

    # Sources

    def attach(self, alias: str, source: Source) -> Attachment:
        if alias.lower() in self.attached:
            raise Refused(f"{alias} is attached already")
        self.attached[alias.lower()] = Attachment(alias.lower(), source)
        return self.attached[alias.lower()]

    def detach(self, alias: str) -> None:
        found = self.attached.pop(alias.lower(), None)
        if found is None:
            raise Refused(f"{alias} isn't attached")
        self.views = {v: x for v, x in self.views.items() if x[0] is not found}
        found.source.detach()

    def refresh(self, alias: str, schema: str | None = None) -> None:
        self.attached[alias.lower()].refresh(schema)

    def find(self, name: str | list[str]) -> tuple[Attachment, str, str]:
        parts = name.split(".") if isinstance(name, str) else name
        at = self.attached.get(parts[0].lower())
        there = at.find(parts[1:]) if at and 2 <= len(parts) <= 3 else None
        if there is None:
            raise Refused(f"no table {'.'.join(parts)}")
        return at, *there

    def describe(self, name: str) -> TableDesc:
        at, schema, table = self.find(name)
        return at.describe(schema, table)

    def tables(self) -> list[tuple[str, str, str]]:
        return [(a, s, t) for a, at in sorted(self.attached.items()) for s in at.schemas() for t in at.tables(s)]

    # Queries

    def sql(self, text: str) -> DataFrame:
        """The rows of a query; of a write the rows of RETURNING, or one row with the count; of a definition none."""
        return Statements(self).run(text) if is_statement(text) else self.query(text)

    def query(self, text: str) -> DataFrame:
        df, _, placed = self.planned(text)
        for s in placed:
            for source in {id(self.attached[a].source): self.attached[a].source for a in s.attachments}.values():
                for alias in s.attachments:
                    source.named(alias)
        for s in placed:
            self.slices.append(s)
            for alias in s.attachments:
                self.attached[alias].source.planned(s)
        return df

    def functions(self) -> None:
        """Functions of the session that the dialect needs: division as sources know it."""
        if not self.has_functions:
            zero = "CASE WHEN a IS NULL THEN NULL WHEN isnan(a) OR a = 0 THEN double('NaN') ELSE signum(a) * double('Infinity') END"
            self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION tidewater_divide(a DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN CASE WHEN b = 0 THEN {zero} ELSE try_divide(a, b) END")
            self.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tidewater_divide_int(a BIGINT, b BIGINT) RETURNS BIGINT RETURN a DIV b")
            self.has_functions = True

    def temporary(self, what: str) -> str:
        """A name for a view that no other engine of the session has."""
        return f"tidewater_{self.id}_{what}_{next(self.numbers)}"

    def explain(self, text: str) -> str:
        """Where each part runs, what is sent and what comes back, and Spark's plan."""
        df, root, placed = self.planned(text)
        out = explain.lines(root)
        for s in placed:
            out.append(f"Runs on source {', '.join(s.attachments)}: {', '.join(s.operators) or 'scan'} over {', '.join(s.tables)}")
            out += [f"Sends rows: {', '.join(s.sends)} ({explain.estimate(s)})"] * bool(s.sends)
            out.append(f"Returns rows: {', '.join(s.returns)}")
        return "\n".join([*out, "", df._jdf.queryExecution().toString()])

    def planned(self, text: str) -> tuple[DataFrame, Node, list[Slice]]:
        row_id = any(t.lower() == "rowid" for t in names.tokens(text))
        df = dialect.Dialect(self, lambda part: names.rewrite(part, lambda parts: self.resolve(parts, row_id))).frame(text)
        root, placed = Placer(lambda view: self.views.get(view.lower())).place(analysed(df))
        for n in root.walk():
            if n.kind == "UnionLoop" and n.reads_source():
                raise Refused("the recursive part of WITH RECURSIVE can't read a source's table")
        return df, root, placed

    def resolve(self, parts: list[str], row_id: bool = False) -> str | None:
        """The view of a table, registered as it is now, with a column rowid if asked for; None if the name is no attached table's."""
        at = self.attached.get(parts[0].lower())
        if at is None or len(parts) > 3:
            return None
        body = self.bodies.get(".".join(parts).lower())
        if body:
            view = f"tidewater_{self.id}_" + "__".join(parts).lower() + "__view"
            dialect.Dialect(self, lambda part: names.rewrite(part, self.resolve)).frame(body).createOrReplaceTempView(view)
            return view
        there = at.find(parts[1:])
        if there is None:
            raise Refused(f"no table {'.'.join(parts)}")
        at.allowed(*there, Verb.SELECT)
        view = f"tidewater_{self.id}_{at.view(*there)}" + "_rowid" * row_id
        at.rows(self.spark, *there, row_id=row_id).createOrReplaceTempView(view)
        self.views[view] = (at, *there)
        return view

    def table(self, name: str) -> DataFrame:
        return self.sql(f"SELECT * FROM {name}")

    def start(self, run: Callable[[], object]) -> Running:
        """Begin an action, such as a collect, in a thread and a job group of its own."""
        return Running(self, f"tidewater-{self.id}-{next(self.jobs)}", run)

    # Views

    def exists(self, name: str) -> bool:
        parts = name.split(".")
        at = self.attached.get(parts[0].lower())
        return bool(at and 2 <= len(parts) <= 3 and at.find(parts[1:]))

    def drop_view(self, name: str, missing_ok: bool = False) -> None:
        if self.bodies.pop(name.lower(), None) is None and not missing_ok:
            raise Refused(f"no view {name}")

    def create_view(self, name: str, body: str) -> None:
        """A view that lives with its source: its body has to run there whole."""
        alias = name.split(".")[0].lower()
        if alias not in self.attached:
            raise Refused(f"{alias} isn't attached")
        self.attached[alias].source.defining(Verb.CREATE, name)
        _, root, placed = self.planned(body)
        source = self.attached[alias].source
        if len(placed) != 1 or placed[0].root is not root or root.label != source.group or placed[0].sends:
            raise Refused(f"the body of {name} doesn't run on {alias} whole")
        self.bodies[name.lower()] = body

    # Writes

    def writer(self, name: str) -> Writer:
        return Writer(self, *self.find(name))

    def insert(self, name: str, rows: DataFrame, **how) -> Result:
        return self.writer(name).insert(rows, **how)

    def insert_defaults(self, name: str, **how) -> Result:
        return self.writer(name).insert_defaults(**how)

    def update(self, name: str, values: dict[str, str], **how) -> Result:
        return self.writer(name).update(values, **how)

    def delete(self, name: str, **how) -> Result:
        return self.writer(name).delete(**how)

    def merge(self, name: str, source: DataFrame, on: str, actions: list, **how) -> Result:
        return self.writer(name).merge(source, on, actions, **how)

    def create_table_as(self, name: str, rows: DataFrame, key: tuple[str, ...] = (), defaults: dict | None = None) -> Result:
        parts = name.split(".")
        at = self.attached.get(parts[0].lower())
        schema, table = parts[1] if len(parts) == 3 else "main", parts[-1]
        if at is None or not hasattr(at.source, "stage") or Verb.CREATE not in at.source.schema_verbs(schema):
            raise Refused(f"{parts[0]} doesn't allow CREATE")
        if at.find([schema, table]):
            raise Refused(f"{name} is there already")
        at.source.defining(Verb.CREATE, f"{schema}.{table}")
        at.source.stage(schema, table, rows, tuple(key), defaults)
        n = at.source.frame(self.spark, schema, table).count()
        at.refresh(schema)
        self.ended(at)
        return Result(n, None)

    def drop_table(self, name: str) -> None:
        at, schema, table = self.find(name)
        at.allowed(schema, table, Verb.DROP)
        at.source.defining(Verb.DROP, f"{schema}.{table}")
        at.source.stage_drop(schema, table)
        at.refresh(schema)
        self.ended(at)

    def altered(self, name: str, column: str, there: bool) -> tuple[Attachment, str, str, TableDesc]:
        at, schema, table = self.find(name)
        desc = at.allowed(schema, table, Verb.ALTER)
        if (column.lower() in {f.name.lower() for f in desc.schema.fields}) != there:
            raise Refused(f"{name} has {'no' if there else 'a'} column {column}")
        at.source.defining(Verb.ALTER, f"{schema}.{table}")
        return at, schema, table, desc

    def add_column(self, name: str, column: str, kind: str) -> None:
        """Files stay as they are; the column is null in their rows."""
        at, schema, table, desc = self.altered(name, column, False)
        (field,) = self.spark.sql(f"SELECT CAST(NULL AS {kind}) AS `{column}`").schema.fields
        at.source.stage_schema(schema, table, T.StructType([*desc.schema.fields, field]))
        at.refresh(schema)
        self.ended(at)

    def drop_column(self, name: str, column: str) -> None:
        """The table is written anew, so that no later column of that name finds the old values."""
        at, schema, table, desc = self.altered(name, column, True)
        if column.lower() in {k.lower() for k in desc.key}:
            raise Refused(f"{column} is in the key of {name}")
        self.replaced(at, schema, table, desc, {f.name: f.name for f in desc.schema.fields if f.name.lower() != column.lower()})

    def rename_column(self, name: str, column: str, to: str) -> None:
        at, schema, table, desc = self.altered(name, column, True)
        if to.lower() in {f.name.lower() for f in desc.schema.fields}:
            raise Refused(f"{name} has a column {to}")
        self.replaced(at, schema, table, desc, {f.name: to if f.name.lower() == column.lower() else f.name for f in desc.schema.fields})

    def replaced(self, at: Attachment, schema: str, table: str, desc: TableDesc, columns: dict[str, str]) -> None:
        rows = at.source.frame(self.spark, schema, table).select(*[F.col(f"`{c}`").alias(n) for c, n in columns.items()])
        at.source.stage(schema, table, rows, tuple(columns[k] for k in desc.key), {columns[c]: v for c, v in desc.defaults.items() if c in columns})
        at.refresh(schema)
        self.ended(at)

    def run(self, statement: str) -> DataFrame:
        return self.sql(statement)

    # Transactions

    def begin(self) -> None:
        if self.open:
            raise Refused("a transaction is open already")
        self.open = True

    def ended(self, at: Attachment) -> None:
        """Outside a transaction a write is there at once."""
        if not self.open:
            try:
                at.source.commit()
            finally:
                at.refresh()

    def commit(self) -> None:
        """Publish each source's writes, one source after the other: this is not atomic across sources."""
        self.open = False
        for at in self.attached.values():
            if hasattr(at.source, "commit"):
                at.refresh()
                at.source.commit()

    def rollback(self) -> None:
        self.open = False
        for at in self.attached.values():
            if hasattr(at.source, "rollback"):
                at.source.rollback()
                at.refresh()
