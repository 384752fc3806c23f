"""The interface of a source. What a source leaves out is refused."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Verb(Enum):
    SELECT = "SELECT"
    INSERT = "INSERT"
    UPDATE = "UPDATE"
    DELETE = "DELETE"
    CREATE = "CREATE"
    ALTER = "ALTER"
    DROP = "DROP"


ALL_VERBS = frozenset(Verb)


@dataclass(frozen=True)
class Verdict:
    ok: bool
    reason: str = ""

    def __bool__(self) -> bool:
        return self.ok


YES, NO = Verdict(True), Verdict(False, "the source doesn't say that it can")


@dataclass
class TableDesc:
    """A table's columns in the source's order, what may be done with it, and what the source enforces."""

    name: str
    schema: T.StructType
    verbs: frozenset[Verb] = frozenset({Verb.SELECT})
    returning: bool = False
    key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    defaults: dict[str, object] = field(default_factory=dict)
    row_ids: bool = False
    comment: str = ""

    @property
    def not_null(self) -> tuple[str, ...]:
        return tuple(f.name for f in self.schema.fields if not f.nullable)


class Source:
    """tables, describe and frame are required. Sources with an equal `group` serve one store, so their tables may be
    joined there; they have to answer the accepts calls alike."""

    def tables(self, schema: str) -> list[str]:
        raise NotImplementedError

    def describe(self, schema: str, table: str) -> TableDesc:
        raise NotImplementedError

    def frame(self, spark: SparkSession, schema: str, table: str) -> DataFrame:
        raise NotImplementedError

    def schemas(self) -> list[str]:
        return ["main"]

    def schema_verbs(self, schema: str) -> frozenset[Verb]:
        return frozenset()

    def accepts_call(self, name: str) -> Verdict:
        """A function, operator, aggregate or window function. Casts, comparisons and BETWEEN aren't asked about."""
        return NO

    def accepts_type(self, kind: str) -> Verdict:
        """The type of a computed expression. A bare column isn't asked about."""
        return NO

    def accepts_operator(self, name: str) -> Verdict:
        return YES

    def accepts_seam(self, kinds: list[str]) -> Verdict:
        """Rows of these types, sent to the source to be joined there."""
        return NO

    def policy(self, schema: str, table: str, verb: Verb, reads_rows: bool) -> Callable[[DataFrame], DataFrame] | None:
        """What stands for the table's rows: its columns, in order, of the rows that may be seen."""
        return None

    @property
    def group(self) -> object:
        return id(self)

    def planned(self, slice_: object) -> None:
        """Told of each slice."""

    def named(self, alias: str) -> None:
        """Told of each attachment that a statement for this source names; raises to refuse the statement."""

    def writing(self, verb: Verb, table: str, rows: DataFrame | None) -> DataFrame | None:
        """Told of each write before it is done, with the rows to be there anew; gives those that are to be written, or raises
        to refuse the write."""
        return rows

    def defining(self, verb: Verb, name: str) -> None:
        """Told of each CREATE, ALTER and DROP before it is done; raises to refuse it."""

    def detach(self) -> None:
        pass


class Capable(Source):
    """A source that accepts everything but what it lists."""

    def __init__(self, refused_calls: set[str] = frozenset(), refused_types: set[str] = frozenset(), refused_operators: set[str] = frozenset(), seam: bool = True, group: object = None, hidden: dict[str, Callable[[DataFrame], DataFrame]] | None = None, catalogs: Callable[[str], None] | None = None, writes: Callable | None = None, ddl: Callable | None = None):
        self.refused_calls, self.refused_types, self.refused_operators, self.seam = refused_calls, refused_types, refused_operators, seam
        self.own_group, self.hidden, self.slices = group, hidden or {}, []
        self.catalogs, self.writes, self.ddl = catalogs, writes, ddl

    def accepts_call(self, name: str) -> Verdict:
        return Verdict(False, f"the source refuses {name}") if name in self.refused_calls else YES

    def accepts_type(self, kind: str) -> Verdict:
        return Verdict(False, f"the source refuses type {kind}") if kind in self.refused_types else YES

    def accepts_operator(self, name: str) -> Verdict:
        return Verdict(False, f"the source refuses operator {name}") if name in self.refused_operators else YES

    def accepts_seam(self, kinds: list[str]) -> Verdict:
        return YES if self.seam else Verdict(False, "the source takes no rows")

    def policy(self, schema: str, table: str, verb: Verb, reads_rows: bool) -> Callable[[DataFrame], DataFrame] | None:
        return self.hidden.get(table)

    @property
    def group(self) -> object:
        return self.own_group if self.own_group is not None else id(self)

    def planned(self, slice_: object) -> None:
        self.slices.append(slice_)

    def named(self, alias: str) -> None:
        if self.catalogs:
            self.catalogs(alias)

    def writing(self, verb: Verb, table: str, rows: DataFrame | None) -> DataFrame | None:
        return self.writes(verb, table, rows) if self.writes else rows

    def defining(self, verb: Verb, name: str) -> None:
        if self.ddl:
            self.ddl(verb, name)
