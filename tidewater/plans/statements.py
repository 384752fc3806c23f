"""Writes and definitions in SQL text: read clause by clause, and done by the engine's API."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewater.errors import Refused
from tidewater.plans.names import blank, closing, level, plain, solid, tokens
from tidewater.sources.base import Verb
from tidewater.writes import ID, Result, When, Writer

STATEMENTS = set("insert update delete merge create alter drop truncate begin start commit rollback abort copy export import attach detach vacuum call load install pragma use".split())
#: What no source does.
REFUSED = re.compile(r"(?i)\s*(?:CREATE\s+(?:OR\s+REPLACE\s+)?(?:TEMP(?:ORARY)?\s+)?(INDEX|UNIQUE\s+INDEX|SCHEMA|SEQUENCE|FUNCTION|TYPE|COLLATION|MACRO)|DROP\s+(INDEX|SCHEMA|SEQUENCE|FUNCTION|TYPE|MACRO))\b")


class Text:
    """Tokens of a statement, read from the left."""

    def __init__(self, sql: str):
        self.parts = [t for t in tokens(sql)]
        while self.parts and (blank(self.parts[-1]) or self.parts[-1] == ";"):
            self.parts.pop()
        self.at = 0

    def skip(self) -> None:
        while self.at < len(self.parts) and blank(self.parts[self.at]):
            self.at += 1

    def peek(self, n: int = 1) -> list[str]:
        found: list[str] = []
        for t in self.parts[self.at :]:
            if len(found) == n:
                break
            if not blank(t):
                found.append(t.lower())
        return found

    def take(self, *words: str) -> bool:
        """Whether these words come next; then they are read."""
        if self.peek(len(words)) != [*words]:
            return False
        for _ in words:
            self.skip()
            self.at += 1
        return True

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise Refused(f"{' '.join(words).upper()} is missing at: {''.join(self.parts[self.at :])[:60]}")

    def name(self) -> str:
        """A name of one or several parts."""
        self.skip()
        out = []
        while self.at < len(self.parts):
            out.append(self.parts[self.at])
            self.at += 1
            if not (self.at + 1 < len(self.parts) and self.parts[self.at] == "."):
                break
            self.at += 1
        return ".".join(map(plain, out))

    def within(self) -> list[str]:
        """The tokens in the parentheses that come next."""
        self.skip()
        if self.at == len(self.parts) or self.parts[self.at] != "(":
            raise Refused("a parenthesis is missing")
        end = closing(self.parts, self.at)
        inside = self.parts[self.at + 1 : end]
        self.at = end + 1
        return inside

    def until(self, *words: str) -> str:
        """The text up to one of these words (outside of parentheses and CASE), or to the end."""
        start, cases = self.at, 0
        for i in level(self.parts, self.at):
            word = self.parts[i].lower()
            cases += (word == "case") - (word == "end" and cases > 0)
            if word in words and not cases:
                self.at = i
                break
        else:
            self.at = len(self.parts)
        return "".join(self.parts[start : self.at]).strip()

    def done(self) -> bool:
        self.skip()
        return self.at == len(self.parts)


def split(parts: list[str], by: str = ",") -> list[list[str]]:
    """Tokens between commas that stand in no parentheses."""
    out, last = [], 0
    for i in level(parts):
        if parts[i] == by:
            out.append(parts[last:i])
            last = i + 1
    return [*out, parts[last:]]


def settings(text: str) -> dict[str, str]:
    """`a = x, b = y` as {a: x, b: y}."""
    found = {}
    for one in split(tokens(text)):
        sign = next((i for i in level(one) if one[i] == "="), None)
        if sign is None:
            raise Refused(f"SET {''.join(one)}")
        value = "".join(one[sign + 1 :]).strip()
        if value.lower() == "default":
            raise Refused("DEFAULT as a value")
        name = plain("".join(one[:sign]).strip().rpartition(".")[2])
        found[name] = value
    return found


def is_statement(sql: str) -> bool:
    words = [t.lower() for t in tokens(sql) if not blank(t)]
    return bool(words) and (words[0] in STATEMENTS or words[0] == "with" and writes_within(sql))


def writes_within(sql: str) -> bool:
    """Whether a WITH clause or what follows it writes."""
    parts = tokens(sql)
    words = [(i, parts[i].lower()) for i in solid(parts)]
    pairs = zip(words, words[1:], strict=False)
    return any(a in ("insert", "merge") and b == "into" or a == "delete" and b == "from" for (_, a), (_, b) in pairs) or any(parts[i].lower() == "update" for i in level(parts))


class Statements:
    """Runs statements for an engine. `run` returns the rows of RETURNING, or one row with the count."""

    def __init__(self, engine):
        self.engine, self.spark = engine, engine.spark

    def run(self, sql: str) -> DataFrame:
        text = Text(sql)
        (word,) = text.peek()
        if word == "with":
            raise Refused("a write to a source's table inside a WITH clause, or behind one")
        if found := REFUSED.match(sql):
            raise Refused(f"{(found[1] or found[2]).upper()} isn't for a source")
        do = getattr(self, word if word not in ("start", "abort") else {"start": "begin", "abort": "rollback"}[word], None)
        if do is None:
            raise Refused(f"{word.upper()} isn't for a source")
        text.need(word)
        return do(text)

    # Results

    def counted(self, n: int | None) -> DataFrame:
        return self.spark.createDataFrame([(n or 0,)], "Count bigint")

    def nothing(self) -> DataFrame:
        return self.spark.createDataFrame([], "Success boolean")

    def returned(self, text: Text, alias: str) -> str | None:
        """The list of RETURNING."""
        return text.until() if text.take("returning") else None

    def given(self, result: Result, returning: str | None, alias: str) -> DataFrame:
        if returning is None:
            return self.counted(result.count)
        view = self.engine.temporary("returned")
        result.rows.createOrReplaceTempView(view)
        return self.spark.sql(f"SELECT {returning} FROM {view} AS `{alias}`")

    def end(self, text: Text) -> None:
        if not text.done():
            raise Refused(f"not understood: {''.join(text.parts[text.at :])[:80]}")

    def target(self, text: Text) -> tuple[Writer, str]:
        name = text.name()
        writer, alias = self.engine.writer(name), name.rpartition(".")[2]
        if text.take("as"):
            alias = text.name()
        elif not text.done() and re.match(r"[A-Za-z_`\"]", text.peek()[0]) and text.peek()[0] not in ("set", "using", "where", "returning", "from", "values", "select", "with", "default", "on"):
            alias = text.name()
        return writer, alias

    def query(self, sql: str) -> DataFrame:
        return self.engine.query(sql)

    # INSERT

    def insert(self, text: Text) -> DataFrame:
        text.need("into")
        name = text.name()
        writer, alias = self.engine.writer(name), name.rpartition(".")[2]
        if text.take("as"):
            alias = text.name()
        columns = None
        if text.peek() == ["("] and not Text("".join(text.parts[text.at + 1 :]).lstrip(" (\n\t")).peek()[0] in ("select", "with", "values"):
            columns = [plain("".join(c).strip()) for c in split(text.within())]
        if text.take("default", "values"):
            returning = self.returned(text, alias)
            self.end(text)
            return self.given(writer.insert_defaults(returning is not None), returning, alias)
        if text.peek() == ["values"]:
            for row in [i for i in level(text.parts, text.at) if text.parts[i] == "("]:
                if any("".join(v).strip().lower() == "default" for v in split(text.parts[row + 1 : closing(text.parts, row)])):
                    raise Refused("DEFAULT as a value")
        start = text.at
        body = text.until("returning", "on")
        while not text.done() and text.peek(2) != ["on", "conflict"] and text.peek() == ["on"]:  # the ON of a join
            text.at += 1
            text.until("returning", "on")
            body = "".join(text.parts[start : text.at])
        how: dict = {}
        if text.take("on", "conflict"):
            if text.peek() == ["("]:
                named = [plain("".join(c).strip()).lower() for c in split(text.within())]
                key = [k.lower() for k in self.engine.describe(name).key]
                if sorted(named) != sorted(key):
                    raise Refused(f"ON CONFLICT ({', '.join(named)}) isn't the key of {name}")
            text.need("do")
            if text.take("nothing"):
                how["on_conflict"] = "nothing"
            else:
                text.need("update", "set")
                values = settings(text.until("returning", "where"))
                if text.peek() == ["where"]:
                    raise Refused("ON CONFLICT ... WHERE")
                sub = lambda v: re.sub(r"(?i)\bexcluded\s*\.", "s.", re.sub(rf"(?i)(?<![\w.])`?{re.escape(alias)}`?\s*\.", "t.", v))
                how |= {"on_conflict": "update", "conflict": {k: sub(v) for k, v in values.items()}}
        returning = self.returned(text, alias)
        self.end(text)
        rows = self.query(body)
        if columns is None:
            columns = [f.name for f in self.engine.describe(name).schema.fields]
            if len(rows.columns) != len(columns):
                raise Refused(f"{name} has {len(columns)} columns, but {len(rows.columns)} values were given")
        return self.given(writer.insert(rows.toDF(*[f"_{i}" for i in range(len(rows.columns))]), columns, returning is not None, **how), returning, alias)

    # UPDATE and DELETE: the target is a view with its rows' ids, and Spark joins, filters and computes

    def targeted(self, writer: Writer, alias: str, verb: Verb, reads: bool) -> str:
        view = self.engine.temporary("target")
        writer.target(verb, reads).createOrReplaceTempView(view)
        return f"{view} AS `{alias}`"

    def update(self, text: Text) -> DataFrame:
        writer, alias = self.target(text)
        text.need("set")
        values = settings(text.until("from", "where", "returning"))
        source = text.until("where", "returning") if text.take("from") else None
        where = text.until("returning") if text.take("where") else None
        returning = self.returned(text, alias)
        self.end(text)
        constant = all(not re.search(r"[A-Za-z_`]", re.sub(r"'[^']*'|(?i:\b(?:null|true|false|date|timestamp)\b)", "", v)) for v in values.values())
        reads = returning is not None or source is not None or where is not None or not constant
        desc = writer.allowed(Verb.UPDATE, returning is not None, reads)
        values = writer.known(desc, writer.narrowed({k: re.sub(rf"^`?{re.escape(alias)}`?\s*\.\s*", "t.", v) if re.fullmatch(r"[\w`.\s]+", v) and v.strip("`").lower() in (k.lower(), f"{alias}.{k}".lower()) else v for k, v in values.items()}))
        values = {k: re.sub(r"^t\.", f"`{alias}`.", v) if re.fullmatch(r"t\.\w+", v) else v for k, v in values.items()}
        new = ", ".join(f"'{f.name}', CAST({values[f.name] if f.name in values else f'`{alias}`.`{f.name}`'} AS {f.dataType.simpleString()})" for f in desc.schema.fields)
        changes = self.query(f"SELECT {', '.join(f'`{alias}`.{i}' for i in ID)}, named_struct({new}) AS _new FROM {self.targeted(writer, alias, Verb.UPDATE, reads)}" + (f" CROSS JOIN {source}" if source else "") + (f" WHERE {where}" if where else ""))
        return self.given(writer.changed(desc, changes, values, returning is not None), returning, alias)

    def delete(self, text: Text) -> DataFrame:
        text.need("from")
        writer, alias = self.target(text)
        source = text.until("where", "returning") if text.take("using") else None
        where = text.until("returning") if text.take("where") else None
        returning = self.returned(text, alias)
        self.end(text)
        reads = returning is not None or source is not None or where is not None
        desc = writer.allowed(Verb.DELETE, returning is not None, reads)
        old = f", named_struct({', '.join(f'{f.name!r}, `{alias}`.`{f.name}`' for f in desc.schema.fields)}) AS _old" if returning else ""
        gone = self.query(f"SELECT {', '.join(f'`{alias}`.{i}' for i in ID)}{old} FROM {self.targeted(writer, alias, Verb.DELETE, reads)}" + (f" CROSS JOIN {source}" if source else "") + (f" WHERE {where}" if where else ""))
        if source:
            gone = gone.dropDuplicates(list(ID))
        return self.given(writer.removed(desc, gone, returning is not None), returning, alias)

    def truncate(self, text: Text) -> DataFrame:
        text.take("table")
        name = text.name()
        self.end(text)
        return self.counted(self.engine.delete(name).count)

    # MERGE

    def merge(self, text: Text) -> DataFrame:
        text.need("into")
        writer, alias = self.target(text)
        text.need("using")
        text.skip()
        if text.peek() == ["("]:
            source, name = f"SELECT * FROM ({''.join(text.within())})", "source"
        else:
            name = text.name()
            source = f"SELECT * FROM {name}"
            name = name.rpartition(".")[2]
        text.take("as")
        if text.peek() != ["on"]:
            name = text.name()
            if text.peek() == ["("]:
                source += f" AS `{name}`({''.join(text.within())})"
        text.need("on")
        on = text.until("when")
        actions = []
        while text.take("when"):
            matched = not text.take("not")
            text.need("matched")
            if text.take("by", "source"):
                raise Refused("WHEN NOT MATCHED BY SOURCE")
            text.take("by", "target")
            condition = text.until("then") if text.take("and") else "true"
            text.need("then")
            if text.take("update", "set"):
                actions.append(When(matched, "update", settings(text.until("when", "returning")), condition))
            elif text.take("delete"):
                actions.append(When(matched, "delete", None, condition))
            elif text.take("do", "nothing"):
                actions.append(When(matched, "nothing", None, condition))
            elif text.take("error"):
                text.until("when", "returning")
                actions.append(When(matched, "error", None, condition))
            else:
                text.need("insert")
                known = [f.name for f in self.engine.describe(writer.name).schema.fields]
                columns = [plain("".join(c).strip()) for c in split(text.within())] if text.peek() == ["("] else known
                if text.take("default", "values"):
                    columns, values = [], []
                elif text.peek() == ["*"]:
                    text.need("*")
                    values = [f"`{name}`.`{c}`" for c in columns]
                else:
                    text.need("values")
                    values = ["".join(v).strip() for v in split(text.within())]
                if any(v.lower() == "default" for v in values):
                    raise Refused("DEFAULT as a value")
                if len(values) != len(columns):
                    raise Refused(f"{len(values)} values for the columns {columns}")
                actions.append(When(matched, "insert", dict(zip(columns, values, strict=True)), condition))
        returning = self.returned(text, alias)
        self.end(text)
        return self.given(writer.merge(self.query(source), on, actions, returning is not None, alias, name), returning, alias)

    # Definitions

    def create(self, text: Text) -> DataFrame:
        replace = text.take("or", "replace")
        if text.take("view"):
            name = text.name()
            text.need("as")
            self.engine.create_view(name, text.until())
            return self.nothing()
        text.need("table")
        absent = text.take("if", "not", "exists")
        name = text.name()
        if absent and self.engine.exists(name):
            return self.nothing()
        if replace and self.engine.exists(name):
            self.engine.drop_table(name)
        if text.take("as"):
            return self.counted(self.engine.create_table_as(name, self.query(text.until())).count)
        fields, key, defaults = [], [], {}
        for one in split(text.within()):
            column = Text("".join(one))
            if column.take("primary", "key"):
                key = [plain("".join(c).strip()) for c in split(column.within())]
                continue
            if column.peek()[0] in ("unique", "check", "foreign", "constraint"):
                raise Refused(f"a source's table here can't enforce {column.peek()[0].upper()}")
            field, kind, null = column.name(), column.until("primary", "not", "null", "default", "unique", "check", "references"), True
            while not column.done():
                if column.take("primary", "key"):
                    key = [field]
                elif column.take("not", "null"):
                    raise Refused("a source's table here can't enforce NOT NULL but for its key")
                elif column.take("null"):
                    null = True
                elif column.take("default"):
                    value = column.until("primary", "not", "null", "unique", "check")
                    (defaults[field],) = self.spark.sql(f"SELECT CAST({value} AS {spark_kind(kind)})").first()
                else:
                    raise Refused(f"a source's table here can't enforce {''.join(column.parts[column.at :])}")
            fields.append(T.StructField(field, self.spark.sql(f"SELECT CAST(NULL AS {spark_kind(kind)}) AS x").schema[0].dataType, null))
        self.end(text)
        self.engine.create_table_as(name, self.spark.createDataFrame([], T.StructType(fields)), tuple(key), defaults)
        return self.nothing()

    def drop(self, text: Text) -> DataFrame:
        view = text.take("view")
        if not view:
            text.need("table")
        there = text.take("if", "exists")
        name = text.name()
        self.end(text)
        if view:
            self.engine.drop_view(name, there)
        elif not there or self.engine.exists(name):
            self.engine.drop_table(name)
        return self.nothing()

    def alter(self, text: Text) -> DataFrame:
        text.need("table")
        name = text.name()
        if text.take("add"):
            text.take("column")
            column = text.name()
            self.engine.add_column(name, column, spark_kind(text.until()))
        elif text.take("drop"):
            text.take("column")
            self.engine.drop_column(name, text.name())
        elif text.take("rename"):
            text.take("column")
            old = text.name()
            text.need("to")
            self.engine.rename_column(name, old, text.name())
        self.end(text)
        return self.nothing()

    # Transactions

    def begin(self, text: Text) -> DataFrame:
        text.take("transaction")
        self.engine.begin()
        return self.nothing()

    def commit(self, text: Text) -> DataFrame:
        self.engine.commit()
        return self.nothing()

    def rollback(self, text: Text) -> DataFrame:
        self.engine.rollback()
        return self.nothing()


def spark_kind(name: str) -> str:
    """Spark's name of a type that is written as sources write it."""
    from tidewater.types import to_spark

    try:
        return to_spark(name.strip()).simpleString()
    except (ValueError, KeyError):
        return name.strip()
