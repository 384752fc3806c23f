"""Queries as sources understand them, in Spark's SQL.

Text is read by clause, not by expression tree: names, types and plans stay Spark's work. What is rewritten here either has
no form in Spark's SQL (ASOF and POSITIONAL JOIN, DISTINCT ON, quantified comparisons, GROUPS and EXCLUDE frames, FILTER and
DISTINCT in windows, ordered aggregates, LIMIT in percent, UNION BY NAME, PIVOT, MATERIALIZED) or another meaning there (where
nulls stand, IN as a value, division, concat). A form that can't be rewritten is refused.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.errors import Refused
from tidewater.operators import joins
from tidewater.plans.names import blank, closing, level, plain, solid, tokens
from tidewater.staging import staged

CLAUSES = ("select", "from", "where", "group by", "having", "qualify", "window", "order by", "limit", "offset")
COMPARES = ("=", "<>", "!=", "<", "<=", ">", ">=")
#: Words and signs that end an operand of a comparison, read from the right.
ENDS_OPERAND = {
    *"select distinct where having on and or not when then else case by qualify from join values set limit between in is like ilike using , ( = <> != < <= > >=".split()
}
CUTS_FACTOR = ENDS_OPERAND | {"+", "-", "||", "as"}
#: Aggregates that no order of their rows changes.
UNORDERED = set("sum count min max avg stddev variance bool_and bool_or median bit_and bit_or bit_xor".split())
JOIN_WORDS = set("join left right inner full semi anti cross natural outer".split())
#: Statements of Spark that are no queries: they run as they are.
AS_IT_IS = set("explain show describe desc set reset refresh cache uncache analyze list".split())
VOLATILE = set("rand random randn uuid tablesample shuffle".split())


def words(parts: list[str], start: int = 0, end: int | None = None) -> list[tuple[int, str]]:
    return [(i, parts[i].lower()) for i in level(parts, start, end)]


def joined(parts: list[str]) -> str:
    return "".join(parts).strip()


def split(parts: list[str], by: str = ",") -> list[list[str]]:
    out, last = [], 0
    for i in level(parts):
        if parts[i].lower() == by:
            out.append(parts[last:i])
            last = i + 1
    return [*out, parts[last:]]


def starts_query(parts: list[str]) -> bool:
    first = next((parts[i].lower() for i in solid(parts)), "")
    return first in ("select", "with", "values", "table", "pivot") or first == "(" and starts_query(parts[parts.index("(") + 1 :])


def clauses(parts: list[str]) -> dict[str, list[str]]:
    """The clauses of one SELECT, without their first words."""
    marks, found = [], words(parts)
    for n, (i, w) in enumerate(found):
        two = f"{w} {found[n + 1][1]}" if n + 1 < len(found) else ""
        if two in CLAUSES:
            marks.append((i, found[n + 1][0] + 1, two))
        elif w in CLAUSES and not (w == "from" and n and found[n - 1][1] == "distinct" and found[n - 2][1] in ("is", "not")):
            marks.append((i, i + 1, w))
    out: dict[str, list[str]] = {}
    for (_, a, name), z in zip(marks, [*(m[0] for m in marks[1:]), len(parts)], strict=False):
        if name in out:
            raise Refused(f"two {name.upper()} in one query")
        out[name] = parts[a:z]
    return out


def ordered(parts: list[str]) -> list[str]:
    """The keys of ORDER BY, each with where nulls stand: last, unless it says so."""
    keys = [joined(k) for k in split(parts)]
    return [k if re.search(r"(?i)\bnulls\s+(first|last)\s*$", k) or k.lower() == "all" else f"{k} NULLS LAST" for k in keys]


class Dialect:
    """Rewrites one statement for an engine. `named` puts views in place of attached tables in a piece of text."""

    def __init__(self, engine, named: Callable[[str], str], ctes: list[str] | None = None):
        self.engine, self.spark, self.named, self.ctes = engine, engine.spark, named, ctes or []

    def frame(self, sql: str) -> DataFrame:
        parts = [self.quoted(t) for t in tokens(sql)]
        while parts and (blank(parts[-1]) or parts[-1] == ";"):
            parts.pop()
        percent = None
        tail = [t for t in parts if not blank(t)][-3:]
        if len(tail) == 3 and tail[0].lower() == "limit" and (tail[2] == "%" or tail[2].lower() == "percent"):
            percent, at = float(tail[1]), max(i for i, t in enumerate(parts) if t.lower() == "limit")
            parts = parts[:at]
        text = self.query(parts)
        self.refuse_traps(text)
        df = self.spark.sql(self.named(text))
        if percent is None:
            return df
        rows = df.withColumn("_tidewater_at", F.monotonically_increasing_id())
        kept = staged(rows)  # its places are those of the order, so neither the input nor the order is computed twice
        return kept.orderBy("_tidewater_at").limit(int(kept.count() * percent / 100)).drop("_tidewater_at")

    @staticmethod
    def refuse_traps(text: str) -> None:
        """What is left of forms that Spark would take for something else: words before JOIN that it reads as an alias."""
        low = [t.lower() for t in tokens(text) if not blank(t)]
        for a, b in zip(low, low[1:], strict=False):
            if a in ("asof", "positional") and b in JOIN_WORDS:
                raise Refused(f"{a.upper()} JOIN in this place")

    @staticmethod
    def quoted(token: str) -> str:
        """A name in double quotes and a backslash in a text, as Spark writes them."""
        if token[0] == '"':
            return "`" + plain(token).replace("`", "``") + "`"
        return token.replace("\\", "\\\\") if token[0] == "'" else token

    def part(self, sql: str) -> DataFrame:
        """A part of the statement as a frame of its own; it sees the CTEs before it."""
        prefix = f"WITH {', '.join(self.ctes)} " if self.ctes else ""
        return self.spark.sql(self.named(prefix + sql))

    # Queries

    def query(self, parts: list[str]) -> str:
        first = next((parts[i].lower() for i in solid(parts)), "")
        if first == "with":
            return self.with_(parts)
        if first == "pivot":
            return self.pivot(parts)
        if first in AS_IT_IS:
            return joined(parts)
        cuts, found = [], words(parts)
        for n, (i, w) in enumerate(found):
            if w in ("union", "except", "intersect", "minus"):
                more, k = [w], n + 1
                while k < len(found) and found[k][1] in ("all", "distinct", "by", "name"):
                    more.append(found[k][1])
                    k += 1
                cuts.append((i, found[k][0] if k < len(found) else len(parts), more))
        if not cuts:
            return self.select(parts)
        pieces = [parts[a:z] for a, z in zip([0, *(c[1] for c in cuts)], [*(c[0] for c in cuts), len(parts)], strict=True)]
        tail = next((i for i, w in words(pieces[-1]) if w in ("order", "limit", "offset")), len(pieces[-1]))
        after = self.tail(pieces[-1][tail:])
        pieces[-1] = pieces[-1][:tail]
        texts = [self.query(p) if not joined(p).startswith("(") else f"SELECT * FROM ({self.query(p[p.index('(') + 1 : closing(p, p.index('('))])})" for p in pieces]
        if not any("name" in c[2] for c in cuts):
            out = texts[0]
            for (_, _, how), t in zip(cuts, texts[1:], strict=True):
                out += f" {' '.join(how).upper()} {t}"
            return out + after
        if any(c[2][0] != "union" for c in cuts):
            raise Refused("BY NAME beside EXCEPT or INTERSECT")
        out, have = texts[0], self.part(texts[0]).columns
        for (_, _, how), t in zip(cuts, texts[1:], strict=True):
            more = self.part(t).columns
            if "name" in how:
                lows, all_ = [c.lower() for c in more], [*have, *(c for c in more if c.lower() not in {h.lower() for h in have})]
                show = lambda there, cols: ", ".join(f"`{c}`" if c.lower() in there else f"NULL AS `{c}`" for c in cols)
                out = f"SELECT {show({h.lower() for h in have}, all_)} FROM ({out}) UNION {'ALL ' * ('all' in how)}SELECT {show(lows, all_)} FROM ({t})"
                have = all_
            else:
                out = f"{out} {' '.join(how).upper()} {t}"
        return f"SELECT * FROM ({out}){after}"

    def tail(self, parts: list[str]) -> str:
        """ORDER BY, LIMIT and OFFSET."""
        found = clauses(parts) if parts else {}
        out = ""
        if "order by" in found:
            out += " ORDER BY " + ", ".join(ordered(tokens(self.expression(found["order by"]))))
        for word in ("limit", "offset"):
            if word in found:
                text = joined(found[word])
                if re.search(r"(?i)(%|\bpercent)$", text):
                    raise Refused("LIMIT in percent stands at the end of a statement only")
                out += f" {word.upper()} {self.expression(found[word])}"
        return out

    def with_(self, parts: list[str]) -> str:
        found = words(parts)
        at = 2 if found[1][1] == "recursive" else 1
        recursive, shown, before = at == 2, [], len(self.ctes)
        while True:
            name, at = plain(parts[found[at][0]]), at + 1
            columns = ""
            if found[at][1] == "(":
                columns, at = "".join(parts[found[at][0] : closing(parts, found[at][0]) + 1]), at + 1
            at += 1  # AS
            while found[at][1] in ("not", "materialized"):
                at += 1
            body = parts[found[at][0] + 1 : closing(parts, found[at][0])]
            text = self.query(body)
            if not recursive and any(t.lower() in VOLATILE for t in body):  # once, whatever reads it
                view = self.engine.temporary("cte")
                staged(self.part(text)).createOrReplaceTempView(view)
                text = f"SELECT * FROM {view}"
            shown.append(f"`{name}`{columns} AS ({text})")
            self.ctes.append(shown[-1])
            at += 1
            if at < len(found) and found[at][1] == ",":
                at += 1
                continue
            break
        main = self.query(parts[found[at][0] :])
        del self.ctes[before:]
        return f"WITH {'RECURSIVE ' * recursive}{', '.join(shown)} {main}"

    def pivot(self, parts: list[str]) -> str:
        """PIVOT rows ON column [IN (values)] USING aggregates [GROUP BY columns]: an aggregate FILTER for each value."""
        found = words(parts)
        place = {w: i for i, w in reversed(found) if w in ("on", "using", "group", "in")}
        if "on" not in place or "using" not in place:
            raise Refused("PIVOT needs ON and USING")
        rows = self.relation(parts[found[0][0] + 1 : place["on"]])
        column = self.expression(parts[place["on"] + 1 : place.get("in", place["using"])])
        if "in" in place:
            a = next(i for i, w in found if i > place["in"] and w == "(")
            values = [joined(v) for v in split(parts[a + 1 : closing(parts, a)])]
        else:
            kept = self.part(f"SELECT DISTINCT {column} AS v FROM {rows} WHERE {column} IS NOT NULL")
            values = [repr(r[0]) if not isinstance(r[0], str) else "'" + r[0].replace("\\", "\\\\").replace("'", "\\'") + "'" for r in kept.orderBy("v").collect()]  # a column of the result each
        values = list(dict.fromkeys(values))
        aggregates = []
        for one in split(parts[place["using"] + 1 : place.get("group", len(parts))]):
            m = re.fullmatch(r"(?is)(.*?)(?:\s+AS\s+([`\"\w]+))?", joined(one))
            aggregates.append((self.expression(tokens(m[1])), plain(m[2]) if m[2] else None))
        groups = joined(parts[place["group"] + 1 :])[2:].strip() if "group" in place else ""
        if not groups:
            used = {plain(t).lower() for t in [*tokens(column), *(t for a, _ in aggregates for t in tokens(a))]}
            groups = ", ".join(f"`{c}`" for c in self.part(f"SELECT * FROM {rows}").columns if c.lower() not in used)
        cells = []
        for v in values:
            for a, name in aggregates:
                label = v[1:-1].replace("\\'", "'") if v.startswith("'") else v
                cells.append(f"{a} FILTER (WHERE {column} = {v}) AS `{label if len(aggregates) == 1 and not name else f'{label}_{name or a}'}`")
        shown = f"{groups}, " if groups else ""
        return f"SELECT {shown}{', '.join(cells)} FROM {rows}" + (f" GROUP BY {groups}" if groups else "")

    def select(self, parts: list[str]) -> str:
        found = clauses(parts)
        if "select" not in found:
            return self.expression(parts)
        star, from_ = [], None
        if "from" in found:
            from_, star = self.from_(found["from"])
        head, list_ = "SELECT ", found["select"]
        first = [w for _, w in words(list_)[:2]]
        on = None
        if first == ["distinct", "on"]:
            a = list_.index("(")
            on, list_ = self.expression(list_[a + 1 : closing(list_, a)]), list_[closing(list_, a) + 1 :]
        elif first[:1] in (["distinct"], ["all"]):
            k = words(list_)[0][0]
            head, list_ = f"SELECT {list_[k].upper()} ", list_[k + 1 :]
        where = self.expression(found["where"], keeps=True) if "where" in found else None
        if self.framed(list_, found):
            from_ = self.ranked(list_, found, from_, where)
            where = None if self.moved else where
        shown = self.expression(list_)
        if star:
            shown = ", ".join(f"* EXCEPT ({', '.join(star)})" if joined(x) == "*" else joined(x) for x in split(tokens(shown)))
        rest = (f" FROM {from_}" if from_ else "") + (f" WHERE {where}" if where else "")
        for name in ("group by", "having"):
            if name in found:
                rest += f" {name.upper()} {self.expression(found[name], keeps=name == 'having')}"
        if "window" in found:
            rest += " WINDOW " + self.expression(found["window"])
        keys = ordered(tokens(self.expression(found["order by"]))) if "order by" in found else []
        limits = "".join(f" {w.upper()} {self.expression(found[w])}" for w in ("limit", "offset") if w in found)
        if any(re.search(r"(?i)(%|\bpercent)$", joined(found[w])) for w in ("limit", "offset") if w in found):
            raise Refused("LIMIT in percent stands at the end of a statement only")
        if "qualify" in found:
            if on or "distinct" in head.lower():
                raise Refused("QUALIFY beside DISTINCT")
            inner = f"SELECT {shown}, ({self.expression(found['qualify'])}) AS _tidewater_q" + "".join(f", {self.key(k)} AS _tidewater_o{n}" for n, k in enumerate(keys)) + rest
            return f"SELECT * EXCEPT ({', '.join(['_tidewater_q', *(f'_tidewater_o{n}' for n in range(len(keys)))])}) FROM ({inner}) WHERE _tidewater_q" + self.hidden_order(keys) + limits
        if on:
            inner = f"SELECT {shown}, row_number() OVER (PARTITION BY {on} ORDER BY {', '.join(keys) or on}) AS _tidewater_q" + "".join(f", {self.key(k)} AS _tidewater_o{n}" for n, k in enumerate(keys)) + rest
            return f"SELECT * EXCEPT ({', '.join(['_tidewater_q', *(f'_tidewater_o{n}' for n in range(len(keys)))])}) FROM ({inner}) WHERE _tidewater_q = 1" + self.hidden_order(keys) + limits
        return head + shown + rest + (f" ORDER BY {', '.join(keys)}" if keys else "") + limits

    @staticmethod
    def key(text: str) -> str:
        return re.sub(r"(?i)(\s+(asc|desc))?\s+nulls\s+(first|last)\s*$", "", text)

    def hidden_order(self, keys: list[str]) -> str:
        return " ORDER BY " + ", ".join(f"_tidewater_o{n}{k[len(self.key(k)) :]}" for n, k in enumerate(keys)) if keys else ""

    # FROM

    def relation(self, parts: list[str]) -> str:
        text, star = self.from_(parts)
        if star:
            raise Refused("a join in this place")
        return text

    def from_(self, parts: list[str]) -> tuple[str, list[str]]:
        """The clause's text, and the names of what stands for the sides of joins in it, which `*` leaves out."""
        found, star = words(parts), []
        at = next((n for n, (_, w) in enumerate(found) if w in ("asof", "positional") and n + 1 < len(found) and found[n + 1][1] in JOIN_WORDS), None)
        if at is None:
            return self.expression(parts), star
        kind, n = found[at][1], at + 1
        how = []
        while found[n][1] != "join":
            how.append(found[n][1])
            n += 1
        if kind == "positional" and how or kind == "asof" and how not in ([], ["inner"], ["left"], ["left", "outer"]):
            raise Refused(f"{kind.upper()} {' '.join(how).upper()} JOIN")
        left, right = parts[: found[at][0]], parts[found[n][0] + 1 :]
        if any(w in ("join", ",") for _, w in words(left)):
            raise Refused(f"{kind.upper()} JOIN behind another join; make that one a query in parentheses")
        ends = [(i, w) for i, w in words(right) if w in ("on", "using", "join", ",", "inner", "left", "right", "full", "cross", "asof", "positional")]
        if any(w in ("join", ",", "asof", "positional") for _, w in ends):
            raise Refused(f"{kind.upper()} JOIN before another join; make it a query in parentheses")
        cut = ends[0] if ends else (len(right), "")
        condition, using = (right[cut[0] + 1 :], cut[1] == "using") if cut[1] in ("on", "using") else ([], False)
        sides = [self.side(left, kind), self.side(right[: cut[0]], kind)]
        df = self.asof(sides, condition, using, how) if kind == "asof" else self.positional(sides)
        view = self.engine.temporary(kind)
        df.createOrReplaceTempView(view)
        names = [f"`{name}`" for _, name, _ in sides]
        fields = [f"{n}.`{c}`" for n, (_, _, columns) in zip(names, sides, strict=True) for c in columns]
        return f"(SELECT {', '.join([*names, *fields])} FROM {view})", names

    def side(self, parts: list[str], kind: str) -> tuple[str, str, list[str]]:
        """(text, alias, columns) of a table or a query in parentheses."""
        found = words(parts)
        if parts[found[0][0]] == "(":
            end = closing(parts, found[0][0])
            text, alias = f"({self.query(parts[found[0][0] + 1 : end])})", [plain(parts[i]) for i, w in words(parts, end + 1) if w != "as"]
        else:
            n = 1
            while n + 1 < len(found) and parts[found[n][0]] == ".":
                n += 2
            text, alias = "".join(parts[found[0][0] : found[n - 1][0] + 1]), [plain(parts[i]) for i, w in found[n:] if w != "as"] or [plain(parts[found[n - 1][0]])]
        if len(alias) != 1:
            raise Refused(f"{kind.upper()} JOIN needs two tables or queries with a name each")
        return text, alias[0], self.part(f"SELECT * FROM {text} AS `{alias[0]}`").columns

    def asof(self, sides, condition: list[str], using: bool, how: list[str]) -> DataFrame:
        def of(k: int, text: str) -> bool:
            try:
                self.part(f"SELECT {text} FROM {sides[k][0]} AS `{sides[k][1]}`")
            except Exception:
                return False
            return True

        pairs: list[tuple[str, str, str]] = []
        if using:
            columns = [joined(c) for c in split(condition[condition.index("(") + 1 : closing(condition, condition.index("("))])]
            pairs = [(f"`{sides[0][1]}`.{c}", "=", f"`{sides[1][1]}`.{c}") for c in columns[:-1]] + [(f"`{sides[0][1]}`.{columns[-1]}", ">=", f"`{sides[1][1]}`.{columns[-1]}")]
        else:
            for one in split(condition, "and"):
                sign = [i for i in level(one) if one[i] in COMPARES]
                if len(sign) != 1:
                    raise Refused(f"ASOF JOIN ON {joined(one)}")
                a, op, b = joined(one[: sign[0]]), one[sign[0]], joined(one[sign[0] + 1 :])
                if not of(0, a) and of(1, a):
                    a, op, b = b, {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op), a
                if not of(0, a) or not of(1, b):
                    raise Refused(f"ASOF JOIN ON {joined(one)}")
                pairs.append((a, op, b))
        times = [p for p in pairs if p[1] != "="]
        if len(times) != 1 or times[0][1] not in (">=", ">", "<=", "<"):
            raise Refused("ASOF JOIN needs one inequality beside its equalities")
        (x, op, y), equal = times[0], [p for p in pairs if p[1] == "="]
        if op in ("<=", "<"):  # the next right row: the last one, as time runs backwards
            numeric = {"date", "timestamp", "timestamp_ntz"} & {dict(self.part(f"SELECT {e} AS t FROM {s[0]} AS `{s[1]}`").dtypes)["t"] for e, s in ((x, sides[0]), (y, sides[1]))}
            wrap = "-unix_micros(CAST({} AS TIMESTAMP))" if numeric else "-({})"
            x, y = wrap.format(x), wrap.format(y)
        frames = []
        for (text, alias, _), keys, time in ((sides[0], [p[0] for p in equal], x), (sides[1], [p[2] for p in equal], y)):
            more = "".join(f", {k} AS _k{i}" for i, k in enumerate(keys))
            frames.append(self.part(f"SELECT struct(`{alias}`.*) AS `{alias}`{more}, {time} AS _t FROM {text} AS `{alias}`"))
        left, right = frames[0], frames[1].toDF(sides[1][1], *[f"_r{i}" for i in range(len(equal))], "_rt")
        found = joins.asof_join(left, right, "_t", "_rt", {f"_k{i}": f"_r{i}" for i in range(len(equal))}, [sides[1][1]], "left" if "left" in how else "inner", op in (">", "<"))
        return found.select(f"`{sides[0][1]}`", f"`{sides[1][1]}`")

    def positional(self, sides) -> DataFrame:
        """In the order of a query's ORDER BY, or of a table's files and the places in them."""
        placed = []
        for text, alias, columns in sides:
            if text.startswith("("):
                inner = tokens(text[1:-1])
                keys = ordered(clauses(inner).get("order by", [])) if next(iter(clauses(inner)), "") == "select" else []
                if not keys:
                    raise Refused("POSITIONAL JOIN of a query without ORDER BY")
                rows = self.part(f"SELECT * FROM {text}").withColumn("_at", F.monotonically_increasing_id())  # of sorted partitions
                df = staged(rows)
            else:
                at, schema, table = self.engine.find(text)
                if not at.describe(schema, table).row_ids:
                    raise Refused(f"POSITIONAL JOIN of {text}, whose rows have no order")
                df = at.rows(self.spark, schema, table, row_id=True)
                df = df.withColumn("_at", F.struct(F.substring_index("rowid", "#", 1), F.substring_index("rowid", "#", -1).cast("long")))
            placed.append(df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias(alias), "_at"))
        both = joins.positional_join(*placed, [F.col("_at")], [F.col("_at")]) if placed[0].columns[0] != placed[1].columns[0] else None
        if both is None:
            raise Refused("POSITIONAL JOIN of two sides with one name")
        return both.select(f"`{sides[0][1]}`", f"`{sides[1][1]}`")

    # Frames that Spark lacks

    def framed(self, list_: list[str], found: dict) -> bool:
        low = [t.lower() for t in list_ if not blank(t)]
        self.moved = False
        return any(a == "groups" and b in ("between", "unbounded", "current") or a == "groups" and b.isdigit() for a, b in zip(low, low[1:], strict=False))

    def ranked(self, list_: list[str], found: dict, from_: str, where: str | None) -> str:
        """FROM with a rank of peers for each window with GROUPS; windows then use RANGE over it."""
        if "group by" in found or from_ is None:
            raise Refused("a GROUPS frame beside GROUP BY")
        name = re.fullmatch(r"(?s)\s*(?:\(.*\)|[\w.`]+)(?:\s+(?:AS\s+)?([\w`]+))?\s*", from_)
        if not name or any(w in ("join", ",") for _, w in words(tokens(from_))):
            raise Refused("a GROUPS frame over a join; put the join in parentheses")
        alias = name[1] or from_.strip().rpartition(".")[2]
        ranks = []
        for i in [i for i, t in enumerate(list_) if t == "("][::-1]:
            inside = list_[i + 1 : closing(list_, i)]
            marks = [k for k, w in words(inside) if w == "groups"]
            if marks:
                spec = clauses([*inside[: marks[0]]])
                keys = ordered(tokens(self.expression(spec["order by"]))) if "order by" in spec else []
                partition = joined(inside[: next(k for k, w in words(inside) if w == "order")]) if keys else ""
                if not keys:
                    raise Refused("a GROUPS frame without ORDER BY")
                ranks.append(f"dense_rank() OVER ({partition} ORDER BY {', '.join(keys)}) AS _tidewater_g{len(ranks)}")
                k = next(k for k, w in words(inside) if w == "order")
                new = [*tokens(f"{partition} ORDER BY _tidewater_g{len(ranks) - 1} RANGE "), *inside[marks[0] + 1 :]]
                list_[i + 1 : closing(list_, i)] = new
        self.moved = True
        hidden = ", ".join(f"_tidewater_g{n}" for n in range(len(ranks)))
        if any(joined(x) == "*" for x in split(list_)):
            list_[:] = tokens(", ".join(f"* EXCEPT ({hidden})" if joined(x) == "*" else joined(x) for x in split(list_)))
        return f"(SELECT *, {', '.join(ranks)} FROM {from_}{f' WHERE {where}' if where else ''}) AS {alias}"

    # Expressions

    def expression(self, parts: list[str], keeps: bool = False) -> str:
        """Text of expressions. keeps: this is a condition of which only true counts, so IN needs no third value at its top."""
        out: list[str] = []
        i = 0
        while i < len(parts):
            if parts[i] != "(":
                out.append(parts[i])
                i += 1
                continue
            end = closing(parts, i)
            inside = parts[i + 1 : end]
            call = next((t.lower() for t in reversed(out) if not blank(t)), "")
            if starts_query(inside):
                out.append(f"({self.query(inside)})")
            elif any(w == "order" for _, w in words(inside)):
                out = self.ordered_call(out, call, inside)
            else:
                after = next((parts[k].lower() for k in solid(parts) if k > end), "")
                group = keeps and call in ("", "(", "and", "or", "where") and after in ("", "and", "or")
                out.append(f"({self.expression(inside, group)})")
                if call == "concat":
                    k = max(n for n, t in enumerate(out) if t.lower() == "concat")
                    out[k] = "concat_ws"
                    out[-1] = "(''," + out[-1][1:]
            i = end + 1
        out = self.types(out)
        out = self.windows(out)
        out = self.quotients(out)
        return joined(self.quantifiers(self.memberships(out, keeps)))

    def types(self, out: list[str]) -> list[str]:
        """Names of types behind AS and ::, where Spark has others."""
        at = solid(out)
        for a, b in zip(at, at[1:], strict=False):
            if out[a].lower() in ("as", "::") and (spark := {"varchar": "STRING", "text": "STRING", "hugeint": "DECIMAL(38,0)", "blob": "BINARY", "timestamp": "TIMESTAMP_NTZ"}.get(out[b].lower())):
                follows = next((out[k] for k in at if k > b), "")
                if not follows.startswith("("):
                    out[b] = spark
        return out

    def ordered_call(self, out: list[str], call: str, inside: list[str]) -> list[str]:
        """An ORDER BY in parentheses: of a window, of WITHIN GROUP, or of an aggregate's arguments."""
        at = next(i for i, w in words(inside) if w == "order")
        by = next(i for i, w in words(inside) if i > at and w == "by")
        before = inside[:at]
        frame = next((i for i, w in words(inside) if i > by and w in ("rows", "range", "groups")), len(inside))
        keys = ordered(tokens(self.expression(inside[by + 1 : frame])))
        if call in ("over", "group", "as") or not joined(before) or joined(before).lower().startswith("partition"):
            return [*out, f"({self.expression(before)}{' ' * bool(joined(before))}ORDER BY {', '.join(keys)} {self.expression(inside[frame:])})"]
        k = max(n for n, t in enumerate(out) if t.lower() == call)
        args = [joined(a) for a in split(tokens(self.expression(before)))]
        if call in UNORDERED:
            return [*out[:k], f"{call}({', '.join(args)})"]
        if call in ("string_agg", "listagg", "group_concat"):
            return [*out[:k], f"listagg({', '.join(args if len(args) > 1 else [*args, repr(',')])}) WITHIN GROUP (ORDER BY {', '.join(keys)})"]
        down = {bool(re.search(r"(?i)\bdesc\s+nulls", x)) for x in keys}
        last = {x.lower().endswith("last") for x in keys}
        if call not in ("list", "array_agg", "first", "last", "any_value", "collect_list") or len(args) != 1 or len(down) > 1 or last != {True}:
            raise Refused(f"{call}(... ORDER BY ...) in this form")
        names = [self.key(x) for x in keys]
        order = "named_struct(" + ", ".join(f"'n{n}', {x} IS {'NOT ' * down.copy().pop()}NULL, 'k{n}', {x}" for n, x in enumerate(names)) + ")"
        lists = f"transform(sort_array(collect_list(named_struct('o', {order}, 'v', {args[0]})), {str(not down.pop()).lower()}), p -> p.v)"
        return [*out[:k], lists if call in ("list", "array_agg", "collect_list") else f"element_at({lists}, {-1 if call == 'last' else 1})"]

    def windows(self, out: list[str]) -> list[str]:
        """FILTER, DISTINCT and EXCLUDE of window functions. Each text in parentheses is one token here."""
        at = solid(out)
        for n in range(len(at) - 1, -1, -1):
            if out[at[n]].lower() != "over" or n < 2:
                continue
            window, k, condition = n + 1, n - 1, None
            if k >= 2 and out[at[k - 1]].lower() == "filter":
                condition, k = re.fullmatch(r"(?is)\(\s*where\s+(.*)\)", out[at[k]])[1], k - 2
            if k < 1 or not out[at[k]].startswith("("):
                continue
            name, args = out[at[k - 1]].lower(), out[at[k]][1:-1].strip()
            spec = out[at[window]] if window < len(at) else ""
            excluded = re.search(r"(?i)\bexclude\s+(current\s+row|group|ties|no\s+others)\s*\)\s*$", spec)
            distinct = re.match(r"(?is)distinct\s+(.*)", args)
            if condition is None and not excluded and not distinct:
                continue
            if distinct:
                if name != "count" or condition or excluded:
                    raise Refused(f"{name}(DISTINCT ...) OVER in this form")
                new = f"CAST(size(collect_set({distinct[1]}) OVER {spec}) AS BIGINT)"
            else:
                value = "1" if args in ("", "*") else args
                if condition is not None:
                    if name not in UNORDERED:
                        raise Refused(f"{name}(...) FILTER ... OVER")
                    value = f"CASE WHEN {condition} THEN {value} END"
                new = f"{name}({value}) OVER {spec}" if not excluded else self.excluded(name, value, spec, re.sub(r"\s+", " ", excluded[1].lower()))
            for m in at[k - 1 : window + 1]:
                out[m] = ""
            out[at[k - 1]] = new
        return out

    def excluded(self, name: str, value: str, spec: str, what: str) -> str:
        """An aggregate over a frame less a row, its peers, or both: by difference, which sum, count and avg allow."""
        whole = re.sub(r"(?i)\s*\bexclude\s+(current\s+row|group|ties|no\s+others)\s*\)\s*$", ")", spec)
        if what == "no others":
            return f"{name}({value}) OVER {whole}"
        sides = re.search(r"(?is)\brows\s+between\s+(unbounded\s+preceding|\d+\s+preceding|current\s+row)\s+and\s+(unbounded\s+following|\d+\s+following|current\s+row)\s*\)$", whole)
        if name in ("min", "max") and what == "current row" and sides:  # what lies before and what lies behind
            frames = [f"{a} AND {b}" for a, b, there in ((sides[1], "1 PRECEDING", sides[1]), ("1 FOLLOWING", sides[2], sides[2])) if not re.match(r"(?i)current|0\s", there)]
            found = [f"{name}({value}) OVER {whole[: sides.start()]}ROWS BETWEEN {f})" for f in frames]
            return f"{'least' if name == 'min' else 'greatest'}({', '.join(found)})" if len(found) == 2 else found[0] if found else "NULL"
        rows = bool(re.search(r"(?i)\brows\b", whole)) and not re.search(r"(?i)unbounded\s+preceding\s+and\s+unbounded\s+following", whole)
        holds = re.search(r"(?i)between\s+(unbounded|current|\d+|\S+)\s+(preceding|row)\s+and\s+(current\s+row|\S+\s+following)", whole) or re.search(r"(?i)(rows|range)\s+(unbounded\s+preceding|current\s+row)", whole)
        if name not in ("sum", "count", "avg") or not holds or rows and what != "current row":
            raise Refused(f"{name}(...) OVER (... EXCLUDE {what.upper()}) over this frame")
        peers = re.sub(r"(?is)\b(rows|range)\b.*\)$", "RANGE BETWEEN CURRENT ROW AND CURRENT ROW)", whole)
        own = lambda f: f"coalesce(CASE WHEN ({value}) IS NOT NULL THEN {'1' if f == 'count' else f'({value})'} END, 0)"
        less = lambda f: f"({f}({value}) OVER {whole} - " + (own(f) if what == "current row" else f"coalesce({f}({value}) OVER {peers}, 0)" + (f" + {own(f)}" if what == "ties" else "")) + ")"
        if name == "count":
            return less("count")
        return f"CASE WHEN {less('count')} > 0 THEN {less('sum')}{' / ' + less('count') if name == 'avg' else ''} END"

    def operand(self, out: list[str], end: int, stops: set[str] = ENDS_OPERAND) -> int:
        """Where the operand that ends before `end` begins."""
        i, start = end - 1, end
        cases = 0
        while i >= 0:
            t = out[i].lower()
            if not blank(out[i]):
                cases += (t == "end") - (t == "case" and cases > 0)
                if not cases and t in stops and not (t == "case" and start > i and any(x.lower() == "end" for x in out[i:end])):
                    break
                start = i
            i -= 1
        return start

    def quotients(self, out: list[str]) -> list[str]:
        """x / y and x // y by functions of the session, which give what sources give for 0."""
        while True:
            at = next((i for i, t in enumerate(out) if t in ("/", "//")), None)
            if at is None:
                return out
            self.engine.functions()
            start = self.operand(out, at, CUTS_FACTOR)
            places = [i for i in solid(out) if i > at]
            k = 1 if out[places[0]] in ("-", "+") else 0
            end = places[k]
            if out[end].lower() == "case":
                raise Refused("a CASE as a divisor; put it in parentheses")
            for i in places[k + 1 :]:
                follows = out[i].lower() in (".", "::", "[", "]", "over", "filter") or out[end] in (".", "::", "[") or out[i].startswith("(") and re.fullmatch(r"[\w`]+", out[end])
                if not follows:
                    break
                end = i
            name = "tidewater_divide" if out[at] == "/" else "tidewater_divide_int"
            out[start : end + 1] = [f"{name}({joined(out[start:at])}, {joined(out[at + 1 : end + 1])})"]

    def memberships(self, out: list[str], keeps: bool) -> list[str]:
        """x [NOT] IN (query) with its third value, where that counts."""
        n = 0
        while True:
            at = next((i for i in solid(out) if i >= n and out[i].lower() == "in"), None)
            if at is None:
                return out
            places = solid(out)
            p = places.index(at)
            n = at + 1
            if p + 1 >= len(places) or not out[places[p + 1]].startswith("(") or not starts_query(tokens(out[places[p + 1]])[1:]):
                continue
            query, negated = out[places[p + 1]], p > 0 and out[places[p - 1]].lower() == "not"
            end = places[p - 1] if negated else at
            start = self.operand(out, end)
            before = next((out[i].lower() for i in reversed(solid(out[:start]))), "")
            after = out[places[p + 2]].lower() if p + 2 < len(places) else ""
            if keeps and before in ("", "and", "or", "where") and after in ("", "and", "or"):
                continue
            x = joined(out[start:end])
            if x.startswith("(") and len(split(tokens(x)[1:-1])) > 1:
                raise Refused("IN over several columns as a value")
            text = f"(CASE WHEN (SELECT count(*) FROM {query} AS _q(_c)) = 0 THEN false WHEN {x} IN {query} THEN true WHEN {x} IS NULL OR (SELECT count(*) - count(_c) FROM {query} AS _q(_c)) > 0 THEN NULL ELSE false END)"
            out[start : places[p + 1] + 1] = [f"(NOT {text})" if negated else text]
            n = start + 1

    def quantifiers(self, out: list[str]) -> list[str]:
        """x op ANY|ALL|SOME (query), from facts about the query's column."""
        n = 0
        while True:
            places = solid(out)
            found = next(((i, p) for p, i in enumerate(places) if i >= n and out[i].lower() in ("any", "all", "some") and p and out[places[p - 1]] in COMPARES and p + 1 < len(places) and out[places[p + 1]].startswith("(")), None)
            if not found:
                return out
            i, p = found
            query = out[places[p + 1]]
            n = i + 1
            if not starts_query(tokens(query)[1:]):
                continue
            op, some = {"!=": "<>"}.get(out[places[p - 1]], out[places[p - 1]]), out[i].lower() != "all"
            start = self.operand(out, places[p - 1])
            x = joined(out[start : places[p - 1]])
            fact = lambda f: f"(SELECT {f} FROM {query} AS _q(_c))"
            lo, hi = fact("min(_c)"), fact("max(_c)")
            none, unknown = f"{fact('count(*)')} = 0", f"({x}) IS NULL OR {fact('count(*) - count(_c)')} > 0"
            if op == "=" and some or op == "<>" and not some:
                text = f"CASE WHEN {none} THEN false WHEN {x} IN {query} THEN true WHEN {unknown} THEN NULL ELSE false END"
                text = text if some else f"NOT ({text})"
            elif some:
                true = f"({x}) {op} {lo if op[0] == '>' else hi}" if op != "<>" else f"{lo} <> {hi} OR ({x}) <> {lo}"
                text = f"CASE WHEN {none} THEN false WHEN ({x}) IS NOT NULL AND ({true}) THEN true WHEN {unknown} THEN NULL ELSE false END"
            else:
                true = f"({x}) {op} {hi if op[0] == '>' else lo}" if op != "=" else f"{lo} = {hi} AND ({x}) = {lo}"
                text = f"CASE WHEN {none} THEN true WHEN ({x}) IS NOT NULL AND {lo} IS NOT NULL AND NOT ({true}) THEN false WHEN {unknown} THEN NULL ELSE true END"
            out[start : places[p + 1] + 1] = [f"({text})"]
            n = start + 1
