"""SQL text as tokens, and names of attached tables in it."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

TOKEN = re.compile(r"""'(?:[^']|'')*'|"(?:[^"]|"")*"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/|[A-Za-z_][A-Za-z_0-9]*|\d[\w.]*|\s+|::|<>|<=>|<=|>=|!=|\|\||->|=>|//|.""", re.S)
NAME = re.compile(r"[A-Za-z_`\"]")
#: Words after a table that are not its alias.
AFTER = set("on using where group order having limit offset join inner left right full cross semi anti natural union except intersect minus window lateral tablesample pivot unpivot set values when as select qualify cluster distribute sort asof positional returning fetch".split())
#: Words that end a FROM clause.
ENDS_FROM = set("where group order having limit offset union except intersect minus window qualify select set when returning fetch values".split())
#: Functions whose arguments have FROM between them.
FROM_WITHIN = set("extract trim substring overlay position".split())


def tokens(sql: str) -> list[str]:
    return TOKEN.findall(sql)


def blank(token: str) -> bool:
    return token.isspace() or token.startswith(("--", "/*"))


def solid(parts: list[str]) -> list[int]:
    """Where tokens are that mean something."""
    return [i for i, t in enumerate(parts) if not blank(t)]


def plain(name: str) -> str:
    return name[1:-1].replace(name[0] * 2, name[0]) if name[:1] in ("`", '"') else name


def closing(parts: list[str], at: int) -> int:
    """The place of the parenthesis that closes the one at `at`."""
    depth = 0
    for i in range(at, len(parts)):
        depth += (parts[i] == "(") - (parts[i] == ")")
        if depth == 0:
            return i
    raise ValueError("a parenthesis is not closed")


def level(parts: list[str], start: int = 0, end: int | None = None) -> Iterator[int]:
    """Places of solid tokens that no parenthesis between `start` and `end` holds; of parentheses, the opening ones."""
    i, end = start, len(parts) if end is None else end
    while i < end:
        if not blank(parts[i]):
            yield i
        i = closing(parts, i) + 1 if parts[i] == "(" else i + 1


def relations(parts: list[str]) -> set[int]:
    """Places at which a table's name may stand."""
    found, states = set(), [{"from": False, "expect": False, "call": ""}]
    before = ["", ""]
    for i in solid(parts):
        word, state = parts[i].lower(), states[-1]
        if word == "(":
            inside = state["expect"]  # a relation in parentheses, which may be a join
            state["expect"] = False
            states.append({"from": inside, "expect": inside, "call": before[-1]})
        elif word == ")":
            if len(states) > 1:
                states.pop()
        elif word in ("from", "join", "into", "update", "using") and not (word == "from" and (before[-1] == "distinct" or state["call"] in FROM_WITHIN)):
            if word != "using" or not any(p.lower() == "join" for p in parts[:i]):  # else it names a join's columns
                state["from"] = state["expect"] = True
        elif word == "table" and before[-1] in ("", "(", "create", "drop", "alter", "replace", "truncate"):
            state["expect"] = True
        elif word == "," and state["from"]:
            state["expect"] = True
        elif word in ENDS_FROM or word == "on":
            state["from"], state["expect"] = state["from"] and word == "on", False
        elif word in ("lateral", "only", "if", "exists", "not"):
            pass
        elif state["expect"] and NAME.match(parts[i]) and before[-1] != ".":
            found.add(i)
            state["expect"] = False
        before = [before[-1], word]
    return found


def rewrite(sql: str, resolve: Callable[[list[str]], str | None]) -> str:
    """sql with each attached table's name in place of which `resolve` gives that of its view. The table's own last name
    becomes its alias, unless it has one, and columns that are written with a table's whole name get that alias.

    An alias that is an attachment's name, too, is an alias where a column is meant."""
    parts, out, i = tokens(sql), [], 0
    places, known = relations(parts), {}
    while i < len(parts):
        if not NAME.match(parts[i]) or out and out[-1] == "." or parts[i][0] == '"' and i not in places:
            out.append(parts[i])
            i += 1
            continue
        chain, j = [parts[i]], i + 1
        while j + 1 < len(parts) and parts[j] == "." and NAME.match(parts[j + 1]):
            chain.append(parts[j + 1])
            j += 2
        names = [plain(c) for c in chain]
        if i in places:
            view = resolve(names) if len(chain) > 1 else None
            if view is None:
                out += parts[i:j]
            else:
                known[tuple(n.lower() for n in names)] = names[-1]
                k = j
                while k < len(parts) and blank(parts[k]):
                    k += 1
                named = k < len(parts) and (parts[k].lower() == "as" or NAME.match(parts[k]) and parts[k].lower() not in AFTER)
                out.append(view if named else f"{view} AS `{names[-1]}`")
        else:
            out.append((tuple(n.lower() for n in names), parts[i:j]))
        i = j
    text = []
    for x in out:
        if isinstance(x, str):
            text.append(x)
            continue
        low, raw = x
        for n in (3, 2):
            if len(low) > n and low[:n] in known:
                raw = [f"`{known[low[:n]]}`", *raw[2 * n - 1 :]]
                break
        text += raw
    return "".join(text)
