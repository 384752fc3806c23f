"""Placement: a walk over Spark's analysed plan that says which source could run which subtree.

Only the shape of the query counts, never the size of a table. The plan itself is not changed: Spark runs it as one, and
the slices say what a source is asked for. Everything that reads Spark's own classes is in this file.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tidewater.plans.catalog import Attachment
from tidewater.sources.base import Verdict

#: A label: "near", "anywhere" (constant rows), or a source's group.
NEAR, ANYWHERE = "near", "anywhere"

# Spark's plan nodes that a source may be asked to run, by the name that it is asked with.
OPERATORS = {
    "Project": "project", "Filter": "filter", "Join": "join", "LateralJoin": "join", "Aggregate": "aggregate", "Window": "window", "Sort": "sort", "GlobalLimit": "limit", "LocalLimit": "limit",
    "Offset": "limit", "Sample": "sample", "Distinct": "distinct", "Deduplicate": "distinct", "Union": "union", "Except": "except", "Intersect": "intersect", "Generate": "unnest", "WithCTE": "cte", "CTERelationDef": "cte", "CTERelationRef": "cte",
}
THROUGH = {"SubqueryAlias", "View"}
CONSTANT = {"LocalRelation", "OneRowRelation", "UnresolvedInlineTable", "ResolvedInlineTable"}
# Expressions that are not asked about, and those that never leave the session.
PLAIN = set("AttributeReference Literal Alias OuterReference SortOrder AggregateExpression WindowExpression WindowSpecDefinition SpecifiedWindowFrame UnboundedPreceding$ UnboundedFollowing$ CurrentRow$ ListQuery".split())
UNASKED = PLAIN | set("Cast EqualTo EqualNullSafe LessThan LessThanOrEqual GreaterThan GreaterThanOrEqual Between And Or Not IsNull IsNotNull In InSubquery InSet Exists ScalarSubquery LateralSubquery UnaryMinus".split())
NEVER = set("LambdaFunction NamedLambdaVariable PythonUDF PythonUDAF ScalaUDF ScalaAggregator ScalaUDAF PythonUDTF".split())


@dataclass
class Node:
    """A copy of a plan node: labels and the splitting of filters are worked out on it."""

    kind: str
    children: list[Node]
    java: object = None
    conditions: list = field(default_factory=list)
    table: tuple[Attachment, str, str] | None = None
    label: object = NEAR
    seam: Node | None = None
    why: str = ""

    def walk(self):
        yield self
        for c in self.children:
            yield from c.walk()

    def reads_source(self) -> bool:
        return any(n.table for n in self.walk())

    def has_seam(self) -> bool:
        return any(n.seam for n in self.walk())


@dataclass
class Slice:
    """A subtree that a source runs whole."""

    attachments: list[str]
    tables: list[str]
    operators: list[str]
    sends: list[str]
    returns: list[str]
    root: Node = field(repr=False, default=None)


def seq(s) -> list:
    return [s.apply(i) for i in range(s.size())]


def name_of(java) -> str:
    return java.getClass().getSimpleName()


def conjuncts(e) -> list:
    return [x for side in (e.left(), e.right()) for x in conjuncts(side)] if name_of(e) == "And" else [e]


class Placer:
    def __init__(self, find: Callable[[str], tuple[Attachment, str, str] | None]):
        self.find = find

    def copy(self, plan) -> Node:
        kind = name_of(plan)
        if kind == "SubqueryAlias" and (found := self.find(plan.alias())):
            return Node("Floor", [], plan, table=found)
        if kind in THROUGH:
            return self.copy(plan.child())
        node = Node(kind, [self.copy(c) for c in seq(plan.children())], plan)
        for e in seq(plan.expressions()):
            node.children += [self.copy(q) for q in self.subqueries(e)]
        if kind == "Filter":
            node.conditions = conjuncts(plan.condition())
        return node

    def subqueries(self, e) -> list:
        own = [e.plan()] if name_of(e) in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery") else []
        return own + [q for c in seq(e.children()) for q in self.subqueries(c)]

    # What a source can compute

    def computable(self, e, source) -> Verdict:
        kind = name_of(e)
        if kind in NEVER:
            return Verdict(False, f"{kind} stays on the session")
        if not e.deterministic():
            return Verdict(False, f"{e.prettyName()} would be evaluated twice")
        if kind == "WindowExpression":
            text = e.toString().lower()
            if "ignore nulls" in text or "filter (where" in text:
                return Verdict(False, "a window with FILTER or IGNORE NULLS stays on the session")
        if kind not in UNASKED:
            if not (v := source.accepts_call(e.prettyName())):
                return v
        if kind not in PLAIN and e.resolved() and kind not in ("Exists", "InSubquery"):
            if not (v := source.accepts_type(e.dataType().simpleString())):
                return v
        for c in seq(e.children()):
            if not (v := self.computable(c, source)):
                return v
        return Verdict(True)

    # Rewrites on the copy, before labels

    def outputs(self, node: Node):
        if node.kind == "Filter" and node.java is None:
            return self.outputs(node.children[0])
        return node.java.outputSet()

    def push(self, node: Node) -> Node:
        """Deterministic conjuncts of a filter over an inner join go to the side that they read."""
        node.children = [self.push(c) for c in node.children]
        if node.kind == "Filter" and node.children[0].kind == "Join" and name_of(node.children[0].java.joinType()).startswith(("Inner", "Cross")):
            join, rest = node.children[0], []
            for e in node.conditions:
                for k in (0, 1):
                    if e.deterministic() and not self.subqueries(e) and e.references().subsetOf(self.outputs(join.children[k])):
                        join.children[k] = Node("Filter", [join.children[k]], conditions=[e])
                        break
                else:
                    rest.append(e)
            node.conditions = rest
            join.children[:2] = [self.push(c) for c in join.children[:2]]
            if not rest:
                return join
        return node

    def split(self, node: Node) -> Node:
        """A filter whose conjuncts its source can compute in part is two: that part below, the rest above."""
        node.children = [self.split(c) for c in node.children]
        if node.kind == "Filter" and len(node.conditions) > 1 and len(node.children) == 1:
            tables = {n.table[0].source.group: n.table[0].source for n in node.walk() if n.table}
            if len(tables) == 1:
                (source,) = tables.values()
                able = [e for e in node.conditions if self.computable(e, source) and not self.subqueries(e)]
                if able and len(able) < len(node.conditions):
                    rest = [e for e in node.conditions if e not in able]
                    return Node("Filter", [Node("Filter", node.children, conditions=able)], node.java, rest)
        return node

    # Labels

    def label(self, node: Node) -> None:
        for c in node.children:
            self.label(c)
        if node.table:
            node.label = node.table[0].source.group
            return
        if node.kind in CONSTANT:
            node.label = ANYWHERE
            return
        groups = {c.label for c in node.children if c.label != ANYWHERE}
        if not node.children or len(groups) > 1 or NEAR in groups:
            node.why = node.why or "its inputs don't run on one source"
            return
        if sum(c.has_seam() for c in node.children) > 1:
            node.why = "two seams never meet"
            return
        if not groups:
            node.label = ANYWHERE if node.kind in ("Project", "Filter") else NEAR
            return
        (group,) = groups
        source = next(n.table[0].source for n in node.walk() if n.table and n.label == group)
        verdict = self.runs(node, source)
        node.label, node.why = (group, "") if verdict else (NEAR, verdict.reason)

    def runs(self, node: Node, source) -> Verdict:
        if node.kind == "Expand" or node.kind == "Aggregate" and "grouping" in node.java.toString().split("\n")[0].lower():
            return Verdict(False, "grouping sets stay on the session")
        if node.kind not in OPERATORS:
            return Verdict(False, f"{node.kind} stays on the session")
        for e in node.conditions if node.kind == "Filter" else seq(node.java.expressions()):
            if not (v := self.computable(e, source)):
                return v
        return source.accepts_operator(OPERATORS[node.kind])

    # The seam

    def cut(self, node: Node) -> None:
        """Bottom-up: the first inner join that links a source's rows to rows that read no source runs on the source."""
        for c in node.children:
            self.cut(c)
        if node.kind != "Join" or node.label != NEAR or not name_of(node.java.joinType()).startswith(("Inner", "Cross")):
            return
        for far, near in (node.children[:2], node.children[1::-1]):
            if far.label in (NEAR, ANYWHERE) or far.has_seam() or near.reads_source() or near.label == ANYWHERE or any(n.kind.startswith("CTE") for n in near.walk()):
                continue
            source = next(n.table[0].source for n in far.walk() if n.table and n.label == far.label)
            condition = node.java.condition()
            if condition.isEmpty():
                node.why = "no condition links the sides"
                continue
            e = condition.get()
            links = any(not c.references().subsetOf(self.outputs(far)) and not c.references().subsetOf(self.outputs(near)) for c in conjuncts(e))
            kinds = [a.dataType().simpleString() for a in seq(near.java.output())] if near.java is not None else []
            verdict = Verdict(links, "no condition links the sides") and self.computable(e, source) and source.accepts_operator("join") and source.accepts_seam(kinds)
            if verdict:
                node.label, node.seam, node.why = far.label, near, ""
                return
            node.why = verdict.reason

    def relabel(self, node: Node) -> None:
        """Work above a seam may follow it to the source."""
        for c in node.children:
            if c is not node.seam:
                self.relabel(c)
        if node.label == NEAR and not node.seam and node.children:
            why = node.why
            node.why = ""
            groups = {c.label for c in node.children if c.label != ANYWHERE}
            if len(groups) == 1 and NEAR not in groups and sum(c.has_seam() for c in node.children) <= 1:
                source = next(n.table[0].source for n in node.walk() if n.table)
                if verdict := self.runs(node, source):
                    node.label = groups.pop()
                    return
                why = verdict.reason
            node.why = why

    def place(self, plan) -> tuple[Node, list[Slice]]:
        root = self.split(self.push(self.copy(plan)))
        self.label(root)
        self.cut(root)
        self.relabel(root)
        return root, slices(root)


def slices(root: Node) -> list[Slice]:
    """The largest labelled subtrees, from the top."""
    if root.label in (NEAR, ANYWHERE):
        return [s for c in root.children for s in slices(c)]

    def mine(node: Node):
        yield node
        for c in node.children:
            if c is not node.seam:
                yield from mine(c)

    own = list(mine(root))
    tables = [n for n in own if n.table]
    sends = [a for n in own if n.seam for a in describe(n.seam)]
    found = Slice(sorted({n.table[0].alias for n in tables}), [f"{n.table[0].alias}.{n.table[1]}.{n.table[2]}" for n in tables], [OPERATORS.get(n.kind, n.kind.lower()) for n in own if not n.table and n.kind not in CONSTANT], sends, describe(root), root)
    return [found]


def describe(node: Node) -> list[str]:
    while node.java is None:
        node = node.children[0]
    return [a.name() for a in seq(node.java.output())]


def analysed(df: DataFrame):
    return df._jdf.queryExecution().analyzed()
