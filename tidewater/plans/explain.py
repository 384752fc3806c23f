"""A plan with the place of each part."""

from __future__ import annotations

from tidewater.plans.placement import ANYWHERE, NEAR, Node, Slice


def estimate(placed: Slice) -> str:
    """Spark's estimate of what is sent. It is shown, and decides nothing."""
    stats = [n.seam.java.stats() for n in placed.root.walk() if n.seam and n.seam.java is not None]
    rows = [s.rowCount().get().toString() if s.rowCount().isDefined() else f"{s.sizeInBytes()} bytes of" for s in stats]
    return " and ".join(f"about {r} rows" for r in rows)


def lines(node: Node, depth: int = 0) -> list[str]:
    pad = "  " * depth
    name = f"{node.table[0].alias}.{node.table[1]}.{node.table[2]}" if node.table else node.kind
    where = "session" if node.label == NEAR else "anywhere" if node.label == ANYWHERE else "source " + ", ".join(sorted({n.table[0].alias for n in node.walk() if n.table and n.label == node.label}))
    out = [f"{pad}{name}: {where}" + (f" ({node.why})" if node.why else "") + (" (rows are sent)" if node.seam else "")]
    for c in node.children:
        out += lines(c, depth + 1)
    return out
