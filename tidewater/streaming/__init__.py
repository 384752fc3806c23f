"""Rows on their way: in order, in frames, no faster than they are taken."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from tidewater.operators.joins import numbered


@dataclass(frozen=True)
class Frame:
    """Consecutive rows; `position` is that of the first."""

    position: int
    rows: list


def frames(df: DataFrame, order: list[Column] | None = None, size: int = 2048) -> Iterator[Frame]:
    """df's rows in frames of `size`. One partition is fetched at a time, and the next only when the last one is taken.
    With an order, which has to be total, rows carry their positions and come by them."""
    if order is not None:
        df = numbered(df, order, "_position").repartitionByRange("_position").sortWithinPartitions("_position")
        df = df.select(*[c for c in df.columns if c != "_position"])
    waiting, at = [], 0
    for row in df.toLocalIterator():
        waiting.append(row)
        if len(waiting) == size:
            yield Frame(at, waiting)
            at, waiting = at + len(waiting), []
    if waiting:
        yield Frame(at, waiting)
