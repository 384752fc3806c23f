"""Aggregates, windows, pivots, limits, samples and set operations that Spark's SQL lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewater.operators.joins import numbered
from tidewater.staging import staged


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. The order should be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def ordered_list(value: Column, order: Column, descending: bool = False) -> Column:
    """list(value ORDER BY order): nulls of the value are kept."""
    pairs = F.sort_array(F.collect_list(F.struct(order.alias("o"), value.alias("v"))), asc=not descending)
    return F.transform(pairs, lambda p: p["v"])


def pivot(df: DataFrame, groups: list[str], on: str, values: list, aggregates: dict[str, tuple[Column, object]]) -> DataFrame:
    """A column for each value (and aggregate, if several); a missing cell has the aggregate's empty value.
    Equal values give one column."""
    values = list(dict.fromkeys(values))
    out = df.groupBy(*groups).pivot(on, values).agg(*[a.alias(name) for name, (a, _) in aggregates.items()])
    for v in values:
        for name, (_, empty) in aggregates.items():
            column = str(v) if len(aggregates) == 1 else f"{v}_{name}"
            if empty is not None:
                out = out.withColumn(column, F.coalesce(F.col(f"`{column}`"), F.lit(empty)))
    return out


def window_distinct_count(value: Column, w: WindowSpec) -> Column:
    """count(DISTINCT value) OVER w."""
    return F.size(F.collect_set(value).over(w)).cast("long")


def window_filtered(aggregate, value: Column, condition: Column, w: WindowSpec) -> Column:
    """aggregate(value) FILTER (WHERE condition) OVER w, of an aggregate that skips nulls."""
    return aggregate(F.when(condition, value)).over(w)


def groups_frame(df: DataFrame, partition: list[str], order: Column, start: int, end: int, aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates over GROUPS BETWEEN start AND end: peers count as one step."""
    ranked = df.withColumn("_peers", F.dense_rank().over(Window.partitionBy(*partition).orderBy(order)))
    w = Window.partitionBy(*partition).orderBy("_peers").rangeBetween(start, end)
    return ranked.select("*", *[a.over(w).alias(n) for n, a in aggregates.items()]).drop("_peers")


def sum_excluding_current(value: Column, w: WindowSpec) -> Column:
    """sum(value) OVER (w EXCLUDE CURRENT ROW); null if no other row has a value."""
    others = F.count(value).over(w) - F.when(value.isNotNull(), 1).otherwise(0)
    return F.when(others > 0, F.sum(value).over(w) - F.coalesce(value, F.lit(0)))


def frame_by_column(df: DataFrame, partition: list[str], order: list[Column], back: str, value: str, name: str) -> DataFrame:
    """sum(value) over the row and the `back` rows before it, where `back` is a column: a frame whose bound is no constant.
    Sums up to a row, less the sum up to where its frame starts; both are read from one written table."""
    w = Window.partitionBy(*partition).orderBy(*order)
    rows = staged(df.withColumn("_n", F.row_number().over(w)).withColumn("_sum", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    starts = rows.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(partition)], F.col("_n").alias("_m"), F.col("_sum").alias("_before"))
    on = F.col("_n") - F.greatest(F.col(back), F.lit(0)) - 1 == F.col("_m")
    for i, p in enumerate(partition):
        on = on & F.col(p).eqNullSafe(F.col(f"_p{i}"))
    out = rows.join(starts, on, "left").withColumn(name, F.col("_sum") - F.coalesce("_before", F.lit(0)))
    return out.drop("_n", "_sum", "_m", "_before", *[f"_p{i}" for i in range(len(partition))])


def limit_percent(df: DataFrame, order: list[Column], percent: float) -> DataFrame:
    """The first `percent` of the rows, rounded down. The order should be total. The input is computed once, into a table."""
    rows = staged(df)
    return rows.orderBy(*order).limit(int(rows.count() * percent / 100))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def sample_rows(df: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows at random (all, if fewer): the ones with the smallest random numbers."""
    return df.withColumn("_r", F.rand(seed)).orderBy("_r").limit(n).drop("_r")


def sample_percent(df: DataFrame, percent: float, seed: int) -> DataFrame:
    return df.sample(fraction=percent / 100, seed=seed)


def union_by_name(*frames: DataFrame, distinct: bool = False) -> DataFrame:
    """Columns are matched by name; what a side lacks is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.distinct() if distinct else out


def with_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """df with each row's position from 0 in a total order."""
    return numbered(df, order, name)
