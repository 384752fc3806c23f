"""Joins: as-of, positional, mark (IN as a value), quantified comparisons, reversed semi and anti."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.staging import staged


def asof_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: dict[str, str], take: list[str], how: str = "inner", strict: bool = False, split: bool = False) -> DataFrame:
    """left with `take` of the last right row with equal keys whose right_on <= left_on (< if strict).

    One shuffle by the keys of both sides together: rows are sorted by time and the last right row is carried forward, so
    nothing is joined pairwise. A key with most of the rows is one task's work, unless `split` is set: then rows are
    range-sorted by key and time, so that such a key spreads over many tasks, and what a range ends with is carried into the next.
    how: inner (left rows without a match go) or left. Null keys and times match nothing. Among right rows of one time,
    the one with the greatest `take` counts.
    """
    keys = list(by)
    payload = F.struct(*[F.col(c) for c in take])
    seen = right.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*by.values(), right_on]))
    seen = seen.groupBy(*[F.col(r).alias(f"_k{i}") for i, r in enumerate(by.values())], F.col(right_on).alias("_t")).agg(F.max(payload).alias("_r"))
    marked = left.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(left_on).alias("_t"), F.struct(*left.columns).alias("_l"))
    both = marked.unionByName(seen, allowMissingColumns=True)
    # at one time, right rows come first (or last, if a match has to be earlier)
    first = F.when(F.col("_l").isNull(), F.lit(1 if strict else 0)).otherwise(F.lit(0 if strict else 1))
    names, order = [f"_k{i}" for i in range(len(keys))], [F.col("_t").asc_nulls_first(), first]
    if split:
        found = carried(both, names, order).where("_l IS NOT NULL")
    else:
        w = Window.partitionBy(*names).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        found = both.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_l IS NOT NULL")
    for i in range(len(keys)):
        found = found.withColumn("_r", F.when(F.col(f"_k{i}").isNotNull(), F.col("_r")))
    if how == "inner":
        found = found.where("_r IS NOT NULL")
    return found.select("_l.*", *[F.col("_r").getField(c).alias(c) for c in take])


def carried(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """rows with _r being the last _r that isn't null of the same keys up to the row, in order. Ranges of (keys, order) are tasks; what
    the last row of a range has goes on to the next range, if that begins with its keys: one row for each range."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(k).asc_nulls_first() for k in keys], *order]
    laid = staged(rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    laid = laid.withColumn("_part", F.shiftright("_at", 33))
    within = Window.partitionBy("_part", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    laid = laid.withColumn("_own", F.last("_r", ignorenulls=True).over(within))
    ends = staged(laid.groupBy("_part").agg(F.max_by(F.struct(*keys, "_own"), "_at").alias("e")).select("_part", "e.*"))
    so_far = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.select(F.lead("_part").over(Window.orderBy("_part")).alias("_next"), *[F.col(k).alias(f"_e{k}") for k in keys], F.last("_own", ignorenulls=True).over(so_far).alias("_before"))
    on = F.col("_part") == F.col("_next")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_e{k}"))
    return laid.join(F.broadcast(ends), on, "left").withColumn("_r", F.coalesce("_own", "_before"))


def positional_join(left: DataFrame, right: DataFrame, left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """Rows side by side in the given orders; the shorter side is filled with nulls.

    Numbering is global. Each side is range-sorted and numbered by partition and place, so no task holds a whole side.
    """
    a, b = (numbered(df, order, name) for df, order, name in ((left, left_order, "_pa"), (right, right_order, "_pb")))
    return a.join(b, F.col("_pa") == F.col("_pb"), "full").drop("_pa", "_pb")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with `name`, 0, 1, ... in an order that has to be total.

    Rows are range-sorted and written, so that a row's partition and place are fixed; the rows of each partition are then
    counted in that table. Counting on a second plan of the same exchange could sample other ranges."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = staged(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    counts = laid.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition of the exchange above: this window and the broadcast are as small as the session's partitions are few
    starts = counts.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return laid.join(F.broadcast(starts), F.shiftright("_at", 33) == F.col("_p")).withColumn(name, F.col("_start") + place).drop("_at", "_p", "_start")


def mark_join(left: DataFrame, right: DataFrame, value: str, among: str, mark: str = "mark") -> DataFrame:
    """left with `mark`: value IN (right.among), in three-valued logic; Spark's own IN gives false where SQL says null."""
    facts = right.agg(F.count(F.lit(1)).alias("_n"), F.count(F.when(F.col(among).isNull(), 1)).alias("_nulls"))
    keys = right.where(F.col(among).isNotNull()).select(F.col(among).alias("_among")).distinct().withColumn("_hit", F.lit(True))
    found = left.join(keys, F.col(value) == F.col("_among"), "left").crossJoin(F.broadcast(facts))  # facts: one row
    said = F.when(F.col("_n") == 0, F.lit(False)).when(F.col("_hit"), F.lit(True)).when(F.col(value).isNull() | (F.col("_nulls") > 0), F.lit(None).cast("boolean")).otherwise(F.lit(False))
    return found.withColumn(mark, said).drop("_among", "_hit", "_n", "_nulls")


def quantified(left: DataFrame, right: DataFrame, value: str, op: str, quantifier: str, among: str, name: str = "mark") -> DataFrame:
    """left with `name`: value op ANY|ALL (right.among), in three-valued logic, from one row of facts about right."""
    q = right.agg(F.count(F.lit(1)).alias("_n"), F.count(F.when(F.col(among).isNull(), 1)).alias("_nulls"), F.min(among).alias("_min"), F.max(among).alias("_max"))
    x, lo, hi = F.col(value), F.col("_min"), F.col("_max")
    any_of = {">": x > lo, ">=": x >= lo, "<": x < hi, "<=": x <= hi, "<>": (lo != hi) | (x != lo)}
    all_of = {">": x > hi, ">=": x >= hi, "<": x < lo, "<=": x <= lo, "=": (lo == hi) & (x == lo)}
    if op == "=" and quantifier.upper() == "ANY":
        return mark_join(left, right, value, among, name)
    if op == "<>" and quantifier.upper() == "ALL":
        return mark_join(left, right, value, among, name).withColumn(name, ~F.col(name))
    nothing, unknown = F.lit(None).cast("boolean"), x.isNull() | (F.col("_nulls") > 0)
    if quantifier.upper() == "ANY":
        said = F.when(F.col("_n") == 0, False).when(x.isNotNull() & any_of[op], True).when(unknown, nothing).otherwise(False)
    else:
        said = F.when(F.col("_n") == 0, True).when(x.isNotNull() & lo.isNotNull() & ~all_of[op], False).when(unknown, nothing).otherwise(True)
    return left.crossJoin(F.broadcast(q)).withColumn(name, said).drop("_n", "_nulls", "_min", "_max")


def right_semi(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Right rows with a match on the left."""
    return right.join(left, on, "left_semi")


def right_anti(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Right rows without a match on the left."""
    return right.join(left, on, "left_anti")


def band_join(left: DataFrame, right: DataFrame, left_on: str, low: str, high: str, width: float) -> DataFrame:
    """left rows with the right rows whose [low, high] holds left_on. An equi-join on a grid of `width`, then the exact test:
    a right row is sent once for each cell that it meets, so `width` should be near the ranges' usual length."""
    cell = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    cells = right.where(F.col(low) <= F.col(high)).withColumn("_cell", F.explode(F.sequence(cell(low), cell(high))))
    return left.withColumn("_of", cell(left_on)).join(cells, (F.col("_of") == F.col("_cell")) & F.col(left_on).between(F.col(low), F.col(high))).drop("_of", "_cell")
