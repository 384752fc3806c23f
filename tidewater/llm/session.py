"""What the operators share: reading tables, writing intermediate tables, size-checked broadcasts."""

from __future__ import annotations

import contextlib
import functools
import os
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.staging import shared_dir

#: Most rows, and bytes of their texts, that `small` lets Spark broadcast.
SMALL_ROWS, SMALL_BYTES = 200_000, 32 << 20

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: Rows of a batch between Spark and its Python workers: texts are long, and a batch is held on both sides.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = "1000"


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package when only the driver was told where it is, and take smaller batches than
    Spark's default of 10,000 rows, if the session has that."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, BATCH_ROWS)
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([p for p in [*paths, ROOT] if p])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: What `tidied` functions that run now have staged.
_staged: list[list[str]] = []


def staged(df: DataFrame) -> DataFrame:
    """df, written to a table in the shared folder and read again: its lineage ends here."""
    spark = df.sparkSession
    ready(spark)
    path = shared_dir(spark)
    df.write.parquet(path)
    if _staged:
        _staged[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def tidied(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """f, whose result is staged; all other tables that it staged are deleted."""

    @functools.wraps(f)
    def run(*args, **kwargs) -> DataFrame:
        _staged.append([])
        try:
            rows = f(*args, **kwargs)
            paths, _staged[-1] = _staged[-1], []
            kept = staged(rows)
        finally:
            made = _staged.pop()
        if _staged:
            _staged[-1].extend(made)
        delete(kept.sparkSession, paths)
        return kept

    return run


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that are staged in this block are deleted at its end."""
    _staged.append([])
    try:
        yield
    finally:
        delete(spark, _staged.pop())


def delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def together(tables: list[DataFrame]) -> DataFrame:
    """The rows of staged tables with the same columns, as one table."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*[f for t in tables for f in t.inputFiles()])


def small(df: DataFrame) -> DataFrame:
    """df marked for broadcasting if it has SMALL_ROWS rows and SMALL_BYTES of texts at most, else df itself (a shuffled join)."""
    texts = [F.octet_length(f"`{c}`") for c, kind in df.dtypes if kind in ("string", "binary")]
    size = sum((F.coalesce(x, F.lit(0)) for x in texts), F.lit(0)).cast("long")
    rows, size = df.limit(SMALL_ROWS + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if rows <= SMALL_ROWS and size <= SMALL_BYTES else df


def slices(spark: SparkSession, amount: float, each: float) -> int:
    """How many partitions: `each` units in one, and no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(amount // each) + 1)


def numbered(df: DataFrame, n: int, group: list[str], order: list[str], name: str) -> DataFrame:
    """df with `name`: each row's number from 0 within its group, by `order`.

    A range exchange sorts all rows by (group, order), so a hot group spreads over many partitions;
    a row's number is then its place in its partition plus what lies in the group's earlier partitions.
    The counts that this needs have a row for each (partition, group) that meets.
    """
    keys = [F.col(c).asc_nulls_last() for c in [*group, *order]]
    laid = staged(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    laid = laid.withColumn("_part", F.shiftright("_at", 33))
    from pyspark.sql import Window

    runs = laid.groupBy("_part", *group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = staged(runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_part", *group, "_first", "_before"))
    runs = small(runs.select(F.col("_part").alias("_rp"), *[F.col(c).alias(f"_r{i}") for i, c in enumerate(group)], "_first", "_before"))
    on = F.col("_part") == F.col("_rp")
    for i, c in enumerate(group):
        on = on & F.col(c).eqNullSafe(F.col(f"_r{i}"))
    return laid.join(runs, on).withColumn(name, F.col("_before") + F.col("_at") - F.col("_first")).select(*df.columns, name)
