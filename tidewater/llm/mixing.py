"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.session import numbered, slices, small, staged, tidied

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, share: float, weights: tuple[float, ...], most: float) -> DataFrame:
    """totals(source, source_size) with `target`.

    Sources in order of code points, null last, weigh weights[0], weights[1], ..., repeating. They share `share` times
    all sizes; none gets more than `most` times its size, and what that leaves is shared by weight among the rest.
    With sources ordered by how soon they reach their bound (bound / weight), the level at which sharing stops is that
    of the first source that stays below its bound when all before it have reached theirs.
    The table has one row for each source, and only that table meets in one task.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    rows = totals.withColumn("weight", weight).withColumn("bound", F.col("source_size") * F.lit(float(most)))
    rows = rows.withColumn("ratio", F.col("bound") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    level = (budget - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    rows = rows.withColumn("level", level)
    stop = F.min(F.when(F.col("level") <= F.col("ratio") * (1 + 1e-12), F.struct("ratio", "level"))).over(everything)["level"]
    return rows.withColumn("target", F.least("bound", stop * F.col("weight"))).select("source", "source_size", "target")


def offset(source: Column, seed: int) -> Column:
    """The source's random number in [0, 1), a multiple of 2^-20: exact beside integers below 2^33."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\u0000null"))).cast("binary")), 1, 5)
    return F.conv(digits, 16, 10).cast("double") / (1 << 20)


@tidied
def mix(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (5, 2, 1), most: float = 2.0, seed: int = 0) -> DataFrame:
    """One row for each row of docs(doc_id, text, source): doc_id, source, size, source_size, target, copies, taken.

    Each document of a source is expected target / source_size times. Within a source the documents stand in order of
    (size, doc_id, hash of the text); their expected copies are summed along that order, one random offset is added, and a document is
    taken once for each integer that its interval crosses. Neighbours have like sizes, so the words taken differ from
    the target by no more than the source's largest size. The same rows give the same result, in any partitioning.

    Null text: size 0. Null source: a source of its own, last. Null doc_id: last among equal sizes. Repeated rows are
    documents of their own. A source without words: target 0, no copies. An empty table: no rows. Other columns of docs
    play no part, whatever their names.
    """
    base = staged(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("_h")))
    rows = placed(base, share, weights, most, seed)
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def placed(base: DataFrame, share: float, weights: tuple[float, ...], most: float, seed: int) -> DataFrame:
    """base(doc_id, source, size, _h, ...), a written table, with source_size, target and copies."""
    spark = base.sparkSession
    totals = staged(base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")))
    n = slices(spark, totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], 2_000_000)
    goal = small(staged(targets(totals.drop("n"), share, weights, most)).withColumnRenamed("source", "_source"))
    rows = numbered(base, n, ["source"], ["size", "doc_id", "_h"], "_i").join(goal, F.col("source").eqNullSafe(F.col("_source")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = F.floor(rate * (F.col("_i") + 1) + F.col("_u")) - F.floor(rate * F.col("_i") + F.col("_u"))
    return rows.withColumn("_u", offset(F.col("source"), seed)).withColumn("copies", F.least(crossed, F.ceil(F.lit(float(most)))).cast("long"))


def keyed(docs: DataFrame) -> DataFrame:
    """docs with _file and _place, which name a row in the files that docs reads; if docs reads no files, in a table written here."""
    try:
        rows = docs.select("*", F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    except AnalysisException:
        return staged(docs.select("*", F.lit(0).cast("long").alias("_file"), F.monotonically_increasing_id().alias("_place")))
    files = docs.select(F.col("_metadata.file_path").alias("p")).distinct().agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.xxhash64("p")).alias("m")).first()
    return rows if files.n == files.m else staged(rows.withColumn("_place", F.monotonically_increasing_id()))


def mixed(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (5, 2, 1), most: float = 2.0, seed: int = 0) -> DataFrame:
    """docs with each row as often as `mix` takes it, row by row: rows that share a doc_id, or have none, are documents of
    their own. A row is joined with its copies by its place in the files that docs reads (see `keyed`), so no key is hot, and
    its columns travel in one struct, whatever their names. Nulls, empty texts and empty tables: as in `mix`."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = keyed(docs.select(row, "doc_id", "source", "text"))
    base = staged(rows.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("_h"), "_file", "_place"))
    copies = placed(base, share, weights, most, seed).where("copies > 0").select(F.col("_file").alias("_f"), F.col("_place").alias("_a"), "copies")
    again = rows.select("_row", "_file", "_place").join(copies, (F.col("_file") == F.col("_f")) & (F.col("_place") == F.col("_a")))
    return again.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


ORACLE = r"""
WITH base AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM totals),
bound AS (SELECT *, source_size * 2.0::DOUBLE AS bound, source_size * 2.0::DOUBLE / weight AS ratio FROM weighed),
levels AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
    - coalesce(sum(bound) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM bound),
stop AS (SELECT level AS stop FROM levels WHERE level <= ratio * (1 + 1e-12::DOUBLE) ORDER BY ratio, level LIMIT 1),
goal AS (SELECT source, source_size, least(bound, stop * weight) AS target,
    CAST(('0x' || substr(md5('0:' || coalesce(source, chr(0) || 'null')), 1, 5)) AS BIGINT)::DOUBLE / 1048576 AS u FROM levels, stop),
placed AS (SELECT b.doc_id, b.size, g.source_size, g.target, g.u,
    CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0::DOUBLE END AS rate,
    row_number() OVER (PARTITION BY b.source ORDER BY b.size, b.doc_id NULLS LAST) AS i
  FROM base b JOIN goal g ON b.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  CAST(least(floor(rate * i + u) - floor(rate * (i - 1) + u), 2) AS BIGINT) * size AS taken FROM placed
"""
