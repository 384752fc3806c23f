"""A corpus made ready for training: five stages, each an operator of tidewater.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import decontamination, jaccard_join, language_id, mixing, sharding
from tidewater.llm.queries import PIECES, vocabulary
from tidewater.llm.session import read, small, staged, tidied

SHARDS = 16


def packed(docs: DataFrame, used: list[str]) -> DataFrame:
    """docs with all columns but `used` in one, _rest, so that no operator's own columns meet them."""
    rest = [c for c in docs.columns if c not in used]
    return docs.select(*used, (F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(None).cast("struct<_none:int>")).alias("_rest"))


def unpacked(rows: DataFrame, docs: DataFrame, used: list[str]) -> DataFrame:
    return rows.select(*[F.col(f"`{c}`") if c in used else F.col("_rest").getField(c).alias(c) for c in docs.columns])


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; texts that are null or have no letter go. Repeated rows each stay or go. An empty
    table, or one without languages to learn: no rows."""
    used = ["doc_id", "text", "lang"]
    found = language_id.identify(packed(docs, used), vocabulary(PIECES), carry=True)
    return unpacked(found.where(F.col("lang_pred") != language_id.UND), docs, used)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id. Of rows that share a doc_id the
    first by text stays, a null text counting as empty. Documents without doc_id stay. An empty table: no rows."""
    columns, docs = docs, packed(docs, ["doc_id", "text"])
    groups = jaccard_join.join(docs)
    gone = small(staged(groups.where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()))
    kept = docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
    repeated = staged(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("_again")))
    if not repeated.isEmpty():
        again = small(repeated)
        rest = kept.join(again, F.col("doc_id") == F.col("_again"), "left_semi")
        one = rest.groupBy(F.col("doc_id").alias("_id")).agg(F.min_by(F.struct("doc_id", "text", "_rest"), F.coalesce("text", F.lit(""))).alias("_row")).select("_row.*")
        kept = kept.join(again, F.col("doc_id") == F.col("_again"), "left_anti").unionByName(one)
    return unpacked(kept, columns, ["doc_id", "text"])


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates. Null texts are clean, repeated rows each stay or go. An empty table: no rows."""
    used = ["text"]
    found = decontamination.annotate(packed(docs, used), read(spark, sf_dir, "benchmark"))
    return unpacked(found.where(~F.col("contaminated")), docs, used)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, up to twice, row by row. An empty table: no rows."""
    return mixing.mixed(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each row; equal texts share a shard. An empty table: no rows."""
    return sharding.shard(docs, SHARDS)


STAGES = [("language ID", languages), ("n-gram Jaccard join", near_duplicates), ("decontamination", without_benchmarks), ("mixing", mixed), ("sharding", sharded)]

#: None: language identification has no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


@tidied
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
