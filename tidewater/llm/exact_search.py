"""Exact search for the highest inner products, by MaxScore."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.session import staged, tidied, together

#: Bytes of the vectors of one block of queries: what the driver holds and a pass over the rows broadcasts, one at a time.
BLOCK_BYTES = 16 << 20
#: Rows in a shard's stretch of postings that is traversed at once.
STRETCH = 8192


def usable(vector: Column) -> Column:
    """Neither null nor with a component that is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def quantised(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long"))


def matrix(column: pa.Array, dims: int | None = None) -> np.ndarray:
    """Rows of integers, filled with 0 up to `dims` or the longest."""
    sizes = np.diff(column.offsets.to_numpy())
    width = max(dims or 0, int(sizes.max(initial=0)))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.zeros((len(sizes), width), np.int64)
    rows[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return rows


class Shard:
    """MaxScore over the rows of one task, a stretch at a time.

    A dimension is a term, and its postings are the stretch's column. For a query, a term adds at most the larger of
    weight * highest and weight * lowest value of the column. Terms are ordered by how far their postings can spread the
    scores; the first of them are essential, and the rest are those whose summed bounds cannot lift a row that has
    nothing else above the query's k-th score so far. Essential postings are traversed for all rows; the others are
    probed, in shrinking groups, for the rows that are still competitive: score so far plus the bounds of what is left
    reaches the k-th score. A row that ties with it is kept, so ties go to the smaller id.
    """

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]
        self.probed = 0

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        queries, dims = self.queries, max(self.queries.shape[1], rows.shape[1])
        queries, rows = (np.pad(x, ((0, 0), (0, dims - x.shape[1]))) for x in (queries, rows))
        bound = np.abs(queries.astype(float)).max(initial=0) * np.abs(rows.astype(float)).max(initial=0) * max(dims, 1)
        kind = np.float64 if bound < 2**52 else np.int64 if bound < 2**62 else object  # where sums of products are exact
        columns = np.ascontiguousarray(rows.T.astype(kind))
        low, high = columns.min(axis=1, initial=0), columns.max(axis=1, initial=0)
        for q in range(len(self.ids)):
            weights = queries[q].astype(kind)
            ends = np.stack([weights * low, weights * high])
            most, spread = ends.max(axis=0), np.abs(ends[1] - ends[0])
            order = np.argsort(-spread, kind="stable")
            left = np.concatenate([np.cumsum(most[order][::-1])[::-1], [0]])  # bound of the terms from here on
            got = self.best[q]
            floor_ = got[0][-1] if len(got[0]) == self.k else None
            essential = dims if floor_ is None else min(dims, int(np.searchsorted(-left, -floor_, side="right")))
            first = order[:essential]
            scores = weights[first] @ columns[first]
            live, at = np.arange(len(ids)), essential
            while at < dims:
                keep = scores + left[at] >= floor_
                live, scores = live[keep], scores[keep]
                if not len(live):
                    break
                group = order[at : at + 8]
                scores = scores + weights[group] @ columns[np.ix_(group, live)]
                self.probed += len(live)
                at += len(group)
            if floor_ is not None:
                keep = scores >= floor_
                live, scores = live[keep], scores[keep]
            own = ids[live] != self.ids[q]
            live, scores = live[own], np.clip(scores[own], -(2**63), 2**63 - 1).astype(np.int64) if kind is object else scores[own].astype(np.int64)
            if len(live):
                s, v = np.concatenate([got[0], scores]), np.concatenate([got[1], ids[live]])
                if len(s) > 4 * self.k:
                    reach = -np.partition(-s, self.k - 1)[self.k - 1]
                    s, v = s[s >= reach], v[s >= reach]
                top = np.lexsort((v, -s))[: self.k]
                self.best[q] = s[top], v[top]


@tidied
def search(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """For each row of vectors(vec_id, embedding) whose vec_id is divisible by `every`: the k rows with the highest integer
    inner product, components being floor(256 * x). Columns query_id, rank (from 1), vec_id, score; ties go to the smaller
    vec_id. Exact.

    Queries go in blocks of BLOCK_BYTES, one pass over the rows each: a block is broadcast, its shards' results are written,
    and the broadcast is gone before the next. A task is a shard: it finds the k best of its rows for each query of the
    block by MaxScore (see `Shard`), and shards are merged by query.

    Rows with a null vec_id, a null vector or a component that is null or not finite take no part. A query's own row is
    any row of its vec_id. A repeated vec_id asks once (with its greatest vector) and is found as often as it is there.
    Vectors of fewer components are filled with 0. Components
    and scores beyond a long are its ends. Fewer than k candidates: all of them. No rows, no result. Other columns
    play no part.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v"))
    asked = staged(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.max("v").alias("v")))
    n, dims = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    blocks = -(-n * 8 * max(dims, 1) // BLOCK_BYTES)
    block = F.pmod(F.xxhash64("vec_id"), F.lit(max(blocks, 1)))
    found = []
    for i in range(blocks):
        own = asked.where(block == i).orderBy("vec_id").toArrow().combine_chunks()
        if not own.num_rows:
            continue
        sent = spark.sparkContext.broadcast((own.column("vec_id").to_numpy(), matrix(pa.concat_arrays(own.column("v").chunks))))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            shard = Shard(*sent.value, k)
            for b in batches:
                for j in range(0, len(b), STRETCH):
                    part = b.slice(j, STRETCH)
                    shard.add(part.column(0).to_numpy(), matrix(part.column(1)))
            kept = [len(s) for s, _ in shard.best]
            if sum(kept):
                columns = [np.repeat(shard.ids, kept), np.concatenate([v for _, v in shard.best]), np.concatenate([s for s, _ in shard.best])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

        found.append(staged(rows.mapInArrow(scan, "query_id long, vec_id long, score long")))
        sent.unpersist()
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = together(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = r"""
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM rows q JOIN rows c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
