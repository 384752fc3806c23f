"""Benchmark decontamination: winnowed fingerprints, joined and extended to whole windows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.session import staged, together

#: Consecutive words of an item that count when a document has them too.
WINDOW = 13
#: A fingerprint hashes so many words; of each WINDOW - GRAM + 1 neighbouring ones the smallest is kept.
GRAM = 5
#: Words of benchmark items in one block: what a pass over the documents broadcasts.
BLOCK_WORDS = 500_000

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Runs of lower-cased a-z, 0-9 and anything beyond ASCII; A-Z alone is lower-cased."""
    return WORD.findall(text.translate(LOWER)) if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def grams(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive ids."""
    total = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    for i in range(n):
        total = total * STEP + mixed(ids[i : i + len(total)].astype(np.uint64) + STEP)
    return mixed(total)


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest hash of each `window` neighbours, the last of equal ones."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, at = hashes[:n].copy(), np.arange(n)
    for i in range(1, window):
        here = hashes[i : i + n]
        lower = here <= least
        least[lower] = here[lower]
        at[lower] = np.flatnonzero(lower) + i
    return np.unique(at)


class Fingerprints:
    """A block of benchmark items: fingerprints, and the windows that extend them.

    Words are numbered from 1 within the block; a word that no item has is 0. Windows of one length have a table of
    distinct windows (rows of word numbers), their hashes in order, and for each window the items that have it.
    """

    def __init__(self, items: list[tuple[object, list[str]]]):
        self.words: dict[str, int] = {}
        self.items = [i for i, _ in items]
        found: dict[int, dict[bytes, list[int]]] = {}
        prints = []
        for k, (_, words) in enumerate(items):
            ids = np.array([self.words.setdefault(w, len(self.words) + 1) for w in words], np.int32)
            n = min(WINDOW, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                found.setdefault(n, {}).setdefault(ids[i : i + n].tobytes(), []).append(k)
            if n == WINDOW:
                hashes = grams(ids, GRAM)
                prints.append(hashes[winnow(hashes, WINDOW - GRAM + 1)])
        self.prints = np.unique(np.concatenate([*prints, np.zeros(0, np.uint64)]))
        self.tables = {}
        for n, windows in found.items():
            rows = np.frombuffer(b"".join(windows), np.int32).reshape(-1, n)
            hashes = np.array([grams(r, n)[0] for r in rows], np.uint64) if len(rows) < 64 else grams_of_rows(rows)
            order = np.argsort(hashes, kind="stable")
            owners = [sorted(set(x)) for x in windows.values()]
            self.tables[n] = (hashes[order], rows[order], [np.array(owners[i]) for i in order])
            if len(np.unique(hashes)) < len(hashes):
                raise ValueError("two windows of the benchmark have one hash")  # 2^-64 for each pair

    def find(self, ids: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of candidate starts, those where a window of n words lies, and its row in the table. Compared word for word."""
        hashes, rows, _ = self.tables[n]
        own = grams_of_rows(ids[starts[:, None] + np.arange(n)]) if len(starts) else np.zeros(0, np.uint64)
        at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
        true = hashes[at] == own
        true[true] = (rows[at[true]] == ids[starts[true][:, None] + np.arange(n)]).all(axis=1)
        return starts[true], at[true]

    def probe(self, texts: list[str | None]) -> Iterator[tuple[int, list[tuple[int, int]], list]]:
        """For each text: its words, the spans of words hit (start, end), the items with windows in it."""
        words = [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in words])
        starts = np.cumsum(sizes + 1) - sizes - 1  # a 0 after each text, which no window holds
        ids = np.zeros(int(sizes.sum()) + len(words), np.int32)
        get = self.words.get
        for at, w in zip(starts, words, strict=True):
            ids[at : at + len(w)] = np.fromiter(map(get, w, repeat(0)), np.int32, len(w))
        hit = np.zeros(len(ids) + 1, np.int64)
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        for n, (_, _, owners) in self.tables.items():
            if n == WINDOW:
                hashes = grams(ids, GRAM)
                kept = winnow(hashes, WINDOW - GRAM + 1)
                shared = kept[np.isin(hashes[kept], self.prints)]
                candidates = np.unique((shared[:, None] - np.arange(WINDOW - GRAM + 1)).ravel())
            else:
                candidates = np.flatnonzero(ids[: max(0, len(ids) - n + 1)])
            candidates = candidates[(candidates >= 0) & (candidates <= len(ids) - n)]
            for i in range(0, len(candidates), 1 << 16):
                at, row = self.find(ids, candidates[i : i + (1 << 16)], n)
                np.add.at(hit, at, 1)
                np.add.at(hit, at + n, -1)
                if len(at):
                    doc = np.searchsorted(starts, at, side="right") - 1
                    seen = np.unique(np.stack([doc, row]), axis=1)
                    of = [owners[r] for r in seen[1]]
                    pairs.append((np.repeat(seen[0], [len(x) for x in of]), np.concatenate(of)))
        inside = np.diff(np.concatenate([[0], (np.cumsum(hit) > 0).astype(np.int8), [0]]))
        opened, closed = np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)
        of_span = np.searchsorted(starts, opened, side="right") - 1
        spans: list[list[tuple[int, int]]] = [[] for _ in words]
        for k, a, b in zip(of_span.tolist(), opened.tolist(), closed.tolist(), strict=True):
            spans[k].append((a - int(starts[k]), b - int(starts[k])))
        items: list[list] = [[] for _ in words]
        if pairs:
            both = np.unique(np.stack([np.concatenate(x) for x in zip(*pairs, strict=True)]), axis=1)
            for k, i in both.T.tolist():
                items[k].append(self.items[i])
        yield from zip(sizes.tolist(), spans, items, strict=True)


def grams_of_rows(rows: np.ndarray) -> np.ndarray:
    """As `grams`, of each row as a whole."""
    total = np.zeros(len(rows), np.uint64)
    for i in range(rows.shape[1]):
        total = total * STEP + mixed(rows[:, i].astype(np.uint64) + STEP)
    return mixed(total)


def united(spans: list | None) -> list[tuple[int, int]]:
    """Spans, joined where they touch or overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans or []):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[object, list[str]]]]:
    """Items in lots of about BLOCK_WORDS words: what the driver and a broadcast hold at once."""
    rows = benchmark.select("item_id", "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    lot, size = [], 0
    for r in rows.toLocalIterator():
        words = words_of(r.text)
        lot.append((r.item_id, words))
        size += len(words)
        if size >= BLOCK_WORDS:
            yield lot
            lot, size = [], 0
    yield lot


RESULT = {"n_words": pa.int64(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "items": pa.list_(pa.int64())}


def sent(docs: DataFrame, lot: list):
    return docs.sparkSession.sparkContext.broadcast(Fingerprints(lot))


def prober(sent, carry: list[str], every: bool):
    """A function of batches: `carry`'s columns with what the broadcast block's windows hit; of every row, or of those that are hit."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 200):
                part = b.slice(i, 200)
                found = list(sent.value.probe(part.column("text").to_pylist()))
                if not every:
                    hit = [k for k, r in enumerate(found) if r[1]]
                    part, found = part.take(pa.array(hit, pa.int64())), [found[k] for k in hit]
                n = pa.array([r[0] for r in found], RESULT["n_words"])
                spans = pa.array([[{"start": x, "end": y} for x, y in r[1]] for r in found], RESULT["spans"])
                items = pa.array([sorted(set(r[2])) for r in found], RESULT["items"])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), n, spans, items], names=[*carry, *RESULT])

    return probe


def annotate(docs: DataFrame, benchmark: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """docs' columns `carry` (all if None) with n_words, n_hit, spans, items, contaminated, in place of any of those names.

    Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters. Windows are the items' runs of WINDOW
    words; an item of fewer, but some, is one window. spans are the document's words that lie in an occurrence of a window,
    n_hit counts them, items are the ids of items with a window that occurs, and contaminated says that a word is hit and
    a twentieth of the words at least.

    Documents and items are winnowed alike: of each 9 neighbouring hashes of 5 words, the smallest is a fingerprint, so a
    shared run of 13 words has a shared fingerprint. Documents' fingerprints are joined with a block of the benchmark's,
    which is broadcast; each hit is extended to the windows around it, and these are compared word for word. Items of
    fewer than 13 words are looked up at each word. A benchmark of several blocks takes a pass for each over one copy of the
    texts, which writes no more than what it hits; the hits are then joined to the rows.

    Null and empty texts have no words. Items without words or id, or with a null text, have no windows. Repeated rows: a
    row each; repeated items: an id each. Very long texts are read whole. An empty benchmark hits nothing.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in (*RESULT, "n_hit", "contaminated")]
    rows = docs.select(*carry, *([] if "text" in carry else ["text"]))
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    made = [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(span)), T.StructField("items", T.ArrayType(T.LongType()))]
    lots = blocks(benchmark)
    first, second = next(lots), next(lots, None)
    if second is None:
        done = rows.mapInArrow(prober(sent(docs, first), rows.columns, True), T.StructType([*rows.schema.fields, *made]))
    else:
        row = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row")
        kept = staged(rows.select(row, "text", F.monotonically_increasing_id().alias("_key")))
        hits = []
        for lot in chain([first, second], lots):
            block = sent(docs, lot)
            hits.append(staged(kept.select("_key", "text").mapInArrow(prober(block, ["_key"], False), T.StructType([T.StructField("_key", T.LongType()), *made]))))
            block.unpersist()
        found = together(hits).groupBy(F.col("_key").alias("_of")).agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        both = kept.join(found, F.col("_key") == F.col("_of"), "left").select("_row", "text", "spans", "items")

        def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n = pa.array([len(words_of(t)) for t in b.column("text").to_pylist()], RESULT["n_words"])
                spans = pa.array([[{"start": x, "end": y} for x, y in united(s)] for s in b.column("spans").to_pylist()], RESULT["spans"])
                items = pa.array([x or [] for x in b.column("items").to_pylist()], RESULT["items"])
                yield pa.RecordBatch.from_arrays([b.column("_row"), n, spans, items], names=["_row", *RESULT])

        done = both.mapInArrow(unite, T.StructType([kept.schema["_row"], *made]))
        done = done.select(*[F.col("_row").getField(c).alias(c) for c in rows.columns], *RESULT)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"])
    done = done.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    return done.select(*carry, "n_words", "n_hit", "spans", "items", "contaminated")


def digests(annotated: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    joined = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return annotated.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), "contaminated")
