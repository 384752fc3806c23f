"""Similarity join on word shingles: PartEnum signatures, exact checks, components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.session import slices, small, staged, tidied

#: Words of a shingle, and the similarity that links: 100 * common >= PERCENT * union.
SHINGLE = 5
PERCENT = 75
#: Numbers of tries to find a partition that fills enough parts.
LEVELS = 6
#: A part of the domain has three sub-parts; each two of them are a subset that makes a signature.
SUBSETS = np.array([[0, 1], [0, 2], [1, 2]])
#: Signatures that a task holds before it passes them on, and that lie in one bucket.
HELD, BUCKET = 400_000, 400_000
#: One document in SAMPLED helps to find common signatures: those that COMMON of them have, the COMMONEST at most.
#: This only decides an order, in which no link is lost; see `signatures`.
SAMPLED, COMMON, COMMONEST = 32, 3, 200_000
#: A signature that so many documents have, by the sample, is dealt to several buckets.
HOT = 75_000
#: Members of open groups in one bucket; members, and bytes of their sketches, of one group that a block holds; the
#: largest groups that are compared side by side.
MEMBERS, GROUP, SKETCHES, FEW = 40_000, 6_000, 1 << 23, 128
#: Classes, and elements of their sets, of one component that a block holds.
BLOCK, ELEMENTS = 2_000, 1_000_000
#: Bytes of text that are read at once, but for a longer text; and bytes of sketches that are compared at once.
AT_ONCE, COMPARED = 1 << 20, 1 << 22

STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A number for each byte, and the powers of STEP by which a byte's place counts.
BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * STEP)
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP ** i and STEP ** -i for i < n, modulo 2 ** 64."""
    up, inverse = np.full(n, STEP), np.full(n, pow(int(STEP), -1, 1 << 64), np.uint64)
    up[0] = inverse[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(inverse)


def shingles_of(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The set of each text as sorted hashes: its runs of SHINGLE words, or all its words as one if it has fewer.
    A word is bytes without white space, A-Z lower-cased."""
    raw = [t.encode().lower() if t else b"" for t in texts]
    lot: list[bytes] = []
    size = 0
    for r in raw:
        if lot and size + len(r) > AT_ONCE:
            yield from sets_in(lot)
            lot, size = [], 0
        lot.append(r)
        size += len(r) + 1
    if lot:
        yield from sets_in(lot)


def sets_in(lot: list[bytes]) -> Iterator[np.ndarray]:
    data = np.frombuffer(b" ".join([b"", *lot, b""]), np.uint8)
    up, down = powers(1 << max(20, len(data).bit_length()))
    gap = SPACE[data]
    starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1, np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    sums = np.cumsum(BYTES[data] * up[: len(data)])
    words = mixed((sums[ends - 1] - sums[starts - 1]) * down[starts] + (ends - starts).astype(np.uint64))
    begins = np.cumsum([1, *(len(r) + 1 for r in lot)])
    first = np.searchsorted(starts, begins)
    rolled = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
    for i in range(SHINGLE):
        rolled = rolled * STEP + words[i : i + len(rolled)]
    rolled = mixed(rolled + np.uint64(SHINGLE))
    for a, z in zip(first.tolist(), first[1:].tolist(), strict=False):
        if z - a >= SHINGLE:
            yield np.unique(rolled[a : z - SHINGLE + 1])
        elif z == a:
            yield np.zeros(0, np.uint64)
        else:
            total = np.zeros(1, np.uint64)
            for w in words[a:z]:
                total = total * STEP + w
            yield mixed(total + np.uint64(z - a))


def shingles(text: str | None) -> np.ndarray:
    return next(shingles_of([text]))


def digest(hashes: np.ndarray) -> tuple[int, int]:
    """Two halves of a hash of the set."""
    return tuple(np.frombuffer(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest(), np.int64).tolist())


@lru_cache(maxsize=None)
def band(t: int) -> tuple[int, int]:
    """Sizes of the t-th band, the smaller set's: [1, 1], [2, 3], [4, 6], ..."""
    low = 1 if t == 0 else band(t - 1)[1] + 1
    return low, low * 3 // 2


def largest_partner(size: int) -> int:
    return size * 100 // PERCENT


@lru_cache(maxsize=None)
def instances(size: int) -> tuple[int, ...]:
    """The bands whose sets, as the smaller of a pair, may link with a set of this size."""
    found, t = [], 0
    while band(t)[0] <= size:
        if size <= largest_partner(band(t)[1]):
            found.append(t)
        t += 1
    return tuple(found)


@lru_cache(maxsize=None)
def parts(t: int) -> tuple[int, int]:
    """(parts of the domain, most elements in which a linked pair of the band differs).

    common >= PERCENT / (100 + PERCENT) * (a + b), so a pair differs in (a + b) * (100 - PERCENT) / (100 + PERCENT) at most.
    There are enough parts that a set of the band's least size very likely has more signatures than so many elements spoil.
    """
    low, high = band(t)
    apart = (high + largest_partner(high)) * (100 - PERCENT) // (100 + PERCENT)
    n = apart // 2 + 1
    while n < 4 * low + 4:
        empty = (1 - 1 / (3 * n)) ** low
        one = 3 * (1 - empty) * empty**2
        several = 1 - one - empty**3
        if 3 * n * several + 2 * n * one - spoilt(apart, n * one, n * several) >= 1 + 2 * (3 * n * empty * (1 - empty)) ** 0.5:
            break
        n += 1
    return n, apart


def spoilt(apart: int, one: float, several: float) -> float:
    """Most signatures that `apart` differing elements change, of a set that has elements in one sub-part of so many
    parts (two signatures each) and in two or three of so many others (three): a part's first element spoils two."""
    return 2 * min(apart, one + several) + min(max(0, apart - one - several), several)


def signatures(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray] | None = None, every: bool = False) -> np.ndarray:
    """PartEnum signatures of a set: two linked sets share one at least.

    For each band that the set may meet a partner in, the domain is dealt by hash into parts and these into three
    sub-parts; what the set has in two sub-parts of a part is a signature, for each subset of two. A linked pair differs in
    no more than `apart` elements, which can change no more than `spoilt` of a set's signatures; so the first that both
    have, in any order that both follow, is among each one's first `spoilt` + 1. Only those are kept, in an order that
    puts `common` signatures (hashes in order, how common each is) last: what many documents share, such as a passage,
    then brings few of them together, and no link is lost.
    A set that has no more signatures than can be spoilt is dealt again by another hash. Of a linked pair it is enough that
    one has more; two that both do not meet in the next deal, or after LEVELS deals by their empty signatures, too.
    """
    out = []
    for t in instances(len(hashes)):
        n, apart = parts(t)
        for level in range(LEVELS):
            seed = np.uint64((t * LEVELS + level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            x = np.sort(mixed(hashes ^ seed))
            sub = (((x >> np.uint64(32)) * np.uint64(3 * n)) >> np.uint64(32)).astype(np.int64)
            starts = np.flatnonzero(np.concatenate([[True], sub[1:] != sub[:-1]]))
            held = np.zeros(3 * n, np.uint64)
            held[sub[starts]] = mixed(np.add.reduceat(mixed(x + STEP), starts))
            full = np.zeros(3 * n, bool)
            full[sub[starts]] = True
            held, full = held.reshape(n, 3), full.reshape(n, 3)
            name = np.arange(3 * n, dtype=np.uint64).reshape(n, 3) * STEP ^ seed
            made = mixed(held[:, SUBSETS[:, 0]] * STEP + held[:, SUBSETS[:, 1]] + name)
            some = full[:, SUBSETS].any(axis=2)
            found, filled = made[some], full.sum(axis=1)
            most = int(spoilt(apart, int((filled == 1).sum()), int((filled > 1).sum())))
            if len(found) > most:
                found = np.sort(found)
                if common is not None and len(common[0]):
                    at = np.minimum(np.searchsorted(common[0], found), len(common[0]) - 1)
                    weight = np.where(common[0][at] == found, common[1][at], 0)
                    found = found[np.argsort(weight, kind="stable")]
                out.append(found if every else found[: most + 1])
                break
            out.append(found)
        else:
            out.append(mixed(name[~some]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sketch(hashes: np.ndarray) -> bytes:
    """Whether each part of the domain holds an odd number of the set's elements, a bit for each of two to four times as
    many parts as elements (a power of two, 64 at least). A part is the hash's last bits, so halves can be folded."""
    parts_ = 1 << max(6, (2 * len(hashes) - 1).bit_length())
    part = (mixed(hashes * STEP) & np.uint64(parts_ - 1)).astype(np.int64)
    return np.packbits((np.bincount(part, minlength=parts_) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(raw: list[bytes], width: int) -> np.ndarray:
    """Sketches of one length as rows of `width` bytes: what lies beyond is added, bit by bit."""
    rows = np.frombuffer(b"".join(raw), np.uint64).reshape(len(raw), -1, width // 8)
    return rows[:, 0] if rows.shape[1] == 1 else np.bitwise_xor.reduce(rows, axis=1)


def apart_at_least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A lower bound of the elements in which sets differ, from rows of their sketches: parts that differ."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def near_sketches(m: np.ndarray, n: np.ndarray, x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Whether the sets of sizes m and n with sketches x and y may link, pair by pair."""
    keep = may_link(m, n, np.zeros(len(m), np.int64))
    sizes = np.array([[len(a), len(b)] for a, b in zip(x, y, strict=True)]).reshape(-1, 2)
    for kind in np.unique(sizes[keep], axis=0):
        at, width = np.flatnonzero(keep & (sizes == kind).all(axis=1)), int(kind.min())
        each = max(1, COMPARED // width)
        for i in range(0, len(at), each):
            part = at[i : i + each]
            keep[part] = may_link(m[part], n[part], apart_at_least(folded([x[k] for k in part], width), folded([y[k] for k in part], width)))
    return keep


def may_link(m: np.ndarray, n: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes may link when they differ in so many elements: common = (m + n - apart) / 2."""
    return (100 * np.minimum(m, n) >= PERCENT * np.maximum(m, n)) & (apart * (100 + PERCENT) <= (m + n) * (100 - PERCENT))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def sets_of(docs: DataFrame) -> DataFrame:
    """doc_id, n, h1, h2, sketch for each row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 250):
                part = b.slice(i, 250)
                rows = [(len(h), *digest(h), sketch(h)) for h in shingles_of(part.column(1).to_pylist())]
                made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], names=["doc_id", "n", "h1", "h2", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n long, h1 long, h2 long, sketch binary")


def common_signatures(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most common signatures of a sample, as `signatures` takes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 250):
                found = [signatures(h, every=True) for h in shingles_of(b.column(0).slice(i, 250).to_pylist())]
                values, n = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], names=["sig", "n"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0).select("text")
    found = sample.mapInArrow(run, "sig long, n long").groupBy("sig").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    top = found.orderBy(F.desc("n"), "sig").limit(COMMONEST).toPandas().sort_values("sig", key=lambda x: x.astype(np.int64).to_numpy().view(np.uint64))
    return top["sig"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)


def meeting(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], buckets: int) -> DataFrame:
    """(sig, doc_id) of signatures that different documents have.

    A task keeps the first of its documents with the same set, and packs signatures by bucket: 5 bytes and the id each.
    A bucket has about BUCKET signatures, whatever the number of documents. A signature that HOT documents have, by the
    sample, goes to as many buckets as it fills, below 0; nothing is left out there, as others have it for certain.
    """
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def own(sig: np.ndarray) -> np.ndarray:
        return ((sig & np.uint64(0xFFFFFF)) % np.uint64(buckets)).astype(np.int64)

    def pack(ids: list[int], found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        sig, who = np.concatenate(found), np.repeat(np.array(ids, np.int64), [len(x) for x in found])
        bucket = own(sig)
        hot, often = sent.value[0], sent.value[1] * SAMPLED // HOT
        if (often > 0).any():
            at = np.minimum(np.searchsorted(hot, sig), len(hot) - 1)
            spread = np.where(hot[at] == sig, often[at], 0).astype(np.uint64)
            salt = mixed(who.view(np.uint64) + STEP) % np.maximum(spread, np.uint64(1))
            bucket = np.where(spread > 0, -1 - own(mixed(sig + salt * STEP)), bucket)
        order = np.argsort(bucket, kind="stable")
        sig, who, bucket = sig[order], who[order], bucket[order]
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        for a, z in zip(starts, [*starts[1:], len(sig)], strict=True):
            planes = sig[a:z].view(np.uint8).reshape(-1, 8)[:, 3:].T.tobytes() + who[a:z].view(np.uint8).reshape(-1, 8).T.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([int(bucket[a])]), pa.array([planes], pa.binary())], names=["bucket", "packed"])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        ids, found, held = [], [], 0
        slices_ = (b.slice(i, 250) for b in batches for i in range(0, len(b), 250))
        for b in slices_:
            for doc_id, h in zip(b.column(0).to_pylist(), shingles_of(b.column(1).to_pylist()), strict=True):
                if not len(h) or (key := hashlib.blake2b(h.tobytes(), digest_size=16).digest()) in seen:
                    continue
                seen.add(key)
                ids.append(doc_id)
                found.append(signatures(h, sent.value))
                held += len(found[-1])
                if held >= HELD:
                    yield from pack(ids, found)
                    ids, found, held = [], [], 0
        if ids:
            yield from pack(ids, found)

    def meet(table: pa.Table) -> pa.Table:
        bucket, sigs, ids = table.column("bucket")[0].as_py(), [], []
        for packed in table.column("packed").to_pylist():
            n = len(packed) // 13
            planes = np.frombuffer(packed, np.uint8).reshape(13, n)
            sig = np.zeros((n, 8), np.uint8)
            sig[:, :5] = planes[:5].T
            sigs.append(sig.view(np.uint64).ravel())
            ids.append(np.ascontiguousarray(planes[5:].T).view(np.int64).ravel())
        sig, who = np.concatenate(sigs), np.concatenate(ids)
        order = np.lexsort((who, sig))
        sig, who = sig[order], who[order]
        new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (who[1:] != who[:-1])])
        sig, who = sig[new], who[new]
        same = sig[1:] == sig[:-1]
        kept = np.concatenate([same, [False]]) | np.concatenate([[False], same]) | (bucket < 0)
        name = sig[kept].view(np.int64) * buckets + own(sig[kept])
        return pa.table({"sig": name, "doc_id": who[kept]})

    packed = docs.mapInArrow(sign, "bucket long, packed binary")
    return packed.groupBy("bucket").applyInArrow(meet, "sig long, doc_id long")


def near_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of the pairs(u, v) of classes that may link by their sketches."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, n, x, y = b.column(2).to_numpy(), b.column(3).to_numpy(), b.column(4).to_pylist(), b.column(5).to_pylist()
            keep = pa.array(near_sketches(m, n, x, y))
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in b.columns[:2]], names=["u", "v"])

    left = classes.select(F.col("cls").alias("u"), F.col("n").alias("m"), F.col("sketch").alias("x"))
    right = classes.select(F.col("cls").alias("v"), "n", F.col("sketch").alias("y"))
    near = pairs.join(left, "u").join(right, "v").where(f"100 * least(m, n) >= {PERCENT} * greatest(m, n)").select("u", "v", "m", "n", "x", "y")
    return near.mapInArrow(sketched, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(id, label): for each id in links(u, v), the smallest id that it reaches. Links are pointed at ever smaller
    neighbours, the large ones and then the small ones of each id, until nothing changes; each round is written."""

    def pointed(edges: DataFrame, larger: bool) -> DataFrame:
        near = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))) if larger else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "w")
        moved = near.join(least, F.col("u") == F.col("w"))
        if larger:
            moved = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
        return moved.where("u <> v").distinct()

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = staged(links.where("u <> v").select("u", "v").distinct())
    was, now = None, state(edges)
    while was != now:
        edges = staged(pointed(staged(pointed(edges, True)), False))
        was, now = now, state(edges)
    return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("label"))


class Sketches:
    """Sketches of several lengths, as rows of each length, so that pairs of rows can be compared at the shorter one's."""

    def __init__(self, raw: list[bytes], n: np.ndarray):
        self.n, self.width, self.bits, self.place = n, np.array([len(x) for x in raw]), {}, {}
        for w in np.unique(self.width).tolist():
            own, twice = np.flatnonzero(self.width == w), np.flatnonzero(self.width == 2 * w)
            self.bits[w] = np.concatenate([folded([raw[k] for k in part], w) for part in (own, twice) if len(part)])
            self.place[w] = np.zeros(len(raw), np.int64)
            self.place[w][own], self.place[w][twice] = np.arange(len(own)), np.arange(len(twice)) + len(own)

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the sets a[i] and b[i] may link. Sizes that may link have lengths that are equal or one twice the other."""
        keep = may_link(self.n[a], self.n[b], np.zeros(1, np.int64))
        at = np.minimum(self.width[a], self.width[b])
        for w in np.unique(at[keep]).tolist():
            of = np.flatnonzero(keep & (at == w))
            each = max(1, COMPARED // w)
            for k in range(0, len(of), each):
                x, y = a[of[k : k + each]], b[of[k : k + each]]
                keep[of[k : k + each]] = may_link(self.n[x], self.n[y], apart_at_least(self.bits[w][self.place[w][x]], self.bits[w][self.place[w][y]]))
        return keep


def joined(parent: np.ndarray, a: int, b: int) -> None:
    """Joins a's and b's trees; a parent is never larger than its child."""
    while parent[a] != a:
        parent[a] = a = parent[parent[a]]
    while parent[b] != b:
        parent[b] = b = parent[parent[b]]
    parent[max(a, b)] = min(a, b)


def roots(parent: np.ndarray, of: np.ndarray) -> np.ndarray:
    while (of != (above := parent[of])).any():
        of = above
    return of


def merged(root: np.ndarray, i: int, others: np.ndarray) -> None:
    """root[x] is the smallest member of x's component; i is joined with the others."""
    found = np.unique(np.append(root[others], root[i]))
    if len(found) > 1:
        root[np.isin(root, found)] = found[0]


def across(members: DataFrame, n_buckets: int) -> DataFrame:
    """Pairs (u, v) of labels of members(sig, cls, label, n, sketch) that join all labels of which two members share a
    signature and may link by their sketches: the smallest label that a label reaches in its bucket, so no more rows than labels.

    Buckets hold small groups. A group of more than GROUP members, or SKETCHES bytes, is dealt into blocks, and each pair
    of its blocks is a task's."""

    def compare(table: pa.Table) -> pa.Table:
        order = np.lexsort((table.column("label").to_numpy(), table.column("sig").to_numpy()))
        sig, cls, label, n = (table.column(c).to_numpy()[order] for c in ("sig", "cls", "label", "n"))
        _, first, who = np.unique(cls, return_index=True, return_inverse=True)
        sets = Sketches(table.column("sketch").take(pa.array(order[first])).to_pylist(), n[first])
        names, of = np.unique(label, return_inverse=True)
        parent = np.arange(len(names))
        starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        ends = np.append(starts[1:], len(sig))
        live = np.flatnonzero(np.repeat(ends - starts <= FEW, ends - starts))
        for step in range(1, FEW):
            live = live[live + step < len(sig)]
            live = live[sig[live + step] == sig[live]]  # pairs `step` apart in each signature's members
            i = live[of[live] != of[live + step]]
            for a, b in np.unique(np.stack([of[i], of[i + step]])[:, sets.near(who[i], who[i + step])], axis=1).T.tolist():
                joined(parent, a, b)
        for a, z in zip(starts[ends - starts > FEW].tolist(), ends[ends - starts > FEW].tolist(), strict=True):
            here, local = np.unique(roots(parent, of[a:z]), return_inverse=True)
            tree, members_ = np.arange(len(here)), who[a:z]
            k, step = 0, 1
            while k < len(local) - 1:
                root = roots(tree, local)
                if not root.any():
                    break
                i, j = np.nonzero((root[k : k + step, None] != root[None, k:]) & (np.arange(len(local) - k) > np.arange(len(root[k : k + step]))[:, None]))
                near = sets.near(members_[k + i], members_[k + j])
                for x, y in np.unique(np.stack([root[k + i[near]], root[k + j[near]]]), axis=1).T.tolist():
                    joined(tree, x, y)
                k, step = k + step, min(64, 2 * step)
            for k, x in enumerate(roots(tree, np.arange(len(here))).tolist()):
                if x != k:
                    joined(parent, here[k], here[x])
        root = roots(parent, np.arange(len(names)))
        moved = np.flatnonzero(root != np.arange(len(names)))
        return pa.table({"u": names[root[moved]], "v": names[moved]})

    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / GROUP), F.ceil(F.sum(F.octet_length("sketch")) / SKETCHES))
    large = small(staged(members.groupBy("sig").agg(blocks.alias("g")).where("g > 1").withColumnRenamed("sig", "_sig")))
    own = members.join(large, F.col("sig") == F.col("_sig"), "left").withColumn("g", F.coalesce("g", F.lit(1)))
    own = own.withColumn("part", F.pmod(F.xxhash64("cls"), "g"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1))).where("g = 1 OR part <> other")
    dealt = dealt.withColumn("bucket", F.when(F.col("g") > 1, F.col("sig")).otherwise(F.pmod(F.xxhash64("sig"), F.lit(n_buckets))))
    dealt = dealt.select("sig", "cls", "label", "n", "sketch", (F.col("g") > 1).alias("alone"), "bucket", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    return dealt.groupBy("alone", "bucket", "lo", "hi").applyInArrow(compare, "u long, v long").distinct()


def linked_within(classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(cls, n_links, low) of classes(cls, h1, h2, rep, n, label), a row for each class and block that it meets: how many classes of its label it
    links with there, exactly, and the smallest class that these links reach.

    A label's classes are dealt into blocks, and each pair of its blocks is a task's: what its classes have in common is
    counted element by element. Small labels share a task."""
    spark = classes.sparkSession
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / ELEMENTS))
    large = small(staged(classes.groupBy("label").agg(blocks.alias("g")).where("g > 1").withColumnRenamed("label", "_label")))
    n_buckets = slices(spark, classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], ELEMENTS)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 100):
                found = list(shingles_of(b.column(0).slice(i, 100).to_pylist()))
                keys = [digest(h) for h in found]
                made = [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([h.tobytes() for h in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(made, names=["_1", "_2", "hashes"])

    involved = small(staged(classes.select(F.col("rep").alias("_id")).distinct()))
    chosen = texts.join(involved, F.col("doc_id") == F.col("_id"), "left_semi").select("text")
    chosen = chosen.mapInArrow(sets, "_1 long, _2 long, hashes binary").groupBy("_1", "_2").agg(F.first("hashes").alias("hashes"))
    own = classes.join(large, F.col("label") == F.col("_label"), "left").join(chosen, (F.col("h1") == F.col("_1")) & (F.col("h2") == F.col("_2")))
    g = F.coalesce("g", F.lit(1))
    own = own.select("cls", "label", "hashes", F.pmod("h2", g).alias("part"), g.alias("g"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
    dealt = dealt.withColumn("bucket", F.when(F.col("g") > 1, F.col("label")).otherwise(F.pmod(F.xxhash64("label"), F.lit(n_buckets))))
    dealt = dealt.select("cls", "label", "hashes", "part", (F.col("g") > 1).alias("alone"), "bucket", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))

    def count(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.lexsort((table.column("cls").to_numpy(), table.column("label").to_numpy()))))
        cls, label, part, raw = table.column("cls").to_numpy(), table.column("label").to_numpy(), table.column("part").to_numpy(), table.column("hashes").to_pylist()
        split = table.column("lo")[0].as_py() != table.column("hi")[0].as_py()
        n = np.array([len(x) // 8 for x in raw])
        who, ends = np.repeat(np.arange(len(n)), n), np.cumsum(n)
        _, element, having = np.unique(np.frombuffer(b"".join(raw), np.uint64) ^ mixed(label.astype(np.uint64) + STEP)[who], return_inverse=True, return_counts=True)
        holders, starts = who[np.argsort(element, kind="stable")], np.cumsum(having) - having
        first, last = np.searchsorted(label, label), np.searchsorted(label, label, "right")
        links, root = np.zeros(len(n), np.int64), np.arange(len(n))
        for i, (a, z) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
            e = element[ends[i] - n[i] : ends[i]]
            e = e[having[e] > 1]
            c = having[e]
            at = np.repeat(starts[e] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            common = np.bincount(holders[at] - a, minlength=z - a)
            near = 100 * common >= PERCENT * (n[i] + n[a:z] - common)
            near[i - a] = False
            links[i] = (near & (part[a:z] != part[i])).sum() if split else near.sum()
            found = np.flatnonzero(near)
            if len(found):
                local = root[a:z] - a
                merged(local, i - a, found)
                root[a:z] = local + a
        return pa.table({"cls": cls, "n_links": links, "low": cls[root]})

    return dealt.groupBy("alone", "bucket", "lo", "hi").applyInArrow(count, "cls long, n_links long, low long")


def labelled(classes: DataFrame, links: DataFrame) -> DataFrame:
    """classes that links(u, v) touch, with `label`: the smallest class that each reaches."""
    label = staged(components(links).withColumnRenamed("id", "_id"))
    label = label.union(label.select(F.col("label").alias("_id"), "label").distinct())  # components() leaves out the smallest
    return staged(classes.join(label, F.col("cls") == F.col("_id")).drop("_id"))


@tidied
def join(docs: DataFrame) -> DataFrame:
    """A row for each row of docs(doc_id, text): doc_id, n_shingles, n_links, component_id.

    A document's set is its distinct runs of 5 words (of fewer words, all as one). Documents link when 100 * common >= 75
    * union; component_id is the smallest doc_id that links reach. n_links is the number of other classes of equal sets
    that the row's own class links with: all pairs within a component are counted (see `linked_within`).

    Equal sets are one class. Two classes that link share a PartEnum signature (see `signatures`). Of each signature's
    classes, the smallest is compared with the others; then classes that share a signature and are not yet in one
    component are compared, too. These comparisons are of small sketches, which say "far apart" only of pairs that don't
    link, so classes that link end up under one label. Under each label all links are then counted exactly.

    Null and empty texts: no shingles, no links. Null doc_id: no links, component_id null. A repeated doc_id: each of its rows
    has its own text's links. Very long texts are read whole. An empty table: no rows. Other columns play no part.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = texts.where("doc_id IS NOT NULL AND text IS NOT NULL")
    sets = staged(sets_of(texts))
    classes = sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = staged(classes.withColumn("cls", F.monotonically_increasing_id()))
    of_class = classes.select(F.col("h1").alias("_1"), F.col("h2").alias("_2"), "cls", "rep")
    member = sets.join(of_class, (F.col("doc_id").isNotNull()) & (F.col("h1") == F.col("_1")) & (F.col("h2") == F.col("_2")), "left")
    member = staged(member.select("doc_id", F.col("n").alias("n_shingles"), "cls", "rep"))
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = meeting(known, common_signatures(known), slices(spark, total, BUCKET))
    of = member.where("cls IS NOT NULL").select(F.col("doc_id").alias("_id"), "cls")
    met = staged(staged(found).join(of, F.col("doc_id") == F.col("_id")).select("sig", "cls").distinct())
    first = met.groupBy("sig").agg(F.min("cls").alias("u")).withColumnRenamed("sig", "_sig")
    stars = met.join(first, F.col("sig") == F.col("_sig")).where("u <> cls").select("u", F.col("cls").alias("v")).distinct()
    near = staged(near_pairs(staged(stars), classes))
    label = staged(components(near))
    members = staged(met.join(label, F.col("cls") == F.col("id"), "left").select("sig", "cls", F.coalesce("label", "cls").alias("label")))
    open_ = members.groupBy("sig").agg(F.min("label").alias("a"), F.max("label").alias("z"), F.count(F.lit(1)).alias("k")).where("a <> z AND k > 2").select(F.col("sig").alias("_sig"))
    rest = members.join(open_, F.col("sig") == F.col("_sig"), "left_semi")
    rest = staged(rest.join(classes.select(F.col("cls").alias("_cls"), "n", "sketch"), F.col("cls") == F.col("_cls")).drop("_cls"))
    more = staged(across(rest, slices(spark, rest.count(), MEMBERS)))
    together = labelled(classes.drop("sketch"), label.select(F.col("id").alias("u"), F.col("label").alias("v")).union(more))
    exact = staged(linked_within(together, known))
    links = labelled(classes.select("cls", "rep"), exact.where("low <> cls").select(F.col("low").alias("u"), F.col("cls").alias("v")).distinct())
    smallest = links.groupBy(F.col("label").alias("_label")).agg(F.min("rep").alias("component_id"))
    counted = exact.groupBy(F.col("cls").alias("_c")).agg(F.sum("n_links").alias("n_links"))
    links = links.join(smallest, F.col("label") == F.col("_label")).join(counted, F.col("cls") == F.col("_c")).select(F.col("cls").alias("_cls"), "n_links", "component_id")
    rows = member.join(links, F.col("cls") == F.col("_cls"), "left")
    return rows.select("doc_id", "n_shingles", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "rep", "doc_id").alias("component_id"))
