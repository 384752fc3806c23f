"""Token ids in Arrow files: fixed-size sequences and masks, with an index of documents."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.session import shared_dir, slices, staged

#: A worker forgets the pieces that it has not met for this many new ones.
CACHED = 800_000

_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Encodes texts with a byte-level BPE of the tokenizers library.

    Such a tokenizer splits a text before each single space that a word follows, so the ids of a text are those of its
    words, each but the first with the space before it. Each distinct word is encoded by the library when it is new, many
    at once as one text that is cut where their bytes end, and then remembered as packed ids. A text that has a space beside
    white space, white space other than spaces and line feeds, or an added token's string is encoded whole.
    """

    meets = ("  ", " \n", "\n ")
    #: White space but for space and line feed, and what marks the cuts.
    others = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"] + ["\x00", "\u180e", "\u200b", "\ufeff"]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.sizes = np.zeros(1 + max([*vocabulary.values(), *self.library.get_added_tokens_decoder()]), np.int64)  # bytes of each token: a character stands for one
        self.sizes[[*vocabulary.values()]] = [len(x) for x in vocabulary]
        self.kind = np.dtype("<u2" if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"  # of the machine's own order: little-endian, as Arrow's files are
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.odd = re.compile(f"[{re.escape(''.join(self.others))}]")

    @classmethod
    def at(cls, path: str) -> "Encoder":
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def cut(self, text: str | None) -> list[str] | None:
        """The words of a text, None if it has to be encoded whole."""
        if not text:
            return []
        if any(x in text for x in self.meets) or self.odd.search(text) or any(x in text for x in self.added):
            return None
        return text.split(" ")

    def whole(self, texts: list[str]) -> list[bytes]:
        return [self.pack(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[str]) -> None:
        """Remember the ids of new words behind a space."""
        apart = [w for w in words if not w or w[-1].isspace()]
        self.known.update(zip(apart, self.whole([" " + w for w in apart]), strict=True))
        joins = [w for w in words if w and not w[-1].isspace()]
        parts = [joins[i : i + 2000] for i in range(0, len(joins), 2000)]
        for part, e in zip(parts, self.library.encode_batch_fast([" " + " ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.int64)
            ends, sizes = np.cumsum(self.sizes[ids]), np.cumsum([len(w.encode("utf-8", "surrogatepass")) + 1 for w in part])
            at = np.searchsorted(ends, sizes)
            if (at == len(ends)).any() or (ends[at] != sizes).any():  # not byte by byte: one by one
                self.known.update(zip(part, self.whole([" " + w for w in part]), strict=True))
                continue
            packed, cuts = ids.astype(self.kind).tobytes(), [0, *((at + 1) * self.kind.itemsize).tolist()]
            self.known.update((w, packed[a:z]) for w, a, z in zip(part, cuts, cuts[1:], strict=False))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, packed; null counts as empty."""
        cut = [self.cut(t) for t in texts]
        if len(self.known) > CACHED:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        new = set().union(*(c[1:] for c in cut if c)).difference(known)
        if older:
            known.update((x, older[x]) for x in new if x in older)
            new = new.difference(known)
        self.learn([*new])
        alone = [t if words is None else words[0] for t, words in zip(texts, cut, strict=True) if words != []]
        get, first = known.__getitem__, iter(self.whole(alone))
        return [b"" if words == [] else next(first) if words is None else next(first) + b"".join(map(get, words[1:])) for words in cut]


def schema(kind: np.dtype, length: int) -> pa.Schema:
    ids = pa.uint16() if kind.itemsize == 2 else pa.uint32()
    return pa.schema([("tokens", pa.list_(ids, length)), ("mask", pa.list_(pa.bool_(), length))], {"sequence_length": str(length)})


INDEX = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64())])


class Writer:
    """One file of sequences and its index, in the order of `add`. Each attempt of a task has files of its own, which nothing
    changes once they are closed; the manifest names those that count."""

    def __init__(self, folder: str, name: str, kind: np.dtype, length: int, per_batch: int):
        self.fs, root = pa.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(root, recursive=True)
        self.kind, self.length, self.chunk = kind, length, length * per_batch * kind.itemsize
        self.outs = [self.fs.open_output_stream(f"{root}/{name}.{x}.arrow") for x in ("tokens", "docs")]
        self.schema = schema(kind, length)
        self.tokens, self.docs = pa.ipc.new_file(self.outs[0], self.schema), pa.ipc.new_file(self.outs[1], INDEX)
        self.waiting, self.rows, self.at = bytearray(), [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // self.kind.itemsize
        self.rows.append((doc_id, self.at, n))
        self.at += n
        self.waiting += ids
        full = len(self.waiting) // self.chunk * self.chunk
        for i in range(0, full, self.chunk):
            self.flush(bytes(self.waiting[i : i + self.chunk]))
        del self.waiting[:full]
        if len(self.rows) >= 10_000:
            self.flush_rows()

    def flush(self, ids: bytes) -> None:
        n, width = len(ids) // self.kind.itemsize, self.length
        sequences = -(-n // width)
        tokens, mask = np.zeros(sequences * width, self.kind), np.zeros(sequences * width, bool)
        tokens[:n], mask[:n] = np.frombuffer(ids, self.kind), True
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), width) for x in (tokens, mask)]
        self.tokens.write_batch(pa.record_batch(lists, schema=self.schema))

    def flush_rows(self) -> None:
        if self.rows:
            self.docs.write_batch(pa.record_batch([pa.array(c, pa.int64()) for c in zip(*self.rows, strict=True)], schema=INDEX))
            self.rows = []

    def close(self) -> int:
        if self.waiting:
            self.flush(bytes(self.waiting))
        self.flush_rows()
        for x in (self.tokens, self.docs, *self.outs):
            x.close()
        return self.at


class Reader:
    """Random access to the sequences of a file. A local file is mapped, so a sequence and the bits of a mask are views of the
    file itself."""

    def __init__(self, base: str):
        self.fs, path = pa.fs.FileSystem.from_uri(base)
        local = isinstance(self.fs, pa.fs.LocalFileSystem)
        self.open = (lambda p: pa.memory_map(p)) if local else self.fs.open_input_file
        self.file, self.docs = pa.ipc.open_file(self.open(f"{path}.tokens.arrow")), pa.ipc.open_file(self.open(f"{path}.docs.arrow"))
        self.length = int(self.file.schema.metadata[b"sequence_length"])
        self.per_batch = len(self.file.get_batch(0)) if self.file.num_record_batches else 1

    def flat(self, batch: int) -> np.ndarray:
        return self.file.get_batch(batch).column(0).flatten().to_numpy(zero_copy_only=True)

    def sequence(self, i: int) -> np.ndarray:
        at = i % self.per_batch * self.length
        return self.flat(i // self.per_batch)[at : at + self.length]

    def mask_bits(self, i: int) -> np.ndarray:
        """The mask's bits as bytes, the lowest bit first. `length` is a multiple of 8."""
        bits = np.frombuffer(self.file.get_batch(i // self.per_batch).column(1).flatten().buffers()[1], np.uint8)
        at = i % self.per_batch * self.length // 8
        return bits[at : at + self.length // 8]

    def mask(self, i: int) -> np.ndarray:
        """The mask as booleans, unpacked."""
        return np.unpackbits(self.mask_bits(i), bitorder="little").astype(bool)

    def documents(self) -> Iterator[tuple[int | None, int, Iterator[np.ndarray]]]:
        """(doc_id, offset, n_tokens, pieces of its ids), in file order. Pieces have to be used before the next document."""
        width, at, batch = self.length * self.per_batch, -1, np.zeros(0)

        def pieces(start: int, n: int) -> Iterator[np.ndarray]:
            nonlocal at, batch
            while n:
                if start // width != at:
                    at = start // width
                    batch = self.flat(at)
                part = batch[start % width : start % width + n]
                yield part
                start, n = start + len(part), n - len(part)

        for i in range(self.docs.num_record_batches):
            b = self.docs.get_batch(i)
            for doc_id, offset, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield doc_id, offset, n, pieces(offset, n)


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 2, length: int = 1024, per_batch: int = 64, file_bytes: int = 64 << 20) -> DataFrame:
    """Encode docs(doc_id, text) and write them, ascending by doc_id, as Arrow files under `folder` (default: a new one in
    the shared folder). Returns the manifest: part, base (path without suffix), first_token, n_tokens, n_docs.

    Each part is a range of ids and a stream of tokens, an `end_id` after each document, cut into sequences of `length`;
    the last one is filled with 0, where its mask is false. `<base>.tokens.arrow` holds batches of `per_batch` sequences,
    `<base>.docs.arrow` each document's offset in the part and its length. first_token counts the ids of earlier parts.

    Null and empty texts: the end id alone. Null doc_id: before all others. Repeated rows or ids: one entry each, in order
    of a hash of the text, so a run that is repeated writes the same order. Very long texts: cut over as many sequences as
    they need. An empty table: no files. Other columns play no part. A task that failed may leave files that the manifest
    does not name.
    """
    if length % 8:
        raise ValueError("a sequence's length has to be a multiple of 8")
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    n = slices(spark, rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0], file_bytes)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, n_docs = Encoder.at(tokenizer), None, 0
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{TaskContext.get().taskAttemptId()}"
        end = encoder.pack([end_id])
        for b in batches:
            for i in range(0, len(b), 500):
                ids, texts = (c.slice(i, 500).to_pylist() for c in b.columns)
                writer = writer or Writer(folder, name, encoder.kind, length, per_batch)
                for doc_id, packed in zip(ids, encoder.encode(texts), strict=True):
                    writer.add(doc_id, packed + end)
                n_docs += len(ids)
        if writer:
            row = {"part": [part], "base": [f"{folder}/{name}"], "n_tokens": [writer.close()], "n_docs": [n_docs]}
            yield pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("base", pa.string()), ("n_tokens", pa.int64()), ("n_docs", pa.int64())]))

    order = F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()
    laid = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    parts = staged(laid.mapInArrow(encode, "part int, base string, n_tokens long, n_docs long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_back(manifest: DataFrame) -> DataFrame:
    """A row for each document in the files: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian uint32), part."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, base, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows = []
                for doc_id, offset, n, pieces in Reader(base).documents():
                    crc = 0
                    for p in pieces:
                        crc = zlib.crc32(p.astype("<u4").tobytes(), crc)
                    rows.append((doc_id, first + offset, n, crc, part))
                    if len(rows) == 10_000:
                        yield pack(rows)
                        rows = []
                if rows:
                    yield pack(rows)

    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32())])
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = manifest.select("part", "base", "first_token").repartition(n, "part")
    return spread.mapInArrow(scan, "doc_id long, start long, n_tokens long, ids_crc32 long, part int")
