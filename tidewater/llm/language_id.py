"""Language identification with unigrams over a public vocabulary, summed over all segmentations."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.session import passing, staged

#: Words of more characters are computed in logarithms, by a pass that holds a window of positions; the sums are the same.
LONG = 24
#: Characters of long words that are computed side by side, but for a longer word; positions of a stretch.
SIDE_BY_SIDE, STRETCH = 1 << 16, 256
#: Probability of a character that the vocabulary lacks, in any language.
UNKNOWN = 1e-7
#: A worker forgets its words beyond so many, or so many characters of them.
CACHED, CACHED_CHARS = 150_000, 1 << 22
UND = "und"

_scorers: dict[str, "Scorer"] = {}


def pieces_of(path: str) -> list[str]:
    """The pieces of a sentencepiece vocabulary that may lie within a word; a word starts with U+2581."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    every = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)))
    return sorted({p for p in every if p and "▁" not in p[1:]})


def runs(text: str) -> list[str]:
    """The words of a text: whatever lies between white space."""
    return text.replace("\0", "\ufffd").split()


STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Lattice:
    """Where the pieces of a vocabulary lie in words. Row 0 of a table of probabilities is "no piece", row 1 "unknown".

    Pieces are found by hash: `keys` has each row's, and `head` and `next` chain the rows of one slot.
    """

    def __init__(self, pieces: list[str]):
        self.longest, bits = max(map(len, pieces), default=1), 20
        self.shift = np.uint64(64 - bits)
        self.keys, self.head, self.next = np.zeros(len(pieces) + 2, np.uint64), np.zeros(1 << bits, np.int32), np.zeros(len(pieces) + 2, np.int32)
        sizes = np.array([len(p) for p in pieces])
        for n in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == n)
            codes = np.frombuffer("".join(pieces[k] for k in at).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
            hashed = np.zeros(len(at), np.uint64)
            for i in range(n):
                hashed = hashed * STEP + mixed(codes[:, i].astype(np.uint64))
            self.keys[at + 2] = mixed(hashed)
        slots = (self.keys >> self.shift).tolist()
        for row in range(2, len(slots)):
            self.next[row], self.head[slots[row]] = self.head[slots[row]], row
        if len(np.unique(self.keys)) < len(pieces) + 1:
            raise ValueError("two pieces have one hash")

    def rows(self, hashed: np.ndarray) -> np.ndarray:
        """The row of the piece with each hash, 0 if there is none."""
        row = self.head[hashed >> self.shift]
        todo = np.flatnonzero(row)
        while len(todo):
            todo = todo[self.keys[row[todo]] != hashed[todo]]
            row[todo] = self.next[row[todo]]
            todo = todo[row[todo] > 0]
        return row

    def edges(self, words: list[str]) -> np.ndarray:
        """[end, length - 1, word] -> row of the piece of that length that ends there, 0 if there is none."""
        n = max(map(len, words)) + 1
        flat = np.frombuffer("".join(("▁" + w).ljust(n, "\0") for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.ascontiguousarray(flat.reshape(len(words), n).T)
        letters = mixed(codes.astype(np.uint64))
        found = np.zeros((n + 1, min(self.longest, n), len(words)), np.int32)
        for i in range(n):
            hashed = np.zeros(len(words), np.uint64)
            for j in range(i, min(n, i + self.longest)):
                hashed = hashed * STEP + letters[j]
                row = self.rows(mixed(hashed))
                if j == i:
                    row[(row == 0) & (codes[i] > 0)] = 1
                found[j + 1, j - i] = row
        return found

    @staticmethod
    def forward(edges: np.ndarray, table: np.ndarray) -> np.ndarray:
        """[position, word, language]: the summed probability of all segmentations up to the position."""
        n, longest, words = edges.shape
        sums = np.zeros((n, words, table.shape[1]))
        sums[0] = 1
        for j in range(1, n):
            for length in range(1, min(longest, j) + 1):
                rows = edges[j, length - 1]
                if rows.any():
                    sums[j] += sums[j - length] * table[rows]
        return sums

    def batches(self, words: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """(words, edges, positions of their ends) of words that aren't long, those of like length together."""
        words = sorted((w for w in words if len(w) <= LONG), key=lambda w: (len(w), w))
        for i in range(0, len(words), 4000):
            part = words[i : i + 4000]
            yield part, self.edges(part), np.array([len(w) + 1 for w in part])

    def long_batches(self, words: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
        """(words, positions of their ends) of long words, those of like length together."""
        words = sorted((w for w in words if len(w) > LONG), key=lambda w: (len(w), w))
        part: list[str] = []
        for w in words:
            if part and (len(part) + 1) * len(w) > SIDE_BY_SIDE:
                yield part, np.array([len(x) + 1 for x in part])
                part = []
            part.append(w)
        if part:
            yield part, np.array([len(x) + 1 for x in part])

    def stretches(self, words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """(position before it, what `edges` has) for each stretch of STRETCH positions, of words of any length."""
        n = max(map(len, words)) + 1
        for a in range(0, n, STRETCH):
            z, first = min(n, a + STRETCH), max(0, a - self.longest + 1)
            texts = [("▁" + w[: z - 1])[first:] if first == 0 else w[first - 1 : z - 1] for w in words]
            flat = np.frombuffer("".join(t.ljust(z - first, "\0") for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
            codes = np.ascontiguousarray(flat.reshape(len(words), z - first).T)
            letters = mixed(codes.astype(np.uint64))
            found = np.zeros((z - a, self.longest, len(words)), np.int32)
            hashed = np.zeros_like(letters)
            for back in range(min(self.longest, z - first)):  # pieces of back + 1 characters, by where they start
                hashed = hashed[: z - first - back] * STEP + letters[back:]
                ends = hashed[max(0, a - first - back) :]
                row = self.rows(mixed(ends.ravel())).reshape(ends.shape)
                if back == 0:
                    row[(row == 0) & (codes[a - first :] > 0)] = 1
                found[z - a - len(row) :, back] = row
            yield a, found

    def logs(self, words: list[str], table: np.ndarray) -> Iterator[np.ndarray]:
        """For each position from 0 on, [word, language]: the logarithm of what `forward` has there. Beyond a word's end it stays."""
        window = np.full((self.longest, len(words), table.shape[1]), -np.inf)  # by how far back
        window[0] = 0
        yield window[0].copy()
        for _, found in self.stretches(words):
            for edges in found:
                summed = (table[edges] * np.exp(window - window[0])).sum(axis=0)
                here = window[0] + np.log(np.where(summed > 0, summed, 1))
                window[1:] = window[:-1].copy()
                window[0] = here
                yield here

    def scores(self, words: list[str], ends: np.ndarray, table: np.ndarray) -> np.ndarray:
        """[word, language]: the logarithm of a word's summed probability."""
        out = np.zeros((len(words), table.shape[1]))
        for j, here in enumerate(self.logs(words, table)):
            out[ends == j] = here[ends == j]
        return out

    def expected(self, counts: Counter, table: np.ndarray) -> np.ndarray:
        """How often each row is expected in the counted words, under probabilities of one language."""
        total = np.zeros(len(table))
        for part, ends in self.long_batches(list(counts)):
            ahead = np.stack([x[:, 0] for x in self.logs(part, table[:, None])])
            flow = np.zeros_like(ahead)
            flow[ends, np.arange(len(part))] = [counts[w] for w in part]
            for a, found in reversed([*self.stretches(part)]):
                for j in range(a + len(found), a, -1):
                    back = min(self.longest, j)
                    rows = found[j - a - 1, :back]
                    share = flow[j] * table[rows] * np.exp(ahead[j - back : j][::-1] - ahead[j])
                    flow[j - back : j] += share[::-1]
                    np.add.at(total, rows, share)
        for part, edges, ends in self.batches(list(counts)):
            n, longest, words = edges.shape
            every = np.arange(words)
            ahead = self.forward(edges, table[:, None])[:, :, 0]
            behind = np.zeros((n, words))
            behind[ends, every] = np.array([counts[w] for w in part]) / ahead[ends, every]
            for j in range(n - 1, 0, -1):
                for length in range(1, min(longest, j) + 1):
                    rows = edges[j, length - 1]
                    if rows.any():
                        flow = table[rows] * behind[j]
                        behind[j - length] += flow
                        np.add.at(total, rows, flow * ahead[j - length])
        total[0] = 0
        return total


class Scorer:
    """Log probabilities of words in each language, remembered by word."""

    def __init__(self, pieces: list[str], table: np.ndarray, prior: np.ndarray):
        self.lattice, self.table, self.prior = Lattice(pieces), table, prior
        self.forget()

    def forget(self) -> None:
        self.places, self.scores, self.used, self.chars = {}, np.zeros((1 << 12, self.table.shape[1])), 0, 0

    def learn(self, words: list[str]) -> None:
        for part, edges, ends in self.lattice.batches(words):
            self.keep(part, np.log(self.lattice.forward(edges, self.table)[ends, np.arange(len(part))]))
        for part, ends in self.lattice.long_batches(words):
            self.keep(part, self.lattice.scores(part, ends, self.table))

    def keep(self, words: list[str], scores: np.ndarray) -> None:
        need = self.used + len(words)
        if need > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros((max(need, len(self.scores)), self.scores.shape[1]))])
        self.scores[self.used : need] = scores
        self.places.update(zip(words, range(self.used, need)))
        self.used = need
        self.chars += sum(map(len, words))

    def predict(self, texts: list[str | None]) -> tuple[list[int], list[float]]:
        """The language of each text, -1 for none, and its posterior probability."""
        if self.used > CACHED or self.chars > CACHED_CHARS:
            self.forget()
        best, sure = [], []
        cut = [runs(t) if t and any(map(str.isalpha, t)) else None for t in texts]
        if new := [*set().union(*(w for w in cut if w)).difference(self.places)]:
            self.learn(new)
        for words in cut:
            if words is None:
                best.append(-1)
                sure.append(0.0)
                continue
            get = self.places.__getitem__
            at = np.fromiter(map(get, words), np.int64, len(words))
            total = self.scores[at].sum(axis=0) + self.prior
            k = int(total.argmax())
            best.append(k)
            sure.append(float(1 / np.exp(np.minimum(total - total[k], 0)).sum()))
        return best, sure


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Model:
    """langs, pieces, table[piece row, language], log prior. Its size is that of the vocabulary times the languages."""

    def __init__(self, langs: list[str], pieces: list[str], table: np.ndarray, prior: np.ndarray):
        self.langs, self.pieces, self.table, self.prior, self.name = langs, pieces, table, prior, uuid.uuid4().hex

    def scorer(self) -> Scorer:
        if self.name not in _scorers:
            _scorers.clear()
            _scorers[self.name] = Scorer(self.pieces, self.table, self.prior)
        return _scorers[self.name]


def train(docs: DataFrame, vocabulary: str, per_lang: int = 1500, rounds: int = 3, smooth: float = 0.1, longest_word: int = 2000) -> Model | None:
    """Learn from docs(doc_id, text, lang) that are not held out and have text and lang; None if there are none.

    The probabilities come from `rounds` of expectation and maximisation, which start from equal probabilities. They are
    fitted on about `per_lang` documents of each language, chosen by a hash of doc_id, without words of more than
    `longest_word` characters, of which a fit would hold every position; the prior counts all documents. The driver gets a count for each piece and language. Expected counts are summed as integers, so
    the order of partitions doesn't matter.
    """
    spark = docs.sparkSession
    fit = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r.lang: r.n for r in fit.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    langs = sorted(counts)
    rate = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, per_lang / counts[lang]))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    sample = staged(fit.where(draw < rate[F.col("lang")]).select("lang", "text"))
    pieces = pieces_of(vocabulary)
    table = np.full((len(pieces) + 2, len(langs)), 1 / len(pieces))
    place = {lang: k for k, lang in enumerate(langs)}
    for _ in range(rounds):
        table[0], table[1] = 0, UNKNOWN
        sent = spark.sparkContext.broadcast((pieces, table))

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, probabilities = sent.value
            lattice, total = Lattice(names), {}
            for b in batches:
                words: dict[int, Counter] = {}
                for lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    words.setdefault(place[lang], Counter()).update(w for w in runs(text) if len(w) <= longest_word)
                for k, counted in words.items():
                    if counted:
                        total[k] = total.get(k, 0) + lattice.expected(counted, probabilities[:, k])
            for k, x in total.items():
                rows = np.flatnonzero(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), k)), pa.array(rows), pa.array(np.rint(x[rows] * (1 << 20)).astype(np.int64))], names=["k", "row", "n"])

        got = sample.mapInArrow(expect, "k long, row long, n long").groupBy("k", "row").agg(F.sum("n").alias("n")).collect()
        table = np.full(table.shape, smooth)
        for r in got:
            table[r.row, r.k] += r.n / (1 << 20)
        table /= table[2:].sum(axis=0)
        sent.unpersist()
    table[0], table[1] = 0, UNKNOWN
    seen = np.array([counts[lang] for lang in langs], float)
    return Model(langs, pieces, table, np.log(seen / seen.sum()))


def identify(docs: DataFrame, vocabulary: str, carry: bool = False, **how) -> DataFrame:
    """A row for each row of docs(doc_id, text, lang): doc_id, held_out, lang_pred, score; with `carry` docs' own columns,
    then lang_pred and score in place of any of those names.

    A text's probability in a language is the product over its words, and a word's is the sum over all ways to write it
    as pieces of `vocabulary`, by a forward pass. score is the posterior probability of lang_pred, given how common each
    language is among the documents learned from (see `train`). lang of the document itself plays no part.

    Null, empty and letterless texts: `und`, score 0. If there is nothing to learn from, all are `und`. Null doc_id: not
    held out, not learned from. Repeated rows: a row each. Very long texts and words are scored whole, in a time that grows with
    their length.
    """
    spark = docs.sparkSession
    with passing(spark):
        model = train(docs, vocabulary, **how)
    sent = spark.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            for i in range(0, len(b), 250):
                part = b.slice(i, 250)
                best, score = model.scorer().predict(part.column("text").to_pylist()) if model else ([-1] * len(part), [0.0] * len(part))
                kept = [c for c in part.schema.names if c not in out[-2:]]
                more = [pa.array([UND if k < 0 else model.langs[k] for k in best], pa.string()), pa.array([round(x, 9) for x in score], pa.float64())]
                arrays = [part.column(c) for c in kept if c in out] + more
                yield pa.RecordBatch.from_arrays(arrays, names=out)

    if carry:
        rows = docs
        out = [c for c in docs.columns if c not in ("lang_pred", "score")] + ["lang_pred", "score"]
    else:
        rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
        out = ["doc_id", "held_out", "lang_pred", "score"]
    made = T.StructType([*(f for f in rows.schema.fields if f.name in out[:-2]), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(predict, made)
