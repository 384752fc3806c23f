"""Token counts by dynamic programming over a trie of distinct words."""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: A worker starts a new trie when it has so many nodes. Words of more characters than LONG don't go into it.
NODES, LONG = 2_000_000, 2_000

_tries: dict[str, "Trie"] = {}


class Trie:
    """Words, character by character; what they begin with in common is computed once.

    A piece of rank r (its place in the vocabulary, which is ordered by use) has a probability in proportion to
    1 / (r + 1). Each node holds, for the text from the root to it: the highest probability of a segmentation, the pieces
    in it (of equal ones the fewest), and the probability summed over all segmentations, all from its ancestors' values.
    A character that the vocabulary lacks is its UTF-8 bytes, each as likely as the last piece. The node at which a word ends
    has the word's counts, which is what texts look up.
    """

    def __init__(self, vocabulary: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        ranks: dict[str, int] = {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
                ranks[sp.id_to_piece(i)] = len(ranks)
        whole = math.log(sum(1 / (r + 1) for r in ranks.values()))
        self.score = {p: -math.log(r + 1) - whole for p, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self.rare = min(self.score.values())
        self.ends = {p[i:] for p in ranks for i in range(len(p))}
        self.clear()

    @classmethod
    def at(cls, path: str) -> "Trie":
        if path not in _tries:
            _tries[path] = cls(path)
        trie = _tries[path]
        if len(trie.best) > NODES:
            trie.clear()
        return trie

    def clear(self) -> None:
        self.next: dict[int, int] = {}  # node and character -> node
        self.best, self.summed = array("d", [0.0]), array("d", [0.0])
        self.pieces = array("l", [0])
        self.words: dict[str, int] = {}  # words and their terminal nodes

    def insert(self, word: str) -> int:
        """The node of a word."""
        node, path, score, ends = 0, [0], self.score, self.ends
        for j, c in enumerate(word, 1):
            key = node << 21 | ord(c)
            there = self.next.get(key)
            if there is None:
                best, fewest, sums = -math.inf, 0, []
                for start in range(j - 1, -1, -1):
                    piece = word[start:j]
                    s, n = score.get(piece), 1
                    if s is None:
                        if start == j - 1:
                            n = len(c.encode("utf-8", "surrogatepass"))
                            s = n * self.rare
                        elif piece not in ends:
                            break
                        else:
                            continue
                    back = path[start]
                    total, n = self.best[back] + s, self.pieces[back] + n
                    sums.append(self.summed[back] + s)
                    if total > best or total == best and n < fewest:
                        best, fewest = total, n
                top = max(sums)
                there = self.next[key] = len(self.best)
                self.best.append(best)
                self.pieces.append(fewest)
                self.summed.append(top + math.log(sum([math.exp(s - top) for s in sums])))
            node = there
            path.append(node)
        return node

    def alone(self, word: str) -> tuple[int, float]:
        """Pieces and summed log probability of a long word: the same pass, over a window of the last positions."""
        score, ends = self.score, self.ends
        window = [(0.0, 0, 0.0)]  # (best, pieces, summed) of the last positions
        for j, c in enumerate(word, 1):
            best, fewest, sums = -math.inf, 0, []
            for back in range(1, len(window) + 1):
                piece = word[j - back : j]
                s, n = score.get(piece), 1
                if s is None:
                    if back == 1:
                        n = len(c.encode("utf-8", "surrogatepass"))
                        s = n * self.rare
                    elif piece not in ends:
                        break
                    else:
                        continue
                was = window[-back]
                sums.append(was[2] + s)
                if was[0] + s > best or was[0] + s == best and was[1] + n < fewest:
                    best, fewest = was[0] + s, was[1] + n
            top = max(sums)
            window.append((best, fewest, top + math.log(sum([math.exp(s - top) for s in sums]))))
            if len(window) > self.longest:
                del window[0]
        return window[-1][1:]

    def count(self, text: str | None) -> tuple[int, int, float]:
        """Words, pieces, and summed log probability of a text."""
        words = every = text.split() if text else []
        known = self.words
        n, total = 0, 0.0
        if text and len(text) > LONG and any(len(w) > LONG for w in words):
            for w in words:
                if len(w) > LONG:
                    pieces, summed = self.alone("▁" + w)
                    n += pieces
                    total += summed
            words = [w for w in words if len(w) <= LONG]
        for w in {*words}.difference(known):
            known[w] = self.insert("▁" + w)
        nodes = [known[w] for w in words]
        pieces, summed = self.pieces, self.summed
        for x in nodes:
            n += pieces[x]
            total += summed[x]
        return len(every), n, total


def count(docs: DataFrame, vocabulary: str) -> DataFrame:
    """A row for each row of docs(doc_id, text): doc_id, n_words, n_tokens, log_score.

    n_words counts runs without white space; each is written as U+2581 and itself, cut into pieces of the vocabulary so
    that their unigram probability is highest, and n_tokens counts the pieces. log_score is the log of the probability
    summed over all segmentations, rounded to 6 digits. The work for a word is done once in a worker (see `Trie`).

    Null and empty texts: 0, 0, 0. Repeated rows: a row each. Very long texts are counted whole; a run of any length is a
    word, and one of more than LONG characters takes a window's memory. An empty table: no rows. Other columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 500):
                part = b.slice(i, 500)
                trie = Trie.at(vocabulary)
                rows = [trie.count(t) for t in part.column("text").to_pylist()]
                made = [pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)] + [pa.array([round(r[2], 6) for r in rows], pa.float64())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *made], names=["doc_id", "n_words", "n_tokens", "log_score"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long, log_score double")
