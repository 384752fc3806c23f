import math
import random
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers

from tidewater.llm import language_id
from tidewater.llm.language_id import Lattice, Model, identify, pieces_of, runs

PATH = public_tokenizers.path("piece_bpe_32k.model")


def every(word, score):
    """Sum over all ways to cut a word, by recursion."""
    return 1.0 if not word else sum(score[word[:n]] * every(word[n:], score) for n in range(1, len(word) + 1) if word[:n] in score)


def test_forward_sums_all_segmentations():
    rng = random.Random(1)
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "aba", "bb", "▁ab"]
    table = np.zeros((len(pieces) + 2, 2))
    table[2:] = np.array([[rng.random(), rng.random()] for _ in pieces])
    words = ["a", "ab", "abab", "babba", "aabbaab"]
    lattice = Lattice(pieces)
    sums = lattice.forward(lattice.edges(words), table)
    for k, w in enumerate(words):
        for lang in (0, 1):
            want = every("▁" + w, dict(zip(pieces, table[2:, lang])))
            assert math.isclose(sums[len(w) + 1, k, lang], want)


def test_expected_counts_cover_each_word():
    pieces = ["▁", "a", "b", "ab", "▁a"]
    table = np.array([0, 1e-7, 0.2, 0.2, 0.2, 0.2, 0.2])
    lattice = Lattice(pieces)
    total = lattice.expected({"ab": 3, "ba": 1}, table)
    lengths = np.array([0, 1, *map(len, pieces)])
    assert math.isclose((total * lengths).sum(), 3 * 3 + 1 * 3)


def plain(word, score, unknown):
    """The logarithm of the sum over all segmentations of a word of any length, by exact fractions."""
    sums = [Fraction(1)]
    word = "▁" + word
    for j in range(1, len(word) + 1):
        own = [(i, score.get(word[i:j], unknown if i == j - 1 else 0)) for i in range(max(0, j - 8), j)]
        sums.append(sum(sums[i] * p for i, p in own))
    return math.log(sums[-1].numerator) - math.log(sums[-1].denominator)


def test_long_words_are_summed_whole(monkeypatch):
    """Also where they are shorter than a stretch, and longer than several; with probabilities that floating point can't hold."""
    assert runs("ab  c\n" + "x" * 50) == ["ab", "c", "x" * 50]
    rng = random.Random(3)
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "aba", "bbabb", "▁ab"]
    table = np.zeros((len(pieces) + 2, 2))
    table[1], table[2:] = 1e-7, [[rng.random(), rng.random() / 50] for _ in pieces]
    words = ["".join(rng.choices("abz" if n % 2 else "ab", k=n)) for n in (1, 25, 26, 60, 200, 200, 600)]
    lattice = Lattice(pieces)
    for stretch in (16, 256):
        monkeypatch.setattr(language_id, "STRETCH", stretch)
        got = {w: s for part, ends in lattice.long_batches(words) for w, s in zip(part, lattice.scores(part, ends, table))}
        assert set(got) == set(words[1:])
        for w, s in got.items():
            for lang in (0, 1):
                score = {p: Fraction(x) for p, x in zip(pieces, table[2:, lang])}
                assert math.isclose(s[lang], plain(w, score, Fraction(1e-7)), rel_tol=1e-9)


def test_expected_counts_do_not_depend_on_the_way(monkeypatch):
    pieces = ["▁", "a", "b", "ab", "▁a", "bab"]
    table = np.array([0, 1e-7, 0.2, 0.1, 0.2, 0.3, 0.1, 0.1])
    counts = {"abab": 3, "babzab": 2, "a": 1, "abababb": 5}
    lattice = Lattice(pieces)
    short = lattice.expected(counts, table)
    monkeypatch.setattr(language_id, "LONG", 0)
    assert np.allclose(short, lattice.expected(counts, table))


def test_one_very_long_word():
    pieces = ["▁", "a", "b", "ab", "▁a", "bab"]
    lattice, word = Lattice(pieces), "ab" * 50_000
    (s,) = lattice.scores([word], np.array([len(word) + 1]), np.full((8, 2), 0.1))
    assert np.isfinite(s).all()


def test_accuracy_and_odd_rows(spark, documents):
    rng = random.Random(2)
    voc = {"en": "the of and house water street with from".split(), "de": "der und haus wasser straße mit nicht über".split(), "fr": "le la maison eau rue avec été où".split()}
    rows = [(i, " ".join(rng.choices(voc[lang], k=rng.randint(1, 30))), lang, "s") for i, lang in enumerate(rng.choices(list(voc), k=400))]
    odd = [(1000, None, "en", "s"), (1001, "", None, "s"), (1002, "12 34 !!", "de", None), (None, "der und haus", None, None), (1003, "the " * 50_000, None, None)]
    got = {r.doc_id: r for r in identify(documents(rows + odd, score=1, lang_pred="q"), PATH).collect()}
    assert len(got) == 405
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert all(got[r[0]].held_out == (r in held) for r in rows)
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.97 * len(held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    assert got[None].lang_pred == "de" and not got[None].held_out
    assert got[1003].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())


def test_nothing_to_learn(documents):
    assert [r.lang_pred for r in identify(documents([(1, "words", None, "s")]), PATH).collect()] == ["und"]
    assert identify(documents([]), PATH).collect() == []


def test_labels_of_held_out_documents_play_no_part(documents):
    rows = [(i, "der und haus" if i % 2 else "the of house", "de" if i % 2 else "en", "s") for i in range(60)]
    swapped = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 3 == 1 else lang, s) for i, t, lang, s in rows]
    one, other = ({(r.doc_id, r.lang_pred, r.score) for r in identify(documents(x), PATH).collect()} for x in (rows, swapped))
    assert one == other


def test_model_pieces():
    pieces = pieces_of(PATH)
    assert len(pieces) > 25_000 and all("▁" not in p[1:] for p in pieces)
    assert Model(["a"], pieces, np.zeros((len(pieces) + 2, 1)), np.zeros(1)).scorer()
