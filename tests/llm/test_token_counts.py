import math
import random

import public_tokenizers

from tidewater.llm import token_counts
from tidewater.llm.token_counts import Trie, count

PATH = public_tokenizers.path("piece_bpe_32k.model")


def cuts(word, score, rare):
    """All segmentations: (log probability, pieces)."""
    if not word:
        return [(0.0, 0)]
    out = []
    for n in range(1, len(word) + 1):
        s, k = score.get(word[:n]), 1
        if s is None and n == 1:
            k = len(word[0].encode())
            s = k * rare
        if s is not None:
            out += [(s + a, k + b) for a, b in cuts(word[n:], score, rare)]
    return out


def test_trie_is_brute_force():
    trie, rng = Trie(PATH), random.Random(1)
    words = ["the", "token", "tokens", "été", "日本", "\U0001f600a", "x"] + ["".join(rng.choices("etaonsi", k=rng.randint(1, 9))) for _ in range(150)]
    for w in words:
        ways = cuts("▁" + w, trie.score, trie.rare)
        best = max(a for a, _ in ways)
        n, pieces, summed = trie.count(w)
        assert n == 1 and pieces == min(k for a, k in ways if math.isclose(a, best, rel_tol=1e-12))
        assert math.isclose(summed, math.log(sum(math.exp(a) for a, _ in ways)), rel_tol=1e-9)


def test_terminal_counts_and_shared_prefixes():
    trie = Trie(PATH)
    trie.count("token tokens token")
    assert len(trie.best) == len("▁tokens") + 1
    alone = [Trie(PATH).count(w)[1:] for w in ("token", "tokens")]
    assert [(trie.pieces[trie.words[w]], trie.summed[trie.words[w]]) for w in ("token", "tokens")] == alone


def test_long_words_take_a_window(monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choices("etaonsi日é", k=rng.randint(30, 200))) for _ in range(30)]
    trie = Trie(PATH)
    whole = [trie.count(f"a {w} b {w}") for w in words]
    monkeypatch.setattr(token_counts, "LONG", 20)
    cut = Trie(PATH)
    for (n, pieces, summed), w in zip(whole, words):
        got = cut.count(f"a {w} b {w}")
        assert got[:2] == (n, pieces) and math.isclose(got[2], summed, rel_tol=1e-12)
    assert set(cut.words) == {"a", "b"}


def test_query_is_brute_force(documents):
    """The table's rows against all segmentations of each word."""
    trie, rng = Trie(PATH), random.Random(6)
    rows = [(i, " ".join("".join(rng.choices("etaons", k=rng.randint(1, 8))) for _ in range(rng.randint(0, 6)))) for i in range(40)]
    for r in count(documents(rows), PATH).collect():
        pieces, total = 0, 0.0
        for w in rows[r.doc_id][1].split():
            ways = cuts("▁" + w, trie.score, trie.rare)
            best = max(a for a, _ in ways)
            pieces += min(k for a, k in ways if math.isclose(a, best, rel_tol=1e-12))
            total += math.log(sum(math.exp(a) for a, _ in ways))
        assert (r.n_words, r.n_tokens) == (len(rows[r.doc_id][1].split()), pieces) and math.isclose(r.log_score, total, abs_tol=2e-6)


def test_odd_rows(odd, documents):
    got = count(odd, PATH).collect()
    assert len(got) == 7
    by = {r.doc_id: r for r in got}
    assert (by[1].n_words, by[1].n_tokens, by[1].log_score) == (0, 0, 0) == (by[2].n_words, by[2].n_tokens, by[2].log_score)
    assert by[3].n_words == 60_000 and by[3].n_tokens >= 60_000
    assert by[6].n_words == 1
    assert count(documents([]), PATH).collect() == []
