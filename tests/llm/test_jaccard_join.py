import random

import numpy as np
from brute import near_components, shingle_sets

from tidewater.llm import jaccard_join
from tidewater.llm.jaccard_join import instances, join, linked, near_sketches, parts, shingles, signatures, sketch


def texts(seed, n):
    """Near and exact copies, a passage that many share, short texts."""
    rng = random.Random(seed)
    word = lambda: f"v{rng.randint(0, 3000)}"
    passage = [word() for _ in range(40)]
    bases = [[word() for _ in range(rng.choice([3, 6, 12, 40, 90, 200]))] for _ in range(n // 8)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.5:
            w = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = word()
            if rng.random() < 0.2:
                w += [word() for _ in range(len(w) // 6)]
        elif kind < 0.8:
            w = passage + [word() for _ in range(rng.randint(0, 60))]
        else:
            w = [word() for _ in range(rng.randint(0, 30))]
        rows.append((i, rng.choice([" ", "\n"]).join(w).title() if rng.random() < 0.3 else " ".join(w)))
    return rows


def test_same_as_brute_force(documents, monkeypatch):
    """Also where groups are dealt into blocks, and where common signatures are."""
    monkeypatch.setattr(jaccard_join, "MEMBERS", 40)
    for seed in (1, 2):
        rows = texts(seed, 500)
        if seed == 2:
            for name, n in (("GROUP", 12), ("FEW", 4), ("HOT", 20), ("SAMPLED", 2)):
                monkeypatch.setattr(jaccard_join, name, n)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in join(documents(rows, n=1, sig=2, rep=3, label=4)).collect()}
        assert got == near_components(rows)


def test_all_links_are_counted(documents, monkeypatch):
    """Also within a component that several blocks hold, and for each text of a repeated doc_id."""
    rng = random.Random(3)
    group = [f"v{i}" for i in range(60)]
    dense = [(1000 + i, " ".join([*group, f"end{i}"])) for i in range(30)]
    rows = [*texts(3, 300), *dense, (1000, " ".join(group[:58]))]
    rng.shuffle(rows)
    sets = [(i, frozenset(shingles(t).tolist())) for i, t in rows]
    classes = {s for _, s in sets if s}
    near = lambda a, b: a != b and 100 * len(a & b) >= 75 * len(a | b)
    expected = sorted((i, len(s), sum(near(s, o) for o in classes) if s else 0) for i, s in sets)
    assert sum(n == 30 for _, _, n in expected) >= 30
    for block in (7, jaccard_join.BLOCK):
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        assert sorted((r.doc_id, r.n_shingles, r.n_links) for r in join(documents(rows)).collect()) == expected


def test_rows_of_one_id_are_documents_of_their_own(documents):
    a, b = [f"a{i}" for i in range(104)], [f"b{i}" for i in range(204)]
    rows = [(7, " ".join(a)), (7, " ".join(b)), (9, " ".join([*a[:102], "x", "y"])), (5, " ".join(["z", *b])), (11, "q")]
    assert sorted((r.doc_id, r.n_shingles, r.n_links, r.component_id) for r in join(documents(rows)).collect()) == [(5, 201, 1, 5), (7, 100, 1, 7), (7, 200, 1, 5), (9, 100, 1, 7), (11, 1, 0, 11)]


def test_linked_sets_share_a_signature():
    """In any order of common signatures, and for sizes at the edges of bands."""
    rng = np.random.default_rng(5)
    for trial in range(1500):
        n = int(rng.integers(1, 60)) if trial % 2 else int(rng.integers(60, 400))
        pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        a = np.unique(pool[:n])
        drop, add = int(rng.integers(0, n // 7 + 1)), int(rng.integers(0, n // 3 + 1))
        b = np.unique(np.concatenate([a[drop:], pool[n : n + add]]))
        if linked(a, b):
            every = np.unique(np.concatenate([signatures(a, every=True), signatures(b, every=True)]))
            some = every[rng.random(len(every)) < rng.random()]
            common = some, rng.integers(3, 50, len(some))
            assert np.intersect1d(signatures(a, common), signatures(b, common)).size
            assert near_sketches(np.array([len(a)]), np.array([len(b)]), [sketch(a)], [sketch(b)]).all()


def test_bands_cover_all_partners():
    for size in range(1, 400):
        for other in range(size, size * 4 // 3 + 1):
            assert set(instances(size)) & set(instances(other))
            (t,) = [t for t in instances(size) if jaccard_join.band(t)[0] <= size <= jaccard_join.band(t)[1]]
            assert t in instances(other)
            assert parts(t)[1] >= (size + other) // 7


def test_shingles():
    assert len(shingles("A b c d e f")) == 2 and len(shingles("a b")) == 1 and not len(shingles(" \t\n")) and not len(shingles(None))
    assert shingles("A B").tolist() == shingles("a\tb").tolist() != shingles("é b").tolist()
    assert len(shingle_sets([(1, "a b c d e f")])[1]) == 2


def test_odd_rows(odd, documents):
    got = join(odd).collect()
    assert len(got) == 7
    by = {r.doc_id: r for r in got}
    assert (by[1].component_id, by[1].n_shingles, by[2].component_id) == (1, 0, 2)
    assert by[3].n_shingles == 1 and by[4].component_id == 4 and by[None].component_id is None
    assert join(documents([])).collect() == []


def test_one_hot_group(documents):
    rows = [(i, "a b c d e f g h") for i in range(300)] + [(1000 + i, f"a b c d e f g h i{i % 3}") for i in range(50)]
    got = {r.component_id for r in join(documents(rows)).collect()}
    assert got == {0}
