import random

import pytest

from tidewater.llm.mixing import mix, mixed


def goals(sizes, share, weights, most):
    """Shares in rounds, as the contract words them."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, free = dict.fromkeys(order, 0.0), share * sum(sizes.values()), set(order)
    while left > 1e-9 and free:
        each = left / sum(w[s] for s in free)
        left = 0.0
        for s in list(free):
            target[s] += each * w[s]
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                free.discard(s)
    return target


def test_targets_and_taken(documents):
    rng = random.Random(1)
    rows = [(i, "w " * rng.choice([1, 5, 30, 200]), "en", rng.choice(["a", "a", "a", "a", "b", "c", "d", None, "eé"])) for i in range(600)]
    got = mix(documents(rows)).collect()
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = goals(sizes, 1.5, (5, 2, 1), 2.0)
    assert len(got) == len(rows)
    for s, size in sizes.items():
        mine = [r for r in got if r.source == s]
        assert {r.source_size for r in mine} == {size}
        assert mine[0].target == pytest.approx(want[s])
        assert abs(sum(r.taken for r in mine) - want[s]) <= max(r.size for r in mine) + 1e-6
        assert all(r.taken <= 2 * r.size and r.taken == r.copies * r.size for r in mine)


def test_partitioning_does_not_matter(documents):
    df = documents([(i, "a b c" * (i % 7), "en", "s" * (i % 3)) for i in range(200)])
    one, other = ({(r.doc_id, r.taken) for r in mix(x).collect()} for x in (df.coalesce(1), df.repartition(9)))
    assert one == other


def test_odd_rows(odd, documents):
    rows = mix(odd).collect()
    assert len(rows) == 7
    by = {(r.doc_id, r.source): r for r in rows}
    assert by[1, None].size == 0 and by[1, None].taken == 0
    assert by[3, "a"].size == 60_000
    assert by[6, None].size == 1
    assert mix(documents([])).collect() == []
    only_empty = mix(documents([(1, "", "en", "a"), (2, None, "en", None)])).collect()
    assert [(r.target, r.taken) for r in only_empty] == [(0.0, 0), (0.0, 0)]


def test_mixed_repeats_documents(documents):
    df = documents([(i, "a b", "en", "s") for i in range(40)])
    out = mixed(df)
    assert out.columns == df.columns
    assert out.count() == 60


@pytest.mark.parametrize("written", [False, True])
def test_mixed_takes_each_row_by_itself(spark, documents, tmp_path, written):
    """Null and repeated ids, in sources with other rates, and columns with the names that the operator uses."""
    rows = [(None, f"n{i} " * 10, "en", "b") for i in range(11)] + [(None, f"m{i} " * 10, "en", "a") for i in range(40)]
    rows += [(7, f"r{i} " * 10, "en", "c") for i in range(10)] + [(None, "", "en", "b"), (3, None, None, None)]
    df = documents(rows, _id=1, _copies=2, _key=3, _row=4, _k=5, _copy=6, size=7, copies=8, _h=9, _file=10, _at=11)
    if written:
        df.repartition(3).write.parquet(f"{tmp_path}/docs")
        df = spark.read.parquet(f"{tmp_path}/docs")
    taken = {}
    for r in mix(df).collect():
        taken[r.source] = taken.get(r.source, 0) + r.taken
    out = mixed(df)
    assert out.columns == df.columns
    got = {}
    for r in out.collect():
        got[r.source] = got.get(r.source, 0) + len(r.text.split())
        assert (r._id, r._copies, r._key, r._row, r._k, r._copy, r["size"], r.copies, r._h, r._file, r._at) == tuple(range(1, 12))
    assert got == {s: n for s, n in taken.items() if n}
    assert mixed(documents([])).collect() == []
