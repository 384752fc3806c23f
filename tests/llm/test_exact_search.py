import math
import random

import numpy as np
import pytest

from tidewater.llm import exact_search
from tidewater.llm.exact_search import Shard, search


def brute(rows, k=5):
    q = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for i in q:
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q[i], v)), j) for j, v in q.items() if j != i)
            out |= {(i, r, j, -s) for r, (s, j) in enumerate(scored[:k], 1)}
    return out


@pytest.mark.parametrize("spread", ["even", "skew"])
def test_same_as_brute_force(spark, monkeypatch, spread):
    rng = random.Random(3)
    scale = [1.0] * 12 if spread == "even" else [2.0 ** -i for i in range(12)]
    rows = [(i, [rng.gauss(0, s) for s in scale]) for i in range(400)] + [(500 + i, [0.5] * 12) for i in range(20)]
    rows += [(600, None), (650, [0.1, None] + [0.0] * 10), (700, [float("nan")] * 12), (None, [0.1] * 12), (750, [float("inf")] * 12), (800, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS score", "2 AS rank").repartition(5)
    monkeypatch.setattr(exact_search, "BLOCK_BYTES", 300)
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in search(df).collect()}
    assert got == brute(rows)


def test_bounds_spare_probes():
    rng = np.random.default_rng(1)
    rows = np.rint(rng.normal(0, 1, (4000, 32)) * np.geomspace(500, 1, 32)).astype(np.int64)
    shard = Shard(np.array([-1]), rows[:1], 5)
    for i in range(0, 4000, 500):
        shard.add(np.arange(i, i + 500), rows[i : i + 500])
    assert shard.probed < 4000 * 31
    want = np.argsort(-(rows @ rows[0]), kind="stable")[:5]
    assert shard.best[0][1].tolist() == want.tolist()


def test_sums_beyond_a_long(spark):
    """Components of 2^45 and more, whose products no long holds: scores are exact up to its ends."""
    rows = [(0, [2.0**40, 1.0, 2.0**30]), (1, [1.0, 2.0**20, 0.5]), (2, [-(2.0**40), 0.0, 3.0]), (3, [2.0**40, 5.0, 0.0]), (4, [1e300, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ends = lambda x: max(-(2**63), min(2**63 - 1, x))
    q = {i: [ends(math.floor(256 * x)) for x in v] for i, v in rows}
    want = sorted(((-ends(sum(a * b for a, b in zip(q[0], v))), j) for j, v in q.items() if j))
    assert [(-r.score, r.vec_id) for r in search(df).orderBy("rank").collect()] == want


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in search(df).collect()] == [(0, 1, 1, 256 * 512)]
    assert search(df.where("vec_id = 0")).collect() == []
    assert search(df.limit(0)).collect() == []
    assert search(df.where("vec_id = 1")).collect() == []
