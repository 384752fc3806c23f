import random
import zlib

from pyspark.sql import functions as F

from tidewater.llm import sharding
from tidewater.llm.sharding import plan, shard


def smallest(weights, k):
    """Smallest capacity, by trying each in turn."""
    c = max([*weights, -(-sum(weights) // k)])
    while True:
        n, at = 1, 0
        for w in weights:
            n, at = (n, at + w) if at + w <= c else (n + 1, w)
        if n <= k:
            return c
        c += 1


def test_plan_is_exact(spark, monkeypatch):
    monkeypatch.setattr(sharding, "HISTOGRAM_ROWS", 32)  # several rounds
    rng = random.Random(3)
    for k, n, spread in ((4, 50, 1), (16, 300, 1000), (3, 5, 10**12), (7, 200, 3)):
        ids = sorted(rng.sample(range(-spread * n, spread * n * 2 + 10), n))
        weights = [rng.choice([1, 2, 9, 50, 400]) for _ in ids]
        capacity, firsts = plan(spark.createDataFrame(list(zip(ids, weights)), "gid long, weight long"), k)
        assert capacity == smallest(weights, k)
        shards = [0] * k
        for i, w in zip(ids, weights):
            shards[sum(i >= f for f in firsts)] += w
        assert max(shards) == capacity or max(shards) <= capacity


def test_rows(documents):
    rng = random.Random(5)
    rows = [(i, rng.choice(["same text", None, "t%d" % i * rng.randint(1, 50)]), "en", "s") for i in range(500)]
    got = shard(documents(rows), 16).collect()
    text = {r[0]: r[1] for r in rows}
    assert len(got) == 500
    shards, of = {}, {}
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert r["size"] == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw) and r.law == "bytes" and r.grown_shard is None
        shards.setdefault(r.shard, []).append((r.slot, r.doc_id))
        assert of.setdefault(text[r.doc_id], r.shard) == r.shard
    for s, rows in shards.items():
        assert 0 <= s < 16
        assert [x for x, _ in sorted(rows)] == list(range(len(rows)))
        assert [d for _, d in sorted(rows)] == sorted(d for _, d in rows)


def test_near_equal(documents):
    got = shard(documents([(i, "x" * (i % 97), "en", "s") for i in range(3000)]), 16).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert len(got) == 16
    assert max(r.b for r in got) < 1.6 * min(r.b for r in got)


def test_odd_rows(odd, documents):
    got = shard(odd, 4).collect()
    assert len(got) == 7
    by = {r.doc_id: r for r in got}
    assert by[1]["size"] == 1 and by[1].text_crc32 == 0 and by[1].shard == by[2].shard
    assert by[3]["size"] == 300_001
    assert shard(documents([]), 4).collect() == []
