import random

import corpus_pipeline
import pytest
from brute import contamination, near_components

from tidewater.llm.session import staged


@pytest.fixture
def folder(spark, documents, tmp_path):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(500)]
    bench = [(i, " ".join(rng.choices(words, k=20))) for i in range(5)]
    rows = [(i, " ".join(rng.choices(words, k=60)), rng.choice(["en", "de"]), rng.choice("abc")) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " tail", "en", "a") for i in range(10)]
    rows += [(200 + i, bench[i][1] + " " + rows[i][1].replace("w1", "u1"), "en", "b") for i in range(5)]
    rows += [(300, None, "en", "a"), (301, "12 34", "en", "a"), (302, "", None, None), (None, "no id at all", None, None), (40, "a second text of document forty", "en", "a")]
    df = documents(rows, score=1.5, n_words="x", copies=3, _id=4, _copies=5, _gone=6, _again=7, _rest=8, _row=9, _key=10)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows, bench


def test_stages_by_brute_force(spark, folder):
    where, rows, bench = folder
    docs = spark.read.parquet(f"{where}/documents.parquet")
    kept = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = staged(stage(spark, kept, where))
        assert kept.columns == docs.columns, name
        seen.append([(r.doc_id, r.text) for r in kept.collect()])
        assert {(r.score, r.n_words, r.copies, r._id, r._copies, r._gone, r._again, r._rest, r._row, r._key) for r in kept.collect()} == {(1.5, "x", *range(3, 11))}
    language, near, clean, mixed = seen
    assert sorted(language, key=str) == sorted(((i, t) for i, t, *_ in rows if t and any(c.isalpha() for c in t)), key=str)
    groups = near_components([x for x in language if x[0] is not None and x[1] != "a second text of document forty"])
    assert {i for i, _ in near} - {None} == {c for _, c in groups.values()}
    assert len(near) == len({i for i, _ in near})
    dirty = contamination(near, bench)
    assert sorted(clean, key=str) == sorted((x for x in near if not dirty[x[0]][4]), key=str)
    assert set(mixed) <= set(clean) and all(mixed.count(x) <= 2 for x in mixed)
    last = corpus_pipeline.STAGES[-1][1](spark, kept, where).collect()
    assert len(last) == len(mixed)


def test_empty_tables(spark, documents, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = documents([], _gone=1)
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.collect() == []


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder[0]).collect()
    assert rows and {r.law for r in rows} == {"bytes"}
