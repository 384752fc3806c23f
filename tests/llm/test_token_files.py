import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidewater.llm import token_files
from tidewater.llm.token_files import Encoder, Reader, read_back, write

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_pieces_give_the_ids_of_the_whole(library, monkeypatch):
    rng = random.Random(2)
    parts = ["a", "The", " ", " ", " ", "  ", "\n", "\t", " ", " ", "don't", "'s", "12", "été", "\U0001f600", "###", "<|endoftext|>", "\r\n", "\x00", "　", "\x1c", "."]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(5000)]
    texts += ["x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "a <|endof text|> b"]
    texts += [" ".join(rng.choices(["a", "b<|endoftext|>", "<|", "the", "c"], k=6)) for _ in range(500)]
    assert library.encode("x <|endoftext|> y", add_special_tokens=False).ids != Encoder(PATH).library.encode("x <|endof text|> y", add_special_tokens=False).ids
    for t, packed in zip(texts, Encoder(PATH).encode(texts)):
        assert np.frombuffer(packed, "<u2").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
    monkeypatch.setattr(token_files, "CACHED", 30)
    encoder = Encoder(PATH)
    assert [x for i in range(0, len(texts), 50) for x in encoder.encode(texts[i : i + 50])] == Encoder(PATH).encode(texts) and encoder.older


def test_round_trip(spark, documents, library, tmp_path):
    rng = random.Random(4)
    rows = [(i * 3, " ".join(rng.choices(["alpha", "b", "c,", "été", "x\ny"], k=rng.choice([0, 1, 40, 900]))), "en", "s") for i in range(150)]
    rng.shuffle(rows)
    manifest = write(documents(rows).repartition(5), PATH, f"file://{tmp_path}/out", length=64, per_batch=4)
    got = {r.doc_id: r for r in read_back(manifest).collect()}
    at, stream = 0, []
    for doc_id, text, *_ in sorted(rows):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        r = got[doc_id]
        assert (r.start, r.n_tokens) == (at, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
        stream += ids
    flat = []
    for part in sorted(manifest.collect(), key=lambda r: r.part):
        reader = Reader(part.base)
        n = -(-part.n_tokens // 64)
        for i in range(n):
            mask = reader.mask(i)
            assert not reader.mask_bits(i).flags.owndata and not reader.sequence(i).flags.owndata
            assert mask.sum() == (64 if i < n - 1 else part.n_tokens - 64 * (n - 1))
            flat += reader.sequence(i)[mask].tolist()
    assert flat == stream


def test_rows_without_id_are_spread(spark, documents):
    rows = [(None, f"text {i} " * 50, "en", "s") for i in range(400)]
    manifest = write(documents(rows).repartition(5), PATH, file_bytes=20_000)
    assert max(r.n_docs for r in manifest.collect()) < 200
    one = [(r.start, r.n_tokens, r.ids_crc32) for r in read_back(manifest).orderBy("start").collect()]
    again = read_back(write(documents(rows[::-1]).repartition(3), PATH, file_bytes=20_000))
    assert one == [(r.start, r.n_tokens, r.ids_crc32) for r in again.orderBy("start").collect()]


def test_odd_rows(odd, documents):
    got = sorted(read_back(write(odd, PATH)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 4, 4, 6]
    assert got[1].n_tokens == got[2].n_tokens == 1
    assert got[3].n_tokens > 60_000
    assert read_back(write(documents([]), PATH)).collect() == []
