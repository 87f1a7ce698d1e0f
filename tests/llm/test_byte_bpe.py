"""Byte-level BPE of many long words against an independent library, under the query's memory limit."""

import random

import pytest

from tablemill.llm import byte_bpe


@pytest.fixture(scope="module")
def models():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    return byte_bpe.ByteBPE(path, P.PATTERN), known


def check(models, words):
    model, known = models
    for w, ids in zip(words, model.encode_words([w.encode() for w in words]), strict=True):
        assert ids.tolist() == known.encode_ordinary(w), w[:50]


def test_many_distinct_words_of_90_bytes(models):
    rng = random.Random(1)
    words = list({"".join(map(chr, rng.choices(range(0x4E00, 0x9FA6), k=30))) for _ in range(200_000)})
    assert len(words) > 199_000
    check(models, words)


def test_words_without_a_place_to_cut(models):
    rng = random.Random(2)
    letters = "etaoinshrdlu"
    check(models, ["".join(rng.choices(letters, k=n)) for n in [1, 2, 3, 90, 97, 500, 1500, 2048, 2049, 5000] for _ in range(3)])
    check(models, ["".join(rng.choices(letters, k=90)) for _ in range(1500)])


def test_a_word_of_a_megabyte(models):
    rng = random.Random(3)
    check(models, ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000)), "a" * 300_000, "".join(map(chr, rng.choices(range(0x4E00, 0x9FA6), k=350_000)))])


def test_rows_of_a_query_do_not_change_ids(models, monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choices("abeé日本 ", k=rng.randint(0, 40))).replace(" ", "") for _ in range(300)]
    words = [w for w in words if w]
    whole = [x.tolist() for x in models[0].encode_words([w.encode() for w in words])]
    for rows, long in ((50, 2048), (3_000_000, 3)):
        monkeypatch.setattr(byte_bpe, "QUERY_ROWS", rows)
        monkeypatch.setattr(byte_bpe, "LONG_BYTES", long)
        assert [x.tolist() for x in models[0].encode_words([w.encode() for w in words])] == whole


def test_batch_of_empty_texts(models):
    assert list(models[0].batch(["", ""])) == [(b"", b"")] * 2
    assert models[0].encode_words([]) == [] and [len(x) for x in models[0].encode_words([b"", b"a", b""])] == [0, 1, 0]
