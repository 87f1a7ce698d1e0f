"""Passages that a third of the documents has, within and across batches, against brute force."""

import hashlib
import random

import pytest

from tablemill.llm import shared_windows, substring_dedup, suffix_array


def rows_of(seed):
    """A common passage in different surroundings, runs of one word, copies, repeated and null doc_ids."""
    rng = random.Random(seed)
    words = lambda n: ["".join(rng.choices("abcdefgh", k=4)) for _ in range(n)]
    passage, line, whole = words(70), words(8), words(120)
    texts = []
    for k in range(90):
        body = words(rng.randint(0, 60))
        if k % 3 == 0:
            body += passage + words(rng.randint(0, 60))
        if k % 5 == 0:
            body += ["same"] * rng.randint(40, 160)
        if k % 7 == 0:
            body += line + line
        if k % 4 == 0:
            body = whole
        texts.append(" ".join(body))
    rows = list(zip(rng.sample(range(1000), len(texts)), texts, strict=True))
    return [*rows, (rows[0][0], rows[3][1]), (rows[3][0], " ".join(passage)), (rows[6][0], rows[6][1]), (None, rows[9][1]), (2000, None), (2001, "")]


def removed(rows, symbols, n):
    """For each row, its symbols that stay: those in no window that also starts in a document of a smaller doc_id."""
    least = {}
    for i, text in rows:
        s = symbols(text)
        for at in range(len(s) - n + 1) if i is not None else ():
            key = tuple(s[at : at + n])
            least[key] = min(i, least.get(key, i))
    out = []
    for i, text in rows:
        s = symbols(text)
        gone = [False] * len(s)
        for at in range(len(s) - n + 1) if i is not None else ():
            if least[tuple(s[at : at + n])] < i:
                gone[at : at + n] = [True] * n
        out.append([x for x, g in zip(s, gone, strict=True) if not g])
    return out


@pytest.mark.parametrize("flush, many, parts", [(1_000_000, None, 1), (1_000_000, 2, 5), (60, 2, 3), (60, None, 9)])
def test_hot_passages(spark, monkeypatch, flush, many, parts):
    monkeypatch.setattr(shared_windows, "FLUSH", flush)
    options = {"digest": True} | ({"many": many} if many else {})
    rows = rows_of(parts)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    digest = lambda kept: hashlib.sha256(kept).hexdigest()
    got = substring_dedup.remove_substrings(docs, **options).select("doc_id", "kept_sha256").collect()
    want = [(i, digest(" ".join(kept).encode())) for (i, _), kept in zip(rows, removed(rows, lambda t: (t or "").split(), 50), strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    got = suffix_array.remove_repeats(docs, **options).select("doc_id", "kept_sha256").collect()
    want = [(i, digest(bytes(kept))) for (i, _), kept in zip(rows, removed(rows, lambda t: (t or "").encode(), 50), strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_a_repeated_window_is_one_row():
    """Whatever a run's length, a document tells one row of each of its windows."""
    import numpy as np
    import pyarrow as pa

    kind = shared_windows.Kind(True, 50, 25)
    n = 400
    asked = {"th": 0, "start": 0, "size": n, "code": 7, "split": 1}
    packed = [pa.array([np.array([v], shared_windows.ASKED[c]).tobytes()] * 2, pa.binary()) for c, v in ((c, asked[c]) for c in shared_windows.ASKED if c != "k")]
    texts = pa.array(["same " * n] * 2)
    names = ["text", "doc_id", "__sw_th", *(f"__sw_{c}s" for c in shared_windows.ASKED if c != "k")]
    b = pa.RecordBatch.from_arrays([texts, pa.array([4, 9]), pa.array([0, 0]), *packed], names)
    (out,) = shared_windows._cut_segments(kind)([b])
    assert sorted(zip(out.column("k").to_pylist(), out.column("done").to_pylist(), strict=True)) == [(4, False), (9, True)]
    assert all(np.frombuffer(x, np.int64).tolist() == list(range(n - 49)) for x in out.column("starts").to_pylist())
