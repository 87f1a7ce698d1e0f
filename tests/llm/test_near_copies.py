"""The pipeline's near-dedup stage against brute-force Jaccard similarity of five-word shingles."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from tablemill.llm import near_copies

SF = "/root/testdata/sf0.01"
WORD = re.compile("[^\x20\x09-\x0d]+")


def sets_of(texts):
    words = [WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    return [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def kept_of(rows):
    """Positions of the rows that stay, by joining every pair that is alike."""
    sets = sets_of([t for _, t in rows])
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if label[a] != label[b] and alike(sets[a], sets[b]):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    least = {}
    for (i, _), c in zip(rows, label, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return [k for k, ((i, _), c) in enumerate(zip(rows, label, strict=True)) if least.get(c) in (None, i)]


def some_rows():
    """Texts changed until about 0.8 of their shingles stay, on both sides of it, short ones, and a line that many have."""
    rng = random.Random(12)
    words = lambda n: ["".join(rng.choices("abcdefgh", k=5)) for _ in range(n)]
    texts, line = [], words(12)
    for n in [5, 6, 8, 9, 10, 14, 20, 40, 80, 200, 500] * 3:
        base = words(n)
        texts.append(" ".join(base))
        for _ in range(3):
            w = list(base)
            for at in rng.sample(range(n), rng.randint(0, 1 + n // 40)):
                w[at] = "changed"
            texts.append("\n".join(w).upper())
        texts += [" ".join([*base, *words(max(1, n // 5))]), " ".join([*line, *words(n)])]
    texts += ["", None, " \t", "x", "X", "x y", "x x x x x x x x", "x " * 50]
    rows = list(zip(rng.sample(range(5000), len(texts)), texts, strict=True))
    return [*rows, rows[3], (rows[3][0], "another text of a repeated id"), (None, texts[0]), (None, "alone here"), (None, None)]


@pytest.mark.parametrize("unit_rows", [4096, 8])
def test_near_dedup_reaches_every_pair(spark, monkeypatch, unit_rows):
    monkeypatch.setattr(near_copies, "UNIT_ROWS", unit_rows)
    rows = some_rows()
    want = [rows[k] for k in kept_of(rows)]
    assert 40 < len(want) < len(rows) - 40
    docs = spark.createDataFrame([(i, t, "f") for i, t in rows], "doc_id long, text string, fingerprint string")
    got = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(map(repr, got.select("doc_id", "text").collect())) == sorted(map(repr, spark.createDataFrame(want, "doc_id long, text string").collect()))
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), SF).count() == 0


def test_stage_on_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").dropDuplicates(["text"])
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()}
    assert got == {rows[k][0] for k in kept_of(rows)}


def test_similar_parts():
    rng = random.Random(3)
    bases = [rng.sample(range(10**6), rng.randint(1, 40)) for _ in range(12)]
    sets = [np.array(sorted({*rng.sample(b, max(1, len(b) - rng.randint(0, 6))), *rng.sample(range(10**6), rng.randint(0, 3))}), np.uint64) for b in bases for _ in range(8)]
    got = near_copies.similar_parts(sets)
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if alike(set(sets[a].tolist()), set(sets[b].tolist())):
                label = [label[b] if x == label[a] else x for x in label]
    assert {(a, b) for a in range(len(sets)) for b in range(a) if got[a] == got[b]} == {(a, b) for a in range(len(sets)) for b in range(a) if label[a] == label[b]}
