"""Toxic spans by a linear-chain conditional random field.

Documents carry labels, tokens don't; a training token is tagged toxic if it stands in a toxic document and its word or
one of its prefixes is found in toxic documents far more often than in others. The chain has two tags. A token's
potential sums weights of its word and prefixes, which the fit learns together with the transitions by maximising the
conditional likelihood with forward-backward expectations. A document's score is a logistic function of its tokens'
forward-backward marginals; tokens with a marginal above one half are its offending spans.

The fit uses at most FIT_DOCS labelled documents of each label, the first by a hash of doc_id, and of those the texts of
at most FIT_CHARS characters, which bounds what the driver holds to 2 * FIT_DOCS * FIT_CHARS characters, 60 million;
scores use whole texts.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import released, wider
from tablemill.llm.simhash import fingerprint

#: Labelled documents of each label that the fit uses at most.
FIT_DOCS = 1500
#: Longest text that the fit uses.
FIT_CHARS = 20_000
#: Features that are kept at most, those of most support first.
MAX_FEATURES = 100_000
THRESHOLD = 0.7
#: A feature is evidence of toxicity if chance explains its documents' labels with e to the power of minus this at most.
SURPRISE = 12.0
PREFIXES = (4, 5, 6)
#: Tokens that one forward-backward run holds.
RUN_TOKENS = 500_000
_SPLIT = bytes(i if chr(i).isalnum() or i >= 128 else 32 for i in range(256))


def tokens(text: str) -> list[bytes]:
    """Lower-cased runs of ASCII letters and digits and of all other characters beyond ASCII."""
    return text.lower().encode().translate(_SPLIT).split()


def features(token: bytes) -> list[bytes]:
    word = token.decode()
    return [token, *(b"^" + word[:n].encode() for n in PREFIXES if len(word) > n)]


@dataclass
class Model:
    weights: dict[bytes, float] = field(default_factory=dict)
    bias: float = -6.0
    #: Log-potentials of tags (0, 1), (1, 0) and (1, 1), against (0, 0).
    into: float = 0.0
    out: float = 0.0
    stay: float = 0.0
    #: Score: sigmoid(a + b * log(1 + sum of marginals) + c * largest marginal).
    a: float = -4.0
    b: float = 4.0
    c: float = 1.0

    def odds(self, token: bytes) -> float:
        s = self.bias + sum(self.weights.get(f, 0.0) for f in features(token))
        return math.exp(max(-20.0, min(20.0, s)))


class _Odds(dict):
    """Odds by token, worked out when first met."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, token: bytes) -> float:
        if len(self) > 400_000:
            self.clear()
        self[token] = v = self.model.odds(token)
        return v


def marginals(odds: list[np.ndarray], model: Model, pairs: np.ndarray | None = None) -> list[np.ndarray]:
    """P(tag 1) of each token, by forward-backward over all sequences at once.

    The recursions run on odds of tag 1, step by step over the sequences that still have a token at that step. To pairs,
    if given, the expected numbers of neighbours with tags (0, 1), (1, 0) and (1, 1) are added.
    """
    order = sorted(range(len(odds)), key=lambda i: -len(odds[i]))
    sizes = np.array([len(odds[i]) for i in order])
    out: list[np.ndarray] = [np.zeros(0)] * len(odds)
    if not len(sizes) or not sizes[0]:
        return out
    active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), side="right")
    start = np.concatenate([[0], np.cumsum(active)])
    flat = np.empty(start[-1])
    for k, i in enumerate(order):
        flat[start[: sizes[k]] + k] = odds[i]
    into, stay, leave = math.exp(model.into), math.exp(model.stay), math.exp(model.out)
    ahead = flat.copy()
    for t in range(1, len(active)):
        r = ahead[start[t - 1] : start[t - 1] + active[t]]
        ahead[start[t] : start[t + 1]] *= (into + stay * r) / (1 + leave * r)
    back = np.ones_like(flat)
    for t in range(len(active) - 2, -1, -1):
        x = flat[start[t + 1] : start[t + 2]] * back[start[t + 1] : start[t + 2]]
        back[start[t] : start[t] + active[t + 1]] = (leave + stay * x) / (1 + into * x)
    if pairs is not None:
        for t in range(1, len(active)):
            left = ahead[start[t - 1] : start[t - 1] + active[t]]
            right = flat[start[t] : start[t + 1]] * back[start[t] : start[t + 1]]
            ways = np.array([into * right, leave * left, stay * left * right])
            pairs += (ways / (1 + ways.sum(0))).sum(1)
    both = ahead * back
    both /= 1 + both
    for k, i in enumerate(order):
        out[i] = both[start[: sizes[k]] + k]
    return out


def _in_runs(seqs: list, limit: int = RUN_TOKENS) -> Iterator[list]:
    part, n = [], 0
    for s in seqs:
        if part and n + len(s) > limit:
            yield part
            part, n = [], 0
        part.append(s)
        n += len(s)
    if part:
        yield part


def _surprise(k: int, n: int, p: float) -> float:
    """Minus log of a bound on the chance that k or more of n documents are toxic at random (Chernoff)."""
    q = k / n
    return 0.0 if q <= p else n * (q * math.log(q / p) + (0 if q == 1 else (1 - q) * math.log((1 - q) / (1 - p))))


def _tags(docs: list[list[bytes]], labels: list[int]) -> tuple[list[np.ndarray], set[bytes]]:
    """Tags of the training tokens and the features that are evidence of toxicity."""
    seen = (Counter(), Counter())
    for words, y in zip(docs, labels, strict=True):
        seen[y].update({f for w in set(words) for f in features(w)})
    n0, n1 = max(1, labels.count(0)), max(1, labels.count(1))
    strong = {f for f, k in seen[1].items() if _surprise(k, k + seen[0][f], n1 / (n0 + n1)) > SURPRISE}
    tag = {w: any(f in strong for f in features(w)) for d in docs for w in set(d)}
    return [np.fromiter((y == 1 and tag[w] for w in d), bool, len(d)) for d, y in zip(docs, labels, strict=True)], strong


def _without_copies(texts: list[str], bits: int = 12) -> list[int]:
    """Texts that aren't near copies of an earlier one: copies would pass for independent evidence of each word they hold."""
    prints = np.array([fingerprint(t) for t in texts], np.int64).view(np.uint64)
    kept: list[int] = []
    for i, x in enumerate(prints):
        if not len(kept) or np.bitwise_count(prints[kept] ^ x).min() > bits:
            kept.append(i)
    return kept


def fit(texts: list[str], labels: list[int], rounds: int = 12) -> Model:
    """A model of labelled texts; without a toxic one, scores are near zero."""
    model = Model()
    alone = _without_copies(texts)
    texts, labels = [texts[i] for i in alone], [labels[i] for i in alone]
    docs = [tokens(t) for t in texts]
    tags, strong = _tags(docs, labels)
    if not strong:
        model.a = -6.0
        return model
    support = Counter(f for d in docs for w in set(d) for f in features(w) if f in strong or len(f) < 8)
    kept = [f for f, _ in sorted(support.items(), key=lambda x: (x[0] not in strong, -x[1], x[0]))[:MAX_FEATURES] if f in strong or support[f] >= 50]
    place = {f: k for k, f in enumerate(kept)}
    words = sorted({w for d in docs for w in d})
    number = {w: k for k, w in enumerate(words)}
    pairs = [(k, place[f]) for k, w in enumerate(words) for f in features(w) if f in place]
    of_word, of_feature = (np.array(c, np.int64) for c in zip(*pairs, strict=True))
    ids = [np.fromiter((number[w] for w in d), np.int64, len(d)) for d in docs]
    flat, gold = np.concatenate(ids), np.concatenate(tags).astype(float)
    # All that the expectations are held against.
    seen_words = np.bincount(flat, gold, len(words))
    seen_pairs = np.array([sum(int((y[:-1] == a).astype(int) @ (y[1:] == b).astype(int)) for y in tags) for a, b in ((0, 1), (1, 0), (1, 1))], float)
    weight = np.array([4.0 if f in strong else 0.0 for f in kept])
    grad2 = np.full(len(kept) + 4, 1e-2)
    for step in range(rounds):
        score = np.full(len(words), model.bias) + np.bincount(of_word, weight[of_feature], len(words))
        odds = np.exp(np.clip(score, -20, 20))
        p: list[np.ndarray] = []
        expected = np.zeros(3)
        for part in _in_runs(ids):
            p += marginals([odds[x] for x in part], model, expected)
        got = np.concatenate(p)
        excess = seen_words - np.bincount(flat, got, len(words))
        g_feature = np.bincount(of_feature, excess[of_word], len(kept)) - 0.05 * weight
        edge = seen_pairs - expected
        g = np.concatenate([g_feature, [excess.sum()], edge])
        grad2 += g * g
        move = 1.0 * g / np.sqrt(grad2)
        weight += move[:-4]
        model.bias += move[-4]
        model.into, model.out, model.stay = (float(np.clip(x + m, -3, 3)) for x, m in zip((model.into, model.out, model.stay), move[-3:], strict=True))
    model.weights = {f: float(w) for f, w in zip(kept, weight, strict=True) if abs(w) > 0.05}
    _calibrate(model, docs, labels)
    return model


def _evidence(p: np.ndarray) -> tuple[float, float]:
    return math.log1p(float(p.sum())), float(p.max()) if len(p) else 0.0


def _calibrate(model: Model, docs: list[list[bytes]], labels: list[int]) -> None:
    lut = _Odds(model)
    found = [_evidence(q) for part in _in_runs(docs) for q in marginals([np.array([lut[w] for w in d]) for d in part], model)]
    x = np.column_stack([np.ones(len(found)), np.array(found)])
    y = np.array(labels, float)
    w = np.zeros(3)
    for _ in range(30):  # Newton's steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3)
        w = w + np.linalg.solve(h, x.T @ (y - p) - 0.05 * w)
    model.a, model.b, model.c = map(float, w)


def train(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS) -> Model:
    """Fit on rows of labels(doc_id, toxic) whose crc32 of doc_id as text mod 3 is not 1; null labels and texts are left out.

    Rows of docs that share a doc_id count once, with the least of their texts of at most fit_chars characters, however
    many they are. Empty tables give a model whose scores are near zero.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("r", F.xxhash64("doc_id"))
    picked = usable.where("toxic = 1").orderBy("r", "doc_id").limit(fit_docs).unionByName(usable.where("toxic = 0").orderBy("r", "doc_id").limit(fit_docs))
    # At most 2 * fit_docs ids: a bounded broadcast, which spares a shuffle of the texts.
    usable_docs = docs.where(F.length("text") <= fit_chars).select("doc_id", "text")
    found = usable_docs.join(F.broadcast(picked.select("doc_id", "toxic")), "doc_id")
    rows = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    rows = sorted(rows, key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["text"]))
    return fit([r["text"] for r in rows], [r["toxic"] for r in rows])


def spans_of(text: str, p: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of runs of tokens whose marginal is over one half, in code points of the lower-cased text."""
    lowered = text.lower()
    places = [m.span() for m in re.finditer(r"[0-9a-z\u0080-\U0010ffff]+", lowered)]
    out: list[tuple[int, int]] = []
    last = -2
    for k in np.flatnonzero(p > 0.5).tolist():
        if k == last + 1:
            out[-1] = (out[-1][0], places[k][1])
        else:
            out.append(places[k])
        last = k
    return out


def score_toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD, spans: bool = True) -> DataFrame:
    """docs with score (0 to 1), predicted (1 if score >= threshold) and, if asked for, spans of offending tokens.

    A null text scores as an empty one. Rows are scored one by one; columns of docs with these names are replaced.
    """
    made = ["score", "predicted", *(["spans"] if spans else [])]
    base = docs.drop("score", "predicted", "spans")
    names = [*base.columns, *made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lut = _Odds(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                texts = [t or "" for t in b.column("text").to_pylist()]
                p: list[np.ndarray] = []
                for part in _in_runs([tokens(t) for t in texts]):
                    p += marginals([np.array([lut[w] for w in d]) for d in part], model)
                z = [model.a + model.b * s + model.c * m for s, m in map(_evidence, p)]
                score = [1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) for x in z]
                cols = [pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32())]
                if spans:
                    found = [[{"start": s, "end": e} for s, e in spans_of(t, q)] if len(q) and q.max() > 0.5 else [] for t, q in zip(texts, p, strict=True)]
                    cols.append(pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
                yield pa.RecordBatch.from_arrays([*b.columns, *cols], names)

    shape = {"score": "double", "predicted": "int"} | ({"spans": "array<struct<start:int,end:int>>"} if spans else {})
    return base.mapInArrow(released(run), wider(base, **shape))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, as they were; a null text scores as an empty one, each row by itself."""
    return score_toxicity(docs, model, threshold, spans=False).where("predicted = 0").select(*docs.columns)
