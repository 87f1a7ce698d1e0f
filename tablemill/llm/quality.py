"""Quality rules as a short-circuit cascade.

Each rule's cost and the documents that it rejects are measured on a sample of every partition's rows, those that the base
rules let through; the next rule is always the one with most rejections per second of cost among the documents that the
rules before it keep. A document leaves the cascade at the first rule that rejects it. The verdict is a conjunction, so
the order changes the cost but not the result.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import wider

#: Rows of each partition on which costs and selectivities are estimated.
SAMPLE_ROWS = 64
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))


def _base(text: str) -> tuple[int, int, int, int, int]:
    raw = text.encode()
    words = raw.split()  # bytes split on exactly 0x20 and 0x09-0x0D
    n = len(words)
    chars = sum(map(len, words))
    if len(raw) != len(text):
        chars -= len(raw) - len(text)  # white space is ASCII, so every continuation byte lies in a word
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return n, chars, symbols, len(lines) - len(set(lines)), _repeated(words)


def _repeated(words: list[bytes]) -> int:
    """Words in windows of WINDOW words that occur twice or more; windows are compared as exact mixed-radix numbers."""
    m = len(words) - WINDOW + 1
    if m < 2:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    key, span = w[:m], len(ids)
    for k in range(1, WINDOW):
        if span > 2**62 // len(ids):
            _, key = np.unique(key, return_inverse=True)
            span = m
        key, span = key * len(ids) + w[k : k + m], span * len(ids)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(m, bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_fails(m: tuple) -> bool:
    return m[0] < 10 or 100 * m[4] > 20 * m[0]


def _shouting(text: str, m: tuple) -> bool:
    raw = text.encode()
    upper, lower = (len(raw) - len(raw.translate(None, x)) for x in (_UPPER, _LOWER))
    return upper > lower and m[0] >= 20


#: Name -> true if the rule rejects (text, metrics).
RULES: dict[str, Callable[[str, tuple], bool]] = {
    "symbols": lambda t, m: m[2] > 0.1 * m[0],
    "word_length": lambda t, m: not 2 * m[0] <= m[1] <= 20 * m[0],
    "duplicate_lines": lambda t, m: m[3] >= 5 and m[3] > 0.3 * (t.count("\n") + 1),
    "exclamation": lambda t, m: t.count("!") > 0.3 * m[0],
    "shouting": _shouting,
    "word_variety": lambda t, m: m[0] >= 50 and len(set(t.encode().split())) < 0.1 * m[0],
}


def measure(texts: list[str]) -> list[tuple[int, int, list[float]]]:
    """(bit k set where rule k rejects, documents of that kind, seconds of each rule on them); base failures are left out."""
    found: dict[int, tuple[int, list[float]]] = {}
    for t in texts:
        m = _base(t)
        if base_fails(m):
            continue
        kind, took = 0, []
        for k, rule in enumerate(RULES.values()):
            began = time.perf_counter()
            kind |= bool(rule(t, m)) << k
            took.append(time.perf_counter() - began)
        n, before = found.get(kind, (0, [0.0] * len(RULES)))
        found[kind] = n + 1, [a + b for a, b in zip(before, took, strict=True)]
    return [(kind, n, took) for kind, (n, took) in found.items()]


def order_rules(kinds: list[tuple[int, int, list[float]]]) -> list[str]:
    """Rules by rejections per cost, each among the documents that the rules before it keep; without any, by cost."""
    total = max(1, sum(n for _, n, _ in kinds))
    cost = [max(1e-9, sum(took[k] for _, _, took in kinds) / total) for k in range(len(RULES))]
    names, left, out = list(RULES), kinds, []
    todo = list(range(len(names)))
    while todo:
        hits = {k: sum(n for kind, n, _ in left if kind >> k & 1) for k in todo}
        best = min(todo, key=lambda k: (-hits[k] / cost[k], cost[k], k))
        out.append(names[best])
        todo.remove(best)
        left = [x for x in left if not x[0] >> best & 1]
    return out


def plan(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """The order of the rules, from at most sample_rows rows of each partition, measured where they are.

    No text leaves its task: what travels is one row for each set of rejecting rules, 64 at most after the aggregate.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str] = []
        for b in batches:
            texts += b.column(0).slice(0, sample_rows - len(texts)).to_pylist()
            if len(texts) >= sample_rows:
                break
        yield pa.RecordBatch.from_pylist([{"kind": k, "n": n, "took": took} for k, n, took in measure(texts)], schema)

    schema = pa.schema([("kind", pa.int32()), ("n", pa.int64()), ("took", pa.list_(pa.float64()))])
    sample = docs.where(F.col("text").isNotNull() & (F.rand(11) < 0.2)).select("text")
    rows = sample.mapInArrow(run, "kind int, n long, took array<double>")
    rows = rows.groupBy("kind").agg(F.sum("n").alias("n"), *(F.sum(F.col("took")[k]).alias(f"t{k}") for k in range(len(RULES)))).collect()
    return order_rules([(r["kind"], r["n"], [r[f"t{k}"] for k in range(len(RULES))]) for r in rows])


def quality(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """docs with the base metrics, base_failed, kept and rejected_by (base, a rule's name, or null).

    A null text has no words and fails the base rules. Columns of docs with these names are replaced. Rows are judged
    one by one, so ties, repeats, null ids and empty tables need no care.
    """
    made = (*METRICS, "base_failed", "kept", "rejected_by")
    base = docs.drop(*made)
    order = order or plan(docs)
    names = [*base.columns, *made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            metrics = [_base(t) for t in texts]
            by: list[str | None] = ["base" if base_fails(m) else None for m in metrics]
            left = [i for i, x in enumerate(by) if x is None]
            for name in order:
                rule, still = RULES[name], []
                for i in left:
                    if rule(texts[i], metrics[i]):
                        by[i] = name
                    else:
                        still.append(i)
                left = still
            cols = [pa.array([m[k] for m in metrics], pa.int64()) for k in range(len(METRICS))]
            cols += [pa.array([x == "base" for x in by]), pa.array([x is None for x in by]), pa.array(by, pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names)

    return base.mapInArrow(run, wider(base, **dict.fromkeys(METRICS, "long"), base_failed="boolean", kept="boolean", rejected_by="string"))
