"""Substring dedup of words by suffix automata of reference shards.

A shard's reference segments build one generalised suffix automaton, each of whose states knows the least document that
its strings occur in. Segments stream through it for matching statistics: at each word, the longest suffix that the
reference has. Where that is `window` words or more and the state of that length belongs to a smaller document, the
window goes; windows that overlap make maximal spans.

Sending every shard's automaton to every document would read the corpus once a shard, so shards are cut by content:
segments that may share a window meet in one (see shared_windows). A reference of its own, of bounded size, is broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import wider
from tablemill.llm.shared_windows import MANY_CLASSES, Kind, merged, remove_shared

KIND = Kind(words=True, window=50, gram=16)
#: Words that a broadcast reference may have.
REFERENCE_WORDS = 2_000_000


class Automaton:
    """A generalised suffix automaton over words."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.size, self.owner = [-1], [0], [1 << 62]
        self.ready = False

    def add(self, words: list, owner: int) -> None:
        next_, link, size, own = self.next, self.link, self.size, self.owner
        last = 0
        for w in words:
            q = next_[last].get(w)
            if q is not None and size[q] == size[last] + 1:
                last = q
            else:
                if q is None:
                    new = self._state({}, size[last] + 1)
                    p = last
                    while p >= 0 and w not in next_[p]:
                        next_[p][w] = new
                        p = link[p]
                    if p < 0:
                        link[new] = 0
                    elif size[q := next_[p][w]] == size[p] + 1:
                        link[new] = q
                    else:
                        link[new] = self._split(p, w, q)
                    last = new
                else:
                    last = self._split(last, w, q)
            own[last] = min(own[last], owner)

    def _state(self, next_: dict, size: int) -> int:
        self.next.append(next_)
        self.link.append(0)
        self.size.append(size)
        self.owner.append(1 << 62)
        return len(self.next) - 1

    def _split(self, p: int, w: object, q: int) -> int:
        clone = self._state(self.next[q].copy(), self.size[p] + 1)
        self.link[clone], self.link[q] = self.link[q], clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def close(self) -> None:
        """Hand owners up the suffix links, longest states first."""
        for v in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            u = self.link[v]
            if self.owner[v] < self.owner[u]:
                self.owner[u] = self.owner[v]
        self.ready = True

    def matches(self, words: list, window: int) -> Iterator[tuple[int, int]]:
        """(end, least owner) of each window that the reference has."""
        next_, link, size, own = self.next, self.link, self.size, self.owner
        v = length = 0
        for at, w in enumerate(words, 1):
            while v and w not in next_[v]:
                v = link[v]
                length = size[v]
            if w in next_[v]:
                v = next_[v][w]
                length += 1
                while size[link[v]] >= window:
                    v = link[v]
                    length = size[v]
            if length >= window:
                yield at, own[v]


def solve(segments: list[bytes], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, start, end) of windows that a smaller owner's segment has."""
    words = [s.split(b" ") for s in segments]
    reference, owners = Automaton(), owner.tolist()
    for w, o in zip(words, owners, strict=True):
        reference.add(w, o)
    reference.close()
    found = [(k, end - KIND.window, end) for k, (w, o) in enumerate(zip(words, owners, strict=True)) for end, least in reference.matches(w, KIND.window) if least < o]
    return tuple(np.array(found, np.int64).reshape(-1, 3).T)


def _digest(text: str | None, spans: list[tuple[int, int]]) -> tuple:
    words, kept = _without((text or "").encode().split(), spans)
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def _without(words: list[bytes], spans: list[tuple[int, int]]) -> tuple[list[bytes], list[bytes]]:
    kept, at = [], 0
    for a, b in spans:
        kept += words[at:a]
        at = b
    return words, kept + words[at:]


def _kept(text: str | None, spans: list[tuple[int, int]]) -> tuple:
    """The text as it is where nothing goes, else its kept words joined by one space."""
    if not spans:
        return text, "[]"
    return b" ".join(_without((text or "").encode().split(), spans)[1]).decode(), str(spans)


def remove_substrings(docs: DataFrame, digest: bool = False, many: int = MANY_CLASSES["words"]) -> DataFrame:
    """docs with n_words, n_removed and kept_sha256, or without digest with kept_text and removed_spans (in words).

    A null text has no words. Equal doc_ids never take from each other; columns with the new names are replaced.
    """
    made = {"n_words": "long", "n_removed": "long", "kept_sha256": "string"} if digest else {"kept_text": "string", "removed_spans": "string"}
    return remove_shared(docs, KIND, solve, made, _digest if digest else _kept, many)


def remove_reference(docs: DataFrame, reference: DataFrame, window: int = KIND.window, shard_words: int = 200_000) -> DataFrame:
    """docs with kept_text and removed_spans: words of windows that reference(text) has.

    The reference is broadcast as the texts of its shards, each worker building a shard's automaton once; one of more
    than REFERENCE_WORDS words is refused. Null texts have no words; columns with the new names are replaced.
    """
    total = reference.select(F.sum(F.size(F.split("text", "[\\x20\\x09-\\x0D]+")).cast("long"))).first()[0] or 0
    if total > REFERENCE_WORDS:
        raise ValueError(f"the reference has {total} words; at most {REFERENCE_WORDS} are broadcast")
    shards: list[list[list[bytes]]] = [[]]
    room = shard_words
    for r in reference.where(F.col("text").isNotNull()).select("text").collect():
        words = r["text"].encode().split()
        if room < len(words) and shards[-1]:
            shards.append([])
            room = shard_words
        shards[-1].append(words)
        room -= len(words)
    sent = docs.sparkSession.sparkContext.broadcast(shards)
    base = docs.drop("kept_text", "removed_spans")
    names = [*base.columns, "kept_text", "removed_spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = []
        for texts in sent.value:
            a = Automaton()
            for w in texts:
                a.add(w, 0)
            a.close()
            automata.append(a)
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                words = (text or "").encode().split()
                ends = np.array(sorted({end for a in automata for end, _ in a.matches(words, window)}), np.int64)
                rows.append(_kept(text, merged(ends - window, ends)))
            kept, spans = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kept, pa.string()), pa.array(spans, pa.string())], names)

    return base.mapInArrow(run, wider(base, kept_text="string", removed_spans="string"))
