"""Suffix-array dedup of bytes, by the interval tree of common prefixes.

The enhanced suffix array of a shard of segments holds suffixes in order with the lengths of neighbours' common
prefixes. A scan with a stack finds the tree's intervals; one whose suffixes have different symbols on their left is a
maximal repeat, and is put out as a group with all its occurrences. A document loses each occurrence of a repeat of at
least `window` bytes that a document with a smaller id also has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from tablemill.llm.shared_windows import MANY_CLASSES, Kind, remove_shared

KIND = Kind(words=False, window=50, gram=20)


def enhanced(symbols: np.ndarray, depth: int, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, common prefix of each suffix with the one before), for suffixes told apart within depth symbols.

    Ranks by prefix multiplication: of four symbols, then of three (in large arrays two) ranks side by side, kept at
    each width to read common prefixes from. Prefixes shorter than `least` may read as shorter still. Symbols are below
    2**16 - 1 and end with one that occurs once.
    """
    n = len(symbols)
    if n and symbols.max() >= 2**16 - 1:
        raise ValueError("a symbol passes 16 bits: too many segments in one array")
    fold, bits = (3, 21) if n < 2**21 - 1 else (2, 31)
    pad = np.r_[symbols.astype(np.int64) + 1, np.zeros(4, np.int64)].view(np.uint64)
    key = pad[:n]
    for k in range(1, 4):
        key = (key << np.uint64(16)) | pad[k : n + k]
    width, ranks = 4, []
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]])
        ranks.append((width, rank))
        if width >= depth or rank[order[-1]] == n - 1:
            break
        key = rank
        for k in range(1, fold):
            ahead = np.zeros(n, np.int64)
            ahead[: max(0, n - k * width)] = rank[k * width :] + 1
            key = (key << bits) | ahead
        width *= fold
    common = np.zeros(n, np.int64)
    alive = np.arange(1, n)
    if sure := [r for w, r in ranks if w <= least]:
        alive = alive[sure[-1][order[1:]] == sure[-1][order[:-1]]]
    a, b, found = order[alive], order[alive - 1], np.zeros(len(alive), np.int64)
    for width, rank in [*reversed(ranks), (1, symbols)]:
        for _ in range(3 if width == 1 else fold - 1):
            ok = np.maximum(a, b) < n
            ok[ok] = rank[a[ok]] == rank[b[ok]]
            step = width * ok
            a, b, found = a + step, b + step, found + step
    common[alive] = found
    return order, common


def maximal_repeats(symbols: np.ndarray, order: np.ndarray, common: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, end): the suffixes order[first:end] share `length` symbols, more on neither side; length >= least."""
    left = np.r_[-1, symbols][order]  # the symbol before each suffix
    differs = np.cumsum(np.r_[0, left[1:] != left[:-1]])
    deep = np.flatnonzero(common >= least)
    if not len(deep):
        return
    breaks = np.flatnonzero(np.diff(deep) > 1) + 1
    for run in np.split(deep, breaks):
        begin, values = int(run[0]), common[run].tolist()
        stack: list[tuple[int, int]] = []  # (length, first)
        for at, length in enumerate([*values, -1], begin):
            first = at - 1
            while stack and stack[-1][0] > length:
                depth, first = stack.pop()
                if differs[at - 1] > differs[first]:
                    yield depth, first, at
            if length >= least and (not stack or stack[-1][0] < length):
                stack.append((length, first))


def shard(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, segment of each, position of each): a symbol of its own ends each segment, so no repeat crosses one."""
    size = np.array([len(s) for s in segments]) + 1
    ends = np.cumsum(size)
    symbols = np.zeros(ends[-1], np.int64)
    body = np.ones(ends[-1], bool)
    body[ends - 1] = False
    symbols[body] = np.frombuffer(b"".join(segments), np.uint8)
    symbols[ends - 1] = 256 + np.arange(len(segments))
    segment = np.repeat(np.arange(len(segments)), size)
    return symbols, segment, np.arange(ends[-1]) - np.repeat(ends - size, size)


def repeat_groups(segments: list[bytes], least: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(length, [(segment, start)]) of every maximal repeat, with all its occurrences."""
    if not segments:
        return
    symbols, segment, pos = shard(segments)
    order, common = enhanced(symbols, max(map(len, segments)), least)
    for length, first, end in maximal_repeats(symbols, order, common, least):
        at = order[first:end]
        yield length, list(zip(segment[at].tolist(), pos[at].tolist(), strict=True))


def solve(segments: list[bytes], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, start, end) of occurrences that a smaller owner's segment repeats."""
    symbols, segment, pos = shard(segments)
    order, common = enhanced(symbols, max(map(len, segments)), KIND.window)
    own = owner[segment[order]]
    out: list[tuple[np.ndarray, int]] = []
    for length, first, end in maximal_repeats(symbols, order, common, KIND.window):
        who = own[first:end]
        if len(hit := np.flatnonzero(who > who.min())):
            out.append((order[first + hit], length))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    at = np.concatenate([x for x, _ in out])
    length = np.repeat([n for _, n in out], [len(x) for x, _ in out])
    return segment[at], pos[at], pos[at] + length


def _digest(text: str | None, spans: list[tuple[int, int]]) -> tuple:
    raw = (text or "").encode()
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    return len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(b"".join(kept)).hexdigest()


def _kept(text: str | None, spans: list[tuple[int, int]]) -> tuple:
    raw = (text or "").encode()
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at:a])
        at = b
    return (b"".join([*kept, raw[at:]]).decode(errors="replace"), str(spans))


def remove_repeats(docs: DataFrame, digest: bool = False, many: int = MANY_CLASSES["bytes"]) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept_sha256, or without digest with kept_text and removed_spans.

    A null text has no bytes. Bytes cut out of a character leave a replacement character in kept_text, not in the
    digest. Equal doc_ids never take from each other; columns of docs with the new names are replaced.
    """
    made = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"} if digest else {"kept_text": "string", "removed_spans": "string"}
    return remove_shared(docs, KIND, solve, made, _digest if digest else _kept, many)
