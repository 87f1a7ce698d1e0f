"""Byte-level BPE encoding and decoding by DuckDB's recursive queries, one connection a worker.

Texts are cut by the pattern that comes with the ranks; each distinct cut word of a batch is encoded once. In the
recursive query a row is a token at its position in a word; a step joins neighbours with the merge table, picks each
word's leftmost pair of minimum rank, contracts it, and goes on with the words that changed, until none does. Decoding
joins ids with their bytes and aggregates them in the order of positions.

A query keeps the rows of all its steps, some n * n / 2 for a word of n bytes. So words are cut where two bytes meet
that no token holds side by side, which no merge can cross, and a query gets as many of these pieces as make
QUERY_ROWS. Pieces over LONG_BYTES, runs without any such place, would be a step for each merge over all their rows:
a heap merges them, to the same result (README has the figures).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tablemill.llm.common import wider

LONG_BYTES = 2048
#: Rows of all steps of one recursive query.
QUERY_ROWS = 3_000_000
#: Distinct words that a worker keeps encoded.
CACHE_WORDS = 500_000

_ENCODE = """
WITH RECURSIVE state(step, word, pos, token) AS (
    SELECT 0, word, pos, token FROM start
    UNION ALL (
        WITH pairs AS (
            SELECT step, word, pos, token, lead(token) OVER w AS after, lead(pos) OVER w AS after_pos
            FROM state WINDOW w AS (PARTITION BY word ORDER BY pos)
        ), ranked AS (
            SELECT p.word, p.pos, p.after_pos, m.merged FROM pairs p JOIN merges m ON p.token = m.a AND p.after = m.b
        ), best AS (
            SELECT word, arg_min(pos, merged * 65536 + pos) AS pos, arg_min(after_pos, merged * 65536 + pos) AS after_pos, min(merged) AS merged
            FROM ranked GROUP BY word
        )
        SELECT p.step + 1, p.word, p.pos, CASE WHEN p.pos = b.pos THEN b.merged ELSE p.token END
        FROM pairs p JOIN best b ON p.word = b.word WHERE p.pos <> b.after_pos
    )
), last AS (SELECT word, max(step) AS step FROM state GROUP BY word)
SELECT s.word, s.token FROM state s JOIN last USING (word, step) ORDER BY s.word, s.pos
"""
_DECODE = "SELECT ids.word, string_agg(bytes.hex, '' ORDER BY ids.pos) AS hex FROM ids JOIN bytes ON ids.token = bytes.token GROUP BY ids.word ORDER BY ids.word"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ByteBPE:
    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.ranks = read_ranks(path)
        self.split = regex.compile(pattern).findall
        self.cache: dict[str, tuple[bytes, bytes]] = {}  # word -> ids, decoded bytes
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        merges = [(self.ranks[t[:k]], self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        a, b, c = (pa.array(x, pa.int32()) for x in zip(*merges, strict=True))
        self._table("merges", {"a": a, "b": b, "merged": pa.array(c, pa.int64())})
        self._table("bytes", {"token": pa.array(self.ranks.values(), pa.int64()), "hex": [t.hex() for t in self.ranks]})
        self.single = np.array([self.ranks[bytes([k])] for k in range(256)], np.int64)
        self.beside = np.zeros((256, 256), bool)  # bytes that some token holds side by side
        for t in self.ranks:
            for pair in zip(t, t[1:], strict=False):
                self.beside[pair] = True

    def _table(self, name: str, columns: dict) -> None:
        new = pa.table(columns)  # noqa: F841  DuckDB finds it by name
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM new")

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word; words are cut already."""
        size = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        if not len(raw):
            return [np.zeros(0, np.int64)] * len(words)
        word_start = np.cumsum(size) - size
        cut = np.r_[True, ~self.beside[raw[:-1], raw[1:]]]
        cut[word_start[size > 0]] = True
        start = np.flatnonzero(cut)
        length = np.diff(np.r_[start, len(raw)])
        rows = np.where(length > LONG_BYTES, 0, length * (length + 3) // 2)
        query = np.cumsum(rows) // QUERY_ROWS
        parts = []  # (piece of each id, id)
        for first, end in zip(np.flatnonzero(np.r_[True, query[1:] != query[:-1]]).tolist(), [*(np.flatnonzero(query[1:] != query[:-1]) + 1).tolist(), len(start)], strict=True):
            parts.append(self._query(raw, start, length, first, end))
        for k in np.flatnonzero(length > LONG_BYTES).tolist():
            ids = np.array(self._merge_long(raw[start[k] : start[k] + length[k]].tobytes()), np.int64)
            parts.append((np.full(len(ids), k), ids))
        piece, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(piece, kind="stable")
        ends = np.searchsorted(piece[order], np.searchsorted(start, np.r_[word_start, len(raw)]))
        ids = ids[order]
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def _query(self, raw: np.ndarray, start: np.ndarray, length: np.ndarray, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(piece, id) of pieces first to end, long ones left out, in order."""
        short = first + np.flatnonzero(length[first:end] <= LONG_BYTES)
        if not len(short):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = length[short]
        piece = np.repeat(short, size)
        pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        token = self.single[raw[start[piece] + pos]]
        many = np.repeat(size > 1, size)  # a byte alone is done
        if not many.any():
            return piece, token
        self._table("start", {"word": piece[many].astype(np.int32), "pos": pos[many].astype(np.int32), "token": token[many].astype(np.int32)})
        got = self.db.execute(_ENCODE).fetchnumpy()
        return np.r_[piece[~many], got["word"]], np.r_[token[~many], got["token"]]

    def decode_words(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each run of ids."""
        size = np.array([len(x) for x in ids], np.int64)
        if not size.sum():
            return [b""] * len(ids)
        word = np.repeat(np.arange(len(ids)), size)
        pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        self._table("ids", {"word": word, "pos": pos, "token": np.concatenate(ids)})
        found = dict(self.db.execute(_DECODE).fetchall())
        return [bytes.fromhex(found.get(k, "")) for k in range(len(ids))]

    def _merge_long(self, word: bytes) -> list[int]:
        """The same merges, leftmost of minimum rank first, over a linked list with a heap of candidate pairs."""
        parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[int, int, bytes]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (r := self.ranks.get(whole := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (r, i, whole))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, whole = heapq.heappop(heap)
            if parts[i] is None or (j := after[i]) >= len(parts) or parts[i] + parts[j] != whole:
                continue
            parts[i], parts[j], after[i] = whole, None, after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [self.ranks[p] for p in parts if p is not None]

    def batch(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """(ids as little-endian unsigned 32-bit integers, the bytes they decode to) of each text."""
        cut = [self.split(t) for t in texts]
        cache = self.cache
        need = {w for c in cut for w in c}
        if len(cache) + len(need) > CACHE_WORDS:
            kept = {w: cache[w] for w in need if w in cache}
            cache.clear()
            cache |= kept
        new = [w for w in need if w not in cache]
        ids = self.encode_words([w.encode() for w in new])
        cache |= zip(new, zip((x.astype("<u4").tobytes() for x in ids), self.decode_words(ids), strict=True), strict=True)
        for c in cut:
            both = [cache[w] for w in c]
            yield b"".join([x for x, _ in both]), b"".join([y for _, y in both])


_loaded: dict[tuple[str, str], ByteBPE] = {}


def load(path: str, pattern: str) -> ByteBPE:
    """One encoder a worker process."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBPE(path, pattern)
    return _loaded[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, digest: bool = False) -> DataFrame:
    """docs with n_tokens, and ids (array of int) and decoded (binary), or with digest their SHA-256 in lowercase hex.

    A null text is empty: no ids. Rows are encoded one by one; columns of docs with the new names are replaced.
    """
    made = ["n_tokens", *(("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded"))]
    base = docs.drop(*made)
    names = [*base.columns, *made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                n, ids, decoded = [], [], []
                for x, y in model.batch([t or "" for t in b.column("text").to_pylist()]):
                    n.append(len(x) // 4)
                    ids.append(hashlib.sha256(x).hexdigest() if digest else np.frombuffer(x, "<i4"))
                    decoded.append(hashlib.sha256(y).hexdigest() if digest else y)
                kinds = (pa.string(), pa.string()) if digest else (pa.list_(pa.int32()), pa.binary())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64()), pa.array(ids, kinds[0]), pa.array(decoded, kinds[1])], names)

    kinds = ("string", "string") if digest else ("array<int>", "binary")
    return base.mapInArrow(run, wider(base, **dict(zip(made, ("long", *kinds), strict=True))))


def decode(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """rows(ids array<int>, ...) with decoded (binary); null ids decode to no bytes. An id outside the ranks is an error."""
    base = rows.drop("decoded")
    names = [*base.columns, "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path, pattern)
        known = set(model.ranks.values())
        for b in batches:
            ids = [np.array(x or [], np.int64) for x in b.column("ids").to_pylist()]
            if bad := {int(t) for x in ids for t in x} - known:
                raise ValueError(f"no such token ids: {sorted(bad)[:5]}")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.decode_words(ids), pa.binary())], names)

    return base.mapInArrow(run, wider(base, decoded="binary"))


