"""Which windows of a document also start in a document with a smaller doc_id, over a whole corpus.

Every window holds one gram of least hash among its grams, its anchor, and equal windows have equal anchors; so only
about two grams in (window - gram) are told to others. Stages:

1. Anchors' hashes meet by hash, packed by bucket; those found in two documents or more go back to their documents.
   What documents of one batch share is told there, as a map-side combine, and meets others once a batch.
2. A document then tells, for each such anchor, a hash of its segment: all the symbols that windows around the anchor
   can cover. Equal segments of one anchor form a class. All but the class's least document lose the segment whole;
   those that have a smaller document in their batch do so at once.
3. Where an anchor has several classes, the segments of their least documents meet in a solver, one for each class and
   text however often the text has it, which finds what they share by the operator's own method. An anchor with very many classes would be one large group; its segments are
   taken apart into windows, whose 128-bit hashes spread over all partitions, and equal ones are a class again.
4. The spans join the documents.

A text is shuffled once; the stages reuse that exchange. What else is told travels as packed arrays. Codes of 40 bits
and a bucket only select candidates; a class is equal in the hash of its anchor and a 64-bit one of its segment. Solvers
compare symbols themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import CHUNK_BYTES, partitions, released, runs, text_or_empty, wider

#: Classes of one anchor beyond which its segments go on as single windows: what a worker's solver can hold at a time.
MANY_CLASSES = {"bytes": 16_384, "words": 2048}
#: Anchors that a worker packs at a time, and symbols that a solver gets at a time.
FLUSH, SOLVE = 1_000_000, 1_200_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: segments, their owners -> (segment, start, end) of what a smaller owner also has, in symbols
Solver = Callable[[list[bytes], np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Kind:
    """words: symbols are words, which one space joins; else bytes."""

    words: bool
    window: int
    gram: int

    @property
    def side(self) -> int:
        return self.window - self.gram

    def raw(self, text: str | None) -> bytes:
        """The text as its symbols' bytes."""
        raw = (text or "").encode()
        return b" ".join(raw.split()) if self.words else raw


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


_powers: list[np.ndarray] = []


def _word_hashes(big: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash of each slice of bytes, from prefix sums and the inverse of the base's powers."""
    if not _powers or len(_powers[0]) <= len(big):
        n = max(len(big) + 1, CHUNK_BYTES + CHUNK_BYTES // 4)
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(n, b, np.uint64)]) for b in (_BASE, inverse)]
    sums = np.r_[np.uint64(0), np.cumsum(_TABLE[big] * _powers[0][: len(big)])]
    return _mix((sums[ends] - sums[starts]) * _powers[1][starts])


def _rolling(x: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n symbols, by doubling."""
    one, width, power = x, 1, int(_BASE)
    out, have = None, 0
    while True:
        if n & 1:
            if out is None:
                out, have = one, width
            else:
                m = len(x) - have - width + 1
                out, have = out[:m] * np.uint64(power) + one[have : have + m], have + width
        n >>= 1
        if not n:
            return _mix(out)
        m = len(x) - 2 * width + 1
        one, width, power = one[:m] * np.uint64(power) + one[width : width + m], 2 * width, power * power % 2**64


def _extreme(x: np.ndarray, n: int, pick: Callable) -> np.ndarray:
    """The least or greatest of each n neighbours."""
    width, now = 1, x
    while 2 * width <= n:
        now = pick(now[:-width], now[width:])
        width *= 2
    m = len(x) - n + 1
    return pick(now[:m], now[n - width : n - width + m])


def _pieces(raw: bytes, kind: Kind) -> Iterator[tuple[int, bytes]]:
    """(offset in symbols, bytes) of pieces that together hold every window of the text."""
    if len(raw) <= CHUNK_BYTES:
        yield 0, raw
    elif kind.words:
        words, step = raw.split(b" "), CHUNK_BYTES // 8
        for at in range(0, max(1, len(words) - kind.window + 1), step):
            yield at, b" ".join(words[at : at + step + kind.window - 1])
    else:
        for at in range(0, max(1, len(raw) - kind.window + 1), CHUNK_BYTES):
            yield at, raw[at : at + CHUNK_BYTES + kind.window - 1]


class _Found:
    """Anchors of many texts: text (its number), pos, h, and with segments also left, right and seg."""

    def __init__(self, raws: list[bytes], kind: Kind, segments: bool):
        self.columns: list[list[np.ndarray]] = [[] for _ in range(6)]
        part, size = [], 0
        for k, raw in enumerate(raws):
            if len(raw) < kind.window:
                continue
            for at, piece in _pieces(raw, kind):
                part.append((k, at, piece))
                size += len(piece)
                if size > CHUNK_BYTES:
                    self._add(part, kind, segments)
                    part, size = [], 0
        if part:
            self._add(part, kind, segments)
        self.text, self.pos, self.h, self.left, self.right, self.seg = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in self.columns)

    def _add(self, part: list[tuple[int, int, bytes]], kind: Kind, segments: bool) -> None:
        big = np.frombuffer(b" ".join(p for _, _, p in part), np.uint8)
        if kind.words:
            gap = np.flatnonzero(big == 32)
            symbol = _word_hashes(big, np.r_[0, gap + 1], np.r_[gap, len(big)])
            size = np.array([p.count(b" ") + 1 for _, _, p in part])
            start = np.cumsum(size) - size
        else:
            symbol = _TABLE[big]
            size = np.array([len(p) for _, _, p in part])
            start = np.cumsum(size + 1) - size - 1
        if len(symbol) < kind.window:
            return
        n = kind.side + 1
        h = _rolling(symbol, kind.gram)
        low = _extreme(h, n, np.minimum)
        edge = np.zeros(n - 1, np.uint64)
        pos = np.flatnonzero(_extreme(np.r_[edge, low, edge], n, np.maximum) == h)
        own = np.searchsorted(start, pos, side="right") - 1
        inside = (pos + kind.gram <= start[own] + size[own]) & (size[own] >= kind.window)
        pos, own = pos[inside], own[inside]
        left = np.minimum(pos - start[own], kind.side)
        right = np.minimum(start[own] + size[own] - pos - kind.gram, kind.side)
        seg = np.zeros(0, np.uint64)
        if segments:
            sums = np.r_[np.uint64(0), np.cumsum(_mix(symbol ^ _BASE) * _weights(len(symbol)))]
            a, b = pos - left, pos + kind.gram + right
            seg = _mix((sums[b] - sums[a]) * _inverses(len(symbol))[a]) ^ _mix((left * 4096 + right).astype(np.uint64))
        text, at = np.array([t for t, _, _ in part]), np.array([a for _, a, _ in part])
        for c, x in zip(self.columns, (text[own], at[own] + pos - start[own], h[pos], left, right, seg), strict=True):
            c.append(x)


def _weights(n: int) -> np.ndarray:
    _word_hashes(np.zeros(n, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return _powers[0][:n]


def _inverses(n: int) -> np.ndarray:
    return _powers[1][: n + 1]


def _code(h: np.ndarray, buckets: int) -> np.ndarray:
    """40 bits of a hash and its bucket, as one number whose remainder is the bucket."""
    n = np.uint64(buckets)
    return ((h // n) & np.uint64(2**40 - 1)) * n + h % n


def _low(code: np.ndarray, buckets: int) -> np.ndarray:
    """32 bits of a code, enough to tell a document's own anchors apart; one taken by mistake is only told for nothing."""
    return (code // np.uint64(buckets)) & np.uint64(2**32 - 1)


#: Arrays that travel packed; codes go as 32 and 8 bits beside their bucket.
ANCHOR = {"low": np.uint32, "high": np.uint8, "k": np.int64}
SEGMENT = {"low": np.uint32, "high": np.uint8, "seg": np.uint64, "k": np.int64, "th": np.int64, "start": np.int32, "size": np.uint16}
SHARED = {"k": np.int64, "low": np.uint32}
SPAN = {"k": np.int64, "th": np.int64, "start": np.int32, "size": np.uint16}
ASKED = SPAN | {"code": np.int64, "split": np.uint8}


def _schema(kinds: dict[str, type], key: str = "bucket int") -> str:
    return key + "".join(f", {c} binary" for c in kinds)


def _packed(bucket: np.ndarray, columns: list[np.ndarray], kinds: dict[str, type]) -> pa.RecordBatch:
    """One row for each bucket: its rows of each column as bytes."""
    order = np.argsort(bucket, kind="stable")
    names, first = np.unique(bucket[order], return_index=True)
    ends = np.r_[first[1:], len(order)][: len(first)]  # none where there are no rows
    cols = [pa.array([x[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary()) for x in (c.astype(t)[order] for c, t in zip(columns, kinds.values(), strict=True))]
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), *cols], ["bucket", *kinds])


def _by_code(code: np.ndarray, buckets: int, columns: dict[str, np.ndarray], kinds: dict[str, type], meet: np.ndarray, done: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows that meet those of their code elsewhere, and rows that the batch itself has settled, which go anywhere."""
    n = np.uint64(buckets)
    values = [(code // n) & np.uint64(2**32 - 1), code // n >> np.uint64(32), *columns.values()]
    for take, settled in ((meet, False), (done, True)):
        if len(take):
            bucket = _mix(columns["k"][take].astype(np.int64).view(np.uint64)) if settled else code[take]
            b = _packed(bucket % n, [x[take] for x in values], kinds)
            yield b.append_column("done", pa.array([settled] * b.num_rows, pa.bool_()))


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where sorted columns begin a new value."""
    return np.flatnonzero(np.any([np.r_[True, x[1:] != x[:-1]] for x in columns], axis=0)) if len(columns[0]) else np.zeros(0, np.int64)


def _by_k(columns: list[np.ndarray], kinds: dict[str, type], buckets: int) -> pa.RecordBatch:
    return _packed(_mix(columns[0].astype(np.int64).view(np.uint64)) % np.uint64(buckets), columns, kinds)


def _unpacked(t: pa.Table, kinds: dict[str, type]) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(t[c].to_pylist()), kind) for c, kind in kinds.items()]


def _whole_code(t: pa.Table, low: np.ndarray, high: np.ndarray, buckets: int) -> np.ndarray:
    return ((high.astype(np.uint64) << np.uint64(32)) | low) * np.uint64(buckets) + np.uint64(t["bucket"][0].as_py())


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _anchor_rows(kind: Kind, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            code, doc = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((doc, code))
            once = order[_starts(code[order], doc[order])]
            code, doc = code[once], doc[once]
            first = _starts(code)
            # What two documents of the batch have is shared; only the first still meets others.
            several = np.repeat(np.diff(np.r_[first, len(code)]) > 1, np.diff(np.r_[first, len(code)]))
            yield from _by_code(code, buckets, {"k": doc}, ANCHOR, first, np.flatnonzero(several))

        for b in _slices(batches):
            found = _Found([kind.raw(t) for t in b.column("text").to_pylist()], kind, False)
            held.append((_code(found.h.astype(np.uint64), buckets), b.column("doc_id").to_numpy()[found.text.astype(np.int64)]))
            if sum(len(h) for h, _ in held) > FLUSH:
                yield from flush()
        if held:
            yield from flush()

    return run


def _shared_anchors(buckets: int):
    """Anchors that two documents or more have, told to each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ("bucket", "done")):
            low, high, doc = _unpacked(t, ANCHOR)
            if t["done"][0].as_py():
                yield _by_k([doc, low], SHARED, buckets)
                continue
            code = _whole_code(t, low, high, buckets)
            order = np.argsort(code)
            code, doc = code[order], doc[order]
            first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            many = np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)
            take = np.repeat(many, np.diff(np.r_[first, len(code)]))
            if take.any():
                yield _by_k([doc[take], _low(code[take], buckets)], SHARED, buckets)

    return run


def _for_documents(rows: DataFrame, kinds: dict[str, type], names: dict[str, str]) -> DataFrame:
    """One row for each k: its rows of each column as bytes, under new names."""
    wanted = [c for c in kinds if c != "k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ("bucket",)):
            columns = dict(zip(kinds, _unpacked(t, kinds), strict=True))
            order = np.argsort(columns["k"], kind="stable")
            k = columns["k"][order]
            first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            ends = np.r_[first[1:], len(k)]
            made = [pa.array([x[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary()) for x in (columns[c][order] for c in wanted)]
            yield pa.RecordBatch.from_arrays([pa.array(k[first]), *made], ["__sw_rk", *(names[c] for c in wanted)])

    schema = _schema({names[c]: None for c in wanted}, "__sw_rk long")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(released(run), schema).hint("shuffle_hash")


def _segment_rows(kind: Kind, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            code, *columns = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            seg, doc = columns[:2]
            order = np.lexsort((doc, seg, code))
            first = _starts(code[order], seg[order])
            least = np.empty_like(doc)
            least[order] = np.repeat(doc[order][first], np.diff(np.r_[first, len(code)]))
            # A segment that a smaller document of the batch has goes whole, and says nothing to others.
            settled = doc > least
            columns = dict(zip(("seg", "k", "th", "start", "size"), columns, strict=True))
            yield from _by_code(code, buckets, columns, SEGMENT, np.flatnonzero(~settled), np.flatnonzero(settled))

        for b in _slices(batches):
            found = _Found([kind.raw(t) for t in b.column("text").to_pylist()], kind, True)
            text = found.text.astype(np.int64)
            if not len(text):
                continue
            wanted = [np.frombuffer(x or b"", np.uint32) for x in b.column("__sw_low").to_pylist()]
            code = _code(found.h, buckets)
            low = _low(code, buckets).astype(np.uint32)
            ends = np.searchsorted(text, np.arange(b.num_rows + 1))
            take = np.concatenate([np.isin(low[ends[i] : ends[i + 1]], w) for i, w in enumerate(wanted)])
            text = text[take]
            left = found.left[take]
            held.append((code[take], found.seg[take], b.column("doc_id").to_numpy(zero_copy_only=False)[text], b.column("__sw_th").to_numpy()[text], found.pos[take] - left, left + kind.gram + found.right[take]))
            if sum(len(x[0]) for x in held) > FLUSH:
                yield from flush()
        if held:
            yield from flush()

    return run


def _classes(window: int, ask: bool, buckets: int, many: int):
    """Of each anchor's classes: spans of all but the least document, or the least documents' segments to be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ("bucket", "done")):
            if t["done"][0].as_py() and ask:
                continue
            low, high, seg, doc, th, start, size = _unpacked(t, SEGMENT)
            if t["done"][0].as_py():
                yield _by_k([x[size >= window] for x in (doc, th, start, size)], SPAN, buckets)
                continue
            code = _whole_code(t, low, high, buckets)
            order = np.lexsort((doc, seg, code))
            code, seg, doc, th, start, size = (x[order] for x in (code, seg, doc, th, start, size))
            new_code = np.r_[True, code[1:] != code[:-1]]
            first = np.flatnonzero(new_code | np.r_[True, seg[1:] != seg[:-1]])
            least = np.repeat(doc[first], np.diff(np.r_[first, len(code)]))
            if ask:
                anchor = np.cumsum(new_code) - 1
                n = np.bincount(anchor[first])[anchor]
                take = (doc == least) & (n > 1) & (size >= window)
                # What a solver gets: one segment of each class and text, however often the text has it.
                own = np.flatnonzero(take)
                own = own[np.lexsort((th[own], seg[own], code[own]))]
                once = own[np.r_[True, np.any([x[own[1:]] != x[own[:-1]] for x in (code, seg, th, doc)], axis=0)]] if len(own) else own
                held = np.bincount(anchor[once], minlength=anchor[-1] + 1)[anchor]
                yield _by_k([x[take] for x in (doc, th, start, size, code, np.maximum(n, held) > many)], ASKED, buckets)
            else:
                take = (doc > least) & (size >= window)
                yield _by_k([x[take] for x in (doc, th, start, size)], SPAN, buckets)

    return run


def _cut_segments(kind: Kind):
    """(g, g2, seg, k, th, start, starts, done): segments by their anchor, and windows of segments taken apart, without seg, by hash.

    A segment or window that a text has several times goes once; starts, else null, packs all its places.
    Of equal windows in a batch only the least document's still has to be compared, as a map-side combine: so a window
    that very many documents have doesn't send a row for each of them to one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        sep = b" " if kind.words else b""
        names = ["g", "g2", "seg", "k", "th", "start", "starts", "done"]
        types = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
        for b in _slices(batches):
            rows: list[tuple] = []
            windows: list[tuple] = []
            columns = [b.column(c).to_pylist() for c in ("text", "doc_id", "__sw_th", *(f"__sw_{c}s" for c in ASKED if c != "k"))]
            for text, doc, own, *asked in zip(*columns, strict=True):
                if text is None:
                    continue
                raw = kind.raw(text)
                symbols = raw.split(b" ") if kind.words else raw
                places: dict[tuple[int, bytes], list[int]] = {}
                for th, start, size, code, split in zip(*(np.frombuffer(x, ASKED[c]).tolist() for c, x in zip((c for c in ASKED if c != "k"), asked, strict=True)), strict=True):
                    if th != own:
                        continue
                    if split:
                        for s in range(start, start + size - kind.window + 1):
                            part = symbols[s : s + kind.window]
                            windows.append((xxhash.xxh3_128_digest(sep.join(part) if kind.words else part), doc, own, s))
                    else:
                        part = symbols[start : start + size]
                        places.setdefault((code, sep.join(part) if kind.words else part), []).append(start)
                rows += [(code, 0, seg, doc, own, at[0], np.array(at, np.int64).tobytes() if len(at) > 1 else None, False) for (code, seg), at in places.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
            if windows:
                digest, *others = zip(*windows, strict=True)
                g, g2 = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2).T
                k, th, start = (np.array(x, np.int64) for x in others)
                order = np.lexsort((start, th, k, g2, g))
                g, g2, k, th, start = (x[order] for x in (g, g2, k, th, start))
                own = _starts(g, g2, k, th)
                ends = np.r_[own[1:], len(g)]
                starts = pa.array([start[a:b].tobytes() if b - a > 1 else None for a, b in zip(own.tolist(), ends.tolist(), strict=True)], pa.binary())
                g, g2, k, th, start = (x[own] for x in (g, g2, k, th, start))
                first = _starts(g, g2)
                # A window that a smaller document of this batch has is settled, and goes anywhere.
                done = k > np.repeat(k[first], np.diff(np.r_[first, len(k)]))
                g = np.where(done, _mix((k * 65537 + start).view(np.uint64)).view(np.int64), g)
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(g2), pa.nulls(len(g), pa.binary()), pa.array(k), pa.array(th), pa.array(start), starts, pa.array(done)], names)

    return run


def _solved(kind: Kind, solver: Solver, buckets: int):
    """Spans of what the solver finds in the segments, and of windows that a smaller document has. Rows come by g, g2, k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[pa.RecordBatch] = []
        last = (0, 0, 0)

        def settle(b: pa.RecordBatch) -> None:
            k, th, start = (b.column(c).to_numpy() for c in ("k", "th", "start"))
            places = [np.frombuffer(x, np.int64) if x else start[i : i + 1] for i, x in enumerate(b.column("starts").to_pylist())]
            n = [len(x) for x in places]
            at = np.concatenate(places)
            ready.append(_by_k([np.repeat(k, n), np.repeat(th, n), at, np.full(len(at), kind.window)], SPAN, buckets))

        def windows(b: pa.RecordBatch) -> None:
            nonlocal last
            g, g2, k = (b.column(c).to_numpy() for c in ("g", "g2", "k"))
            new = np.r_[(int(g[0]), int(g2[0])) != last[:2], (g[1:] != g[:-1]) | (g2[1:] != g2[:-1])]
            first = np.flatnonzero(new)
            least = np.r_[last[2], k[first]][np.cumsum(new)]
            last = (int(g[-1]), int(g2[-1]), int(least[-1]))
            take = k > least
            if take.any():
                settle(b.filter(pa.array(take)))

        def segments() -> Iterator[pa.RecordBatch]:
            for b in batches:
                apart, done = np.array(b.column("seg").is_null()), b.column("done").to_numpy(zero_copy_only=False)
                if done.any():
                    settle(b.filter(b.column("done")))
                if (apart & ~done).any():
                    windows(b.filter(pa.array(apart & ~done)))
                if not apart.all():
                    yield b.filter(pa.array(~apart))

        def solve(t: pa.Table) -> pa.RecordBatch:
            owner, start = t["k"].to_numpy(), t["start"].to_numpy()
            seg, a, b = solver(t["seg"].to_pylist(), owner)
            own, th = owner[seg], t["th"].to_numpy()[seg]
            columns = [own, th, start[seg] + a, b - a]
            several = np.array(t["starts"].is_valid())[seg]
            if several.any():
                parts = [[x[~several] for x in columns]]
                found = np.flatnonzero(several)[np.argsort(seg[several], kind="stable")]
                for of in np.split(found, np.flatnonzero(np.diff(seg[found])) + 1):
                    s = int(seg[of[0]])
                    at = np.frombuffer(t["starts"][s].as_py(), np.int64)
                    for first, end in merged(a[of], b[of]):
                        parts.append([np.full(len(at), owner[s]), np.full(len(at), t["th"][s].as_py()), at + first, np.full(len(at), end - first)])
                columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
            return _by_k(columns, SPAN, buckets)

        held, size = [], 0
        for t in runs(segments(), ("g",)):  # an anchor's segments stay together
            if t.num_rows < 2:
                continue
            if held and size + t["seg"].nbytes > SOLVE:
                yield solve(pa.concat_tables(held))
                held, size = [], 0
            held.append(t)
            size += t["seg"].nbytes
            while ready:
                yield ready.pop()
        if held:
            yield solve(pa.concat_tables(held))
        yield from ready

    return run


def merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """The union of spans, as disjoint spans that don't touch, in order."""
    if not len(start):
        return []
    order = np.argsort(start, kind="stable")
    start, top = start[order], np.maximum.accumulate(end[order])
    new = np.r_[True, start[1:] > top[:-1]]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(start) - 1]
    return list(zip(start[new].tolist(), top[last].tolist(), strict=True))


def remove_shared(docs: DataFrame, kind: Kind, solver: Solver, made: dict[str, str], finish: Callable[[str | None, list[tuple[int, int]]], tuple], many: int) -> DataFrame:
    """docs with the columns `made`, which finish(text, spans) gives for each row; spans are in symbols.

    Columns of docs come back as they were, whatever their names, but for those that `made` replaces; an empty table gives
    an empty one. Rows of one doc_id are one document as far as "smaller" goes. A row with a null doc_id loses nothing and takes
    nothing from others; null texts have no symbols.
    """
    base = docs.drop(*made)
    own, base = base.columns, base.toDF(*(c if c in ("doc_id", "text") else f"c{k}" for k, c in enumerate(base.columns)))
    buckets = partitions(docs.sparkSession)
    least = 2 * kind.window - 1 if kind.words else kind.window // 4
    usable = base.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & (F.length("text") >= least))
    anchors = usable.mapInArrow(released(_anchor_rows(kind, buckets)), _schema(ANCHOR) + ", done boolean").repartition("bucket").sortWithinPartitions("bucket", "done")
    shared = anchors.mapInArrow(released(_shared_anchors(buckets)), _schema(SHARED))

    th = F.xxhash64(text_or_empty())
    key = F.coalesce(F.col("doc_id").cast("long"), F.col("__sw_th"))
    dealt = base.withColumn("__sw_th", th).withColumn("__sw_k", key).repartition("__sw_k")
    on = F.col("__sw_k") == F.col("__sw_rk")
    # Spans name their text by its hash only where a doc_id has several texts; elsewhere the zeros pack to nothing.
    several = base.select("doc_id", th.alias("__sw_th")).select(key.alias("__sw_dk"), "__sw_th")
    several = several.groupBy("__sw_dk").agg(F.min("__sw_th").alias("a"), F.max("__sw_th").alias("b")).where("a <> b").select("__sw_dk").hint("shuffle_hash")
    dealt = dealt.join(several, F.col("__sw_k") == F.col("__sw_dk"), "left")
    dealt = dealt.withColumn("__sw_th", F.when(F.col("__sw_dk").isNull(), F.lit(0)).otherwise(F.col("__sw_th")).cast("long")).drop("__sw_dk")

    def joined(lists: DataFrame, column: str) -> DataFrame:
        # A left join that keeps all of dealt's columns, so that no filter or pruning makes its exchange another one.
        listed = F.col(column).isNotNull() & F.col("doc_id").isNotNull()
        return dealt.join(lists, on, "left").withColumn("text", F.when(listed, F.col("text")))

    told = joined(_for_documents(shared, SHARED, {"low": "__sw_low"}), "__sw_low").mapInArrow(released(_segment_rows(kind, buckets)), _schema(SEGMENT) + ", done boolean")
    told = told.repartition("bucket").sortWithinPartitions("bucket", "done")
    copies = told.mapInArrow(released(_classes(kind.window, False, buckets, many)), _schema(SPAN))
    asked = told.mapInArrow(released(_classes(kind.window, True, buckets, many)), _schema(ASKED))
    lists = _for_documents(asked, ASKED, {c: f"__sw_{c}s" for c in ASKED})
    segments = joined(lists, "__sw_ths").mapInArrow(released(_cut_segments(kind)), "g long, g2 long, seg binary, k long, th long, start long, starts binary, done boolean")
    rest = segments.repartition("g").sortWithinPartitions("g", "g2", "k").mapInArrow(released(_solved(kind, solver, buckets)), _schema(SPAN))
    spans = _for_documents(copies.unionByName(rest), SPAN, {c: f"__sw_{c}s" for c in SPAN})
    out = dealt.join(spans, on, "left")
    keep = base.columns
    types = [{"long": pa.int64(), "string": pa.string()}[t] for t in made.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            rows = []
            columns = [b.column(c).to_pylist() for c in ("text", "__sw_th", "doc_id", "__sw_ths", "__sw_starts", "__sw_sizes")]
            for text, own, doc, ths, start, size in zip(*columns, strict=True):
                cut: list[tuple[int, int]] = []
                if ths is not None and doc is not None:
                    take = np.frombuffer(ths, np.int64) == own
                    a = np.frombuffer(start, np.int32)[take].astype(np.int64)
                    cut = merged(a, a + np.frombuffer(size, np.uint16)[take])
                rows.append(finish(text, cut))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], [*keep, *made])

    return out.mapInArrow(released(run), wider(base, **made)).toDF(*own, *made)
