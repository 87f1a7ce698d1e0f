"""Best-fit packing by bin completion.

Which pieces share a sequence depends on their lengths only, and lengths are at most the capacity. So the driver plans
on a histogram of `capacity` counts, whatever the corpus's size: for the largest length that is left it enumerates the
undominated fillings of the rest of the sequence, applies one as often as the counts allow, and prunes by how much waste
a better plan than the incumbent may still have. The incumbent is best-fit decreasing, and completions replace it where
they are better. Pieces then find their place by their rank among pieces of their length, without meeting in one task:
ranks are offsets by partition plus positions within the partition.

The search has limits, which never cost a piece its place: LOOKED candidates for one largest piece, WIDTH branches, NODES
applied fillings in all. Where LOOKED ends the enumeration, a subset-sum table gives a filling of least waste.
"""

from __future__ import annotations

import bisect
import heapq
import random
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablemill.llm import word_tokens
from tablemill.llm.common import cut, released, text_or_empty, wider

CAPACITY = 2048
LOOKED, WIDTH, NODES = 200, 8, 4_000

Pattern = tuple[int, ...]


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on a histogram, piece by piece in effect: (lengths in a sequence, number of such sequences).

    The fullest sequence with room for a piece stays the fullest one with room for the next piece of that length, so
    it takes as many of them as fit before another does.
    """
    open_: dict[Pattern, int] = {}
    room: list[tuple[int, Pattern]] = []  # sorted by free space
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(room, (length, ()))
            free, pattern = room[at] if at < len(room) else (capacity, ())
            each = min(left, free // length)
            n = min(left // each, open_[pattern]) if pattern else left // each
            if pattern:
                open_[pattern] -= n
                if not open_[pattern]:
                    del open_[pattern], room[at]
            left -= n * each
            grown = (*pattern, *[length] * each)
            if grown not in open_:
                bisect.insort(room, (free - length * each, grown))
            open_[grown] = open_.get(grown, 0) + n
    return list(open_.items())


def fullest(lengths: list[int], counts: dict[int, int], space: int) -> Pattern:
    """A filling of `space` with the least waste there is, from lengths in the order of preference."""
    reach, before, goal = 1, [], 1 << space
    for length in lengths:
        before.append(reach)  # bit s: sum s can be made of the lengths before
        k, part = min(counts[length], space // length), 1
        while k:
            part = min(part, k)
            reach |= (reach << (length * part)) & (2 * goal - 1)
            k -= part
            part *= 2
        if reach & goal:
            break
    left, out = reach.bit_length() - 1, []
    for length, sums in zip(lengths[len(before) - 1 :: -1], reversed(before), strict=True):
        while not sums >> left & 1:
            out.append(length)
            left -= length
    return tuple(sorted(out, reverse=True))


def fillings(lengths: list[int], counts: dict[int, int], space: int, prefer: list[int] | None = None) -> list[Pattern]:
    """Undominated ways to fill `space`, least waste first; lengths come descending and fit.

    A filling is dominated if another holds the same or larger pieces in its place; one that leaves room for a piece
    that is left isn't put out. `prefer` orders the lengths for the filling that the subset-sum table adds.
    """
    if not lengths:
        return [()]
    found: dict[Pattern, int] = {}
    looked = 0
    stack: list[tuple[Pattern, int, int]] = [((), space, 0)]
    while stack and looked < LOOKED:
        taken, free, at = stack.pop()
        looked += 1
        while at < len(lengths) and (lengths[at] > free or counts[lengths[at]] <= taken.count(lengths[at])):
            at += 1
        if at == len(lengths):
            if not any(n <= free and counts[n] > taken.count(n) for n in reversed(lengths)):
                found[taken] = free
            continue
        stack += [(taken, free, at + 1), ((*taken, lengths[at]), free - lengths[at], at)]
    if stack or prefer:
        best = fullest(prefer or lengths, counts, space)
        found[best] = -1 if prefer else space - sum(best)
    return sorted(found, key=lambda f: (found[f], len(f), [-x for x in f]))[:WIDTH]


def bin_completion(counts: dict[int, int], capacity: int, nodes: int = NODES) -> list[tuple[Pattern, int]]:
    """A plan for the histogram with as few sequences as the search finds: (lengths, number of such sequences)."""
    total = sum(k * n for k, n in counts.items())
    bound = -(-total // capacity)
    best = best_fit(counts, capacity)
    most = sum(n for _, n in best)
    spent = dives = 0
    rng, number = random.Random(1), count()
    # Fewest departures from the first choice come first; then: number, counts left, plan so far (linked), sequences, waste.
    todo: list[tuple[int, int, dict[int, int], tuple | None, int, int]] = [(k, next(number), dict(counts), None, 0, 0) for k in range(4)]
    while todo and most > bound and spent < nodes:
        off, _, left, plan, used, waste = heapq.heappop(todo)
        dives += 1
        # The first dive takes large pieces before small ones; later ones shuffle that order a little.
        shift = {n: -n * rng.random() ** rng.choice((0.1, 0.3, 1.0)) for n in left} if dives > 1 else None
        order = sorted(left, reverse=True)
        while left:
            if waste > (most - 1) * capacity - total:  # no plan below this one beats the incumbent
                break
            spent += 1
            largest = order[0]
            left[largest] -= 1
            lengths = [n for n in order[bisect.bisect_left(order, largest - capacity, key=lambda n: -n) :] if left[n]]
            choices = fillings(lengths, left, capacity - largest, sorted(lengths, key=shift.get) if shift and lengths else None)
            left[largest] += 1
            for other in choices[:0:-1]:
                if len(todo) < 256:
                    heapq.heappush(todo, (off + 1, next(number), *_apply(left, plan, used, waste, (largest, *other), capacity)))
            left, plan, used, waste = _apply(left, plan, used, waste, (largest, *choices[0]), capacity)
            order = [n for n in order if n in left]
        if not left and used < most:
            most, best = used, []
            while plan:
                best.append(plan[0])
                plan = plan[1]
    return best


def _apply(left: dict[int, int], plan: tuple | None, used: int, waste: int, pattern: Pattern, capacity: int) -> tuple:
    each = Counter(pattern)
    times = min(left[k] // n for k, n in each.items())
    rest = left.copy()
    for k, n in each.items():
        rest[k] -= times * n
        if not rest[k]:
            del rest[k]
    return rest, ((pattern, times), plan), used + times, waste + times * (capacity - sum(pattern))


class Places:
    """Where the piece of a rank among those of its length goes: a table as long as the plan."""

    def __init__(self, plan: list[tuple[Pattern, int]]):
        rows: dict[int, list[tuple[int, int, int, list[int]]]] = {}
        ranks: dict[int, int] = {}
        first = 0
        for pattern, times in plan:
            at = 0
            offsets: dict[int, list[int]] = {}
            for length in pattern:
                offsets.setdefault(length, []).append(at)
                at += length
            for length, own in offsets.items():
                rank = ranks.get(length, 0)
                rows.setdefault(length, []).append((rank, first, len(own), own))
                ranks[length] = rank + times * len(own)
            first += times
        self.rows = rows
        self.starts = {k: [r[0] for r in v] for k, v in rows.items()}

    def find(self, length: int, rank: int) -> tuple[int, int]:
        """(sequence, offset)"""
        rank0, first, each, offsets = self.rows[length][bisect.bisect_right(self.starts[length], rank) - 1]
        return first + (rank - rank0) // each, offsets[(rank - rank0) % each]


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, cache_pieces: int = word_tokens.CACHE_PIECES) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth): whole texts' ids and end_id, cut at capacity.

    nth counts a partition's pieces of one length. A null text is empty: one piece that holds end_id alone.
    """
    end = int(end_id).to_bytes(4, "little")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        model = word_tokens.load(tokenizer, cache_pieces)
        seen: dict[int, int] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 1500):
                b = whole.slice(at, 1500)
                rows: list[tuple] = []
                for doc, ids in zip(b.column("doc_id").to_pylist(), model.batch(b.column("text").to_pylist()), strict=True):
                    ids += end
                    for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[start : start + 4 * capacity]
                        n = len(own) // 4
                        seen[n] = seen.get(n, -1) + 1
                        rows.append((doc, k, start // 4, n, zlib.crc32(own), part, seen[n]))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(released(run), schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces(length, part, nth, ...) with sequence_id and offset instead of part and nth.

    nth numbers the pieces of one length within a part from 0. Lengths must be from 1 to capacity. An empty table gives
    an empty one; equal lengths are told apart by (part, nth), so ties and repeated documents each get a place.
    """
    counted = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    # At most `capacity` rows reach the driver.
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places(bin_completion(counts, capacity))
    ranked = pieces.join(offsets, ["length", "part"]).withColumn("nth", F.col("nth") + F.col("before")).drop("before", "part")
    columns = [c for c in ranked.columns if c != "nth"]
    names = [*columns, "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [places.find(*x) for x in zip(b.column("length").to_pylist(), b.column("nth").to_pylist(), strict=True)]
            table = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(table[:, 0]), pa.array(table[:, 1])], names)

    return ranked.mapInArrow(released(run), wider(ranked.select(columns), sequence_id="long", offset="long"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, cache_pieces: int = word_tokens.CACHE_PIECES) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts are empty, null doc_ids and repeated rows are packed like others, extra columns of docs don't matter.
    """
    packed = pack(cut(cut_pieces(docs, tokenizer, capacity, end_id, cache_pieces)), capacity)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
