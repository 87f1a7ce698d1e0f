"""Near-dedup by the Jaccard similarity of five-word shingles, with SimHash fingerprints and pivot distance tables as the filter.

Two sets at least 0.8 alike share one of the LOW least hashes of their union with chance 1 - 0.2**LOW, and an element
among the least of the union is among the least of both. So documents meet in units by each of their LOW least hashes;
sets of up to 45 shingles can't miss each other, as more than a fifth of the set is told. Inside a unit, sizes and
fingerprints of 256 bits discard: at 0.8 some 40 bits differ, of unrelated texts 128, and BAND lies over five standard
deviations from both. A table holds each fingerprint's Hamming distances to reference fingerprints of its unit; by the
triangle inequality a pair whose distances to some reference differ by more than BAND can't link, and only the survivors'
true distance is worked out. What is left links to clusters, and only texts of clusters meet again, where the similarity
itself decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import cut, released, runs, text_or_empty, unused
from tablemill.llm.graph import components
from tablemill.llm.simhash import _LOWER, UNIT_ROWS

SHINGLE, LOW, BAND = 5, 10, 80
N_PIVOTS = 8
#: Least similarity, as a fraction.
OVER, UNDER = 4, 5
_SALTS = np.random.default_rng(5).integers(0, 2**64, 3, dtype=np.uint64)
_WIDE = ("w0", "w1", "w2", "w3")


def shingles(text: str | None) -> np.ndarray:
    """The sorted hashes of a text's different shingles; a shorter text is one shingle, one without words has none."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    last = end[min(SHINGLE, len(words)) - 1 :]
    h = np.fromiter((digest(joined[a:b], 42) for a, b in zip((end - size).tolist(), last.tolist(), strict=False)), np.uint64, len(last))
    return np.unique(h)


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """256 bits of a set of hashes, as four words."""
    out = np.zeros(4, np.uint64)
    for k in range(4):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), 65536):
            part = h[at : at + 65536]
            if k:
                part = (part ^ _SALTS[k - 1]) * np.uint64(0xBF58476D1CE4E5B9)
                part = (part ^ (part >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                part ^= part >> np.uint64(29)
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0]
    return out


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingles(t) for t in b.column("text").to_pylist()]
        node = pa.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], pa.uint64()).view(pa.int64())
        wide = np.array([wide_fingerprint(s) for s in sets], np.uint64).reshape(-1, 4).view(np.int64)
        low = pa.array([s[:LOW].view(np.int64) for s in sets], pa.list_(pa.int64()))
        size = pa.array([len(s) for s in sets], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), node, size, *(pa.array(np.ascontiguousarray(wide[:, k])) for k in range(4)), low], ["doc_id", "th", "node", "size", *_WIDE, "low"])


def distance_table(unit: np.ndarray, wide: np.ndarray) -> list[np.ndarray]:
    """Hamming distances of each row's fingerprint to N_PIVOTS references, an array a reference; rows are sorted by unit.

    A unit's references are its own: its first row, then each time the row farthest from those before. Fixed ones would
    never discard: a fingerprint lies 128 bits from them, give or take 8, so no two distances differ by more than BAND.
    """
    if not len(unit):
        return []
    start = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    number = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(unit)]))
    pivot, least, table = start, np.full(len(unit), 257, np.int16), []
    for _ in range(N_PIVOTS):
        table.append(np.bitwise_count(wide ^ wide[pivot][number]).sum(1, dtype=np.int16))
        least = np.minimum(least, table[-1])
        farthest = np.flatnonzero(least == np.maximum.reduceat(least, start)[number])
        pivot = farthest[np.unique(number[farthest], return_index=True)[1]]
    return table


def links_in_units(unit: np.ndarray, size: np.ndarray, wide: np.ndarray, part: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) whose links join every pair of one unit whose sizes and fingerprints allow the similarity."""
    order = np.lexsort((size, unit))
    unit, size, wide, part, whole = (x[order] for x in (unit, size, wide, part, whole))
    table = distance_table(unit, wide)
    label = np.arange(len(unit))
    out: list[tuple[np.ndarray, np.ndarray]] = []
    at, step = np.arange(len(unit)), 0
    while True:
        step += 1
        at = at[at + step < len(unit)]
        at = at[(unit[at + step] == unit[at]) & (OVER * size[at + step] <= UNDER * size[at])]  # sorted: a pair too unlike in size stays so
        if not len(at):
            break
        i = at[(whole[at] | (part[at + step] != part[at])) & (label[at] != label[at + step])]
        for column in table:
            if not len(i):
                break
            i = i[np.abs(column[i] - column[i + step]) <= BAND]
        i = i[np.bitwise_count(wide[i] ^ wide[i + step]).sum(1, dtype=np.int64) <= BAND]
        while len(i := i[label[i] != label[i + step]]):
            a, b = label[i], label[i + step]
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(label, high, low)
            won = label[high] == low
            once = np.unique(high[won], return_index=True)[1]
            out.append((order[i[won][once]], order[i[won][once] + step]))
            while not np.array_equal(label, again := label[label]):
                label = again
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows that come sorted by unit; the last unit waits for the next batch."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        unit = t["unit"].to_numpy()
        again = np.r_[False, unit[1:] == unit[:-1]]
        again[:-1] |= again[1:]
        node, size, part, whole = (t[c].to_numpy()[again] for c in ("node", "size", "part", "whole"))
        wide = np.stack([t[c].to_numpy()[again].view(np.uint64) for c in _WIDE], 1)
        i, j = links_in_units(unit[again], size, wide, part, whole)
        return pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], ["a", "b"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        unit = b.column("unit").to_numpy()
        start = int(np.argmax(unit == unit[-1]))
        if held and (start or held[-1].column("unit")[-1].as_py() != unit[0]):
            yield solve(pa.Table.from_batches([*held, b.slice(0, start)]))
            held = []
        elif start:
            yield solve(pa.Table.from_batches([b.slice(0, start)]))
        held.append(b.slice(start))
    if held:
        yield solve(pa.Table.from_batches(held))


def candidate_links(nodes: DataFrame) -> DataFrame:
    """(a, b): links that connect every two nodes that meet in a unit and pass its filters."""
    keyed = nodes.select("node", "size", *_WIDE, F.explode("low").alias("unit"))
    large = keyed.groupBy("unit").agg(F.count("*").alias("n")).where(F.col("n") > UNIT_ROWS).select("unit", F.ceil(F.col("n") / UNIT_ROWS).cast("int").alias("pieces"))
    joined = keyed.join(large, "unit", "left")
    part = F.when(F.col("pieces").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
    met = joined.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("pieces"), F.lit(1)) - 1)))
    unit = F.when(F.col("pieces").isNull(), F.col("unit")).otherwise(F.xxhash64("unit", F.least("part", "other"), F.greatest("part", "other")))
    units = met.select(unit.alias("unit"), "node", "size", *_WIDE, "part", (F.col("part") == F.col("other")).alias("whole"))
    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(released(_scan), "a long, b long")


def similar_parts(sets: list[np.ndarray]) -> np.ndarray:
    """For each set, the number of its part: sets joined by pairs whose similarity is at least OVER / UNDER."""
    size = np.array([len(s) for s in sets])
    ids = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(size)[:-1])
    mark = np.zeros(1 + max((int(x.max()) for x in ids if len(x)), default=0), bool)
    label = np.full(len(sets), -1)
    alive = np.argsort(size, kind="stable")  # sets in no part yet
    while len(alive):
        first, alive = alive[0], alive[1:]
        label[first] = first
        todo = [first]
        while todo and len(alive):
            one = todo.pop()
            a = np.searchsorted(size[alive], -(-OVER * size[one] // UNDER))
            b = np.searchsorted(size[alive], UNDER * size[one] // OVER, side="right")
            near, hit = alive[a:b], np.zeros(b - a, bool)
            mark[ids[one]] = True
            for at in range(0, len(near), 4096):
                some = near[at : at + 4096]
                n = size[some]
                shared = np.add.reduceat(mark[np.concatenate([ids[k] for k in some])], np.cumsum(n) - n, dtype=np.int64)
                hit[at : at + 4096] = UNDER * shared >= OVER * (size[one] + n - shared)
            mark[ids[one]] = False
            label[near[hit]] = first
            todo.extend(near[hit].tolist())
            alive = np.r_[alive[:a], near[~hit], alive[b:]]
    return label


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component_id) of each cluster's texts: the least doc_id of the node's part, null ones left out."""
    for t in runs(batches, ("cluster",)):
        node, first = np.unique(t["node"].to_numpy(), return_index=True)
        t = t.take(pa.array(first))
        part = similar_parts([shingles(x) for x in t["text"].to_pylist()])
        least: dict[int, object] = {}
        for p, d in zip(part.tolist(), t["least"].to_pylist(), strict=True):
            if d is not None:
                least[p] = min(d, least.get(p, d))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([least.get(p) for p in part.tolist()], t["least"].type)], ["node", "component_id"])


def _copies(docs: DataFrame) -> DataFrame:
    """(doc_id, th) of the rows that a near copy with a smaller doc_id replaces; th is the text's hash."""
    hashed = docs.select("doc_id", "text", F.xxhash64(text_or_empty()).alias("th"))
    fields = [f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", "th long", "node long", "size long", *(f"{w} long" for w in _WIDE), "low array<long>"]
    marks = cut(hashed.mapInArrow(released(_marks), ", ".join(fields)))
    rest = [F.first(c).alias(c) for c in ("size", *_WIDE, "low")]
    nodes = cut(marks.groupBy("node").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "th")).alias("of"), *rest))
    linked = components(candidate_links(nodes)).withColumnRenamed("component", "cluster")
    wanted = nodes.join(linked, "node").select("node", "cluster", "least", F.col("of.doc_id").alias("of_id"), F.col("of.th").alias("of_th"))
    texts = hashed.join(wanted, (F.col("th") == F.col("of_th")) & F.col("doc_id").eqNullSafe(F.col("of_id"))).select("cluster", "node", "least", "text")
    parts = texts.repartition("cluster").sortWithinPartitions("cluster").mapInArrow(released(_verified), f"node long, component_id {docs.schema['doc_id'].dataType.simpleString()}")
    placed = nodes.select("node", "least").join(parts.withColumn("met", F.lit(True)), "node", "left")
    kept = placed.select("node", F.when(F.col("met"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    found = marks.select("doc_id", "th", "node").join(kept, "node")
    return found.where(F.col("component_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th")).distinct()


def near_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the least of the documents that links of similar pairs reach.

    Rows that reach no document with a doc_id stay. Texts without words are alike, null ones included; repeated
    rows stay or go together. Extra columns come back as they were, whatever their names; an empty table gives an empty one.
    """
    gone_id, gone_th = unused("gone_id", docs.columns), unused("gone_th", docs.columns)
    gone = cut(_copies(docs)).toDF(gone_id, gone_th)
    return docs.join(gone, (F.xxhash64(text_or_empty()) == F.col(gone_th)) & F.col("doc_id").eqNullSafe(F.col(gone_id)), "left_anti")
