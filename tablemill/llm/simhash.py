"""SimHash near-dedup with pivot distance tables.

Two fingerprints that differ in at most 4 of 64 bits agree on all but four of any blocks of bits, so fingerprints meet in
units that share those (of six blocks two: 15 keys each). There are as many blocks as keep units small at the number of
fingerprints: units of six blocks share 20 bits, of eight 32. Inside a unit, a table holds each fingerprint's Hamming distances to many
fixed reference fingerprints. By the triangle inequality a pair whose distances to some reference differ by more than 4
can't link: rows are sorted by the first coordinate, so that pairs outside its band aren't looked at; the other
coordinates discard most of the rest, and the survivors' true distance is verified. Only links that join two parts of
a unit leave it, never all pairs. Equal fingerprints are one node from the start. A unit of more than UNIT_ROWS rows is
cut into pieces that meet pairwise in units of their own, which keeps every link and bounds each unit. Links name
fingerprints by their least document, so that a component's least node is its answer and its rows need not meet again.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import cut, partitions, released, unused, wider
from tablemill.llm.graph import components

BITS = 4
#: Fingerprints that chance puts into one unit, as a power of two, beyond which there are more blocks.
CROWD = 4
UNIT_ROWS = 4096
N_PIVOTS = 24
#: Reference fingerprints: a fixed pseudo-random sequence.
PIVOTS = np.random.default_rng(2024).integers(0, 2**64, N_PIVOTS, dtype=np.uint64)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def blocks_for(n: int) -> int:
    """Blocks of bits so that n fingerprints meet in units of at most 2 ** CROWD by chance."""
    k = BITS + 2
    while (64 // k) * (k - BITS) < n.bit_length() - CROWD and k < 10:
        k += 1
    return k


def _masks(n_blocks: int = BITS + 2) -> list[int]:
    blocks, at = [], 0
    for k in range(n_blocks):
        w = 64 // n_blocks + (k < 64 % n_blocks)
        blocks.append(((1 << w) - 1) << at)
        at += w
    pairs = [sum(chosen) for chosen in combinations(blocks, n_blocks - BITS)]
    return [m - (1 << 64) if m >> 63 else m for m in pairs]


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64 bits, as a signed long; zero if there is no word."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words), 42)).astype(np.int64))
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], 42) for a, b in zip((end - size).tolist(), end[shingle - 1 :].tolist(), strict=False)), np.uint64, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for part in range(0, len(h), 65536):
        ones += np.unpackbits(h[part : part + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def with_fingerprints(docs: DataFrame, name: str = "fp", shingle: int = 4) -> DataFrame:
    """docs with a long column of fingerprints, in place of any of that name."""
    base = docs.drop(name)
    names = [*base.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([fingerprint(t.as_py(), shingle) for t in b.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, made], names)

    return base.mapInArrow(released(run), wider(base, **{name: "long"}))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def links_in_units(unit: np.ndarray, fp: np.ndarray, part: np.ndarray, whole: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) whose links join every pair of one unit at most `bits` apart.

    whole: the unit's pairs all count; else only pairs of different parts.
    """
    first = _distance(fp, PIVOTS[0]).astype(np.int16)
    order = np.lexsort((first, unit))
    unit, fp, part, whole, first = unit[order], fp[order], part[order], whole[order], first[order]
    table = [_distance(fp, p).astype(np.int8) for p in PIVOTS[1:]]
    label = np.arange(len(fp))
    out: list[tuple[np.ndarray, np.ndarray]] = []
    at, step = np.arange(len(fp)), 0
    while True:
        step += 1
        at = at[at + step < len(fp)]
        at = at[(unit[at + step] == unit[at]) & (first[at + step] - first[at] <= bits)]  # sorted: a pair beyond the band stays beyond
        if not len(at):
            break
        i = at[(whole[at] | (part[at + step] != part[at])) & (label[at] != label[at + step])]
        for column in table:
            if not len(i):
                break
            i = i[np.abs(column[i] - column[i + step]) <= bits]
        i = i[_distance(fp[i], fp[i + step]) <= bits]
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


def _nodes(t: pa.Table, at: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([t.column(c).take(pa.array(at)).combine_chunks() for c in ("none", "least", "fp")], ["none", "least", "fp"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows (unit, none, least, fp, part, whole) that come sorted by unit; the last unit waits for the next batch."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        unit, fp, part, whole = (t.column(c).to_numpy() for c in ("unit", "fp", "part", "whole"))
        again = np.r_[False, unit[1:] == unit[:-1]]
        again[:-1] |= again[1:]
        rows = np.flatnonzero(again)
        i, j = links_in_units(unit[rows], fp[rows].view(np.uint64), part[rows], whole[rows])
        return pa.RecordBatch.from_arrays([_nodes(t, rows[i]), _nodes(t, rows[j])], ["a", "b"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        unit = b.column(0).to_numpy()
        start = int(np.searchsorted(unit != unit[-1], False)) if unit[0] == unit[-1] else int(np.flatnonzero(unit != unit[-1])[-1]) + 1
        if start == 0 and (not held or held[-1].column(0)[-1].as_py() == unit[0]):
            held.append(b)
            continue
        yield solve(pa.Table.from_batches([*held, b.slice(0, start)]))
        held = [b.slice(start)]
    if held:
        yield solve(pa.Table.from_batches(held))


def fingerprint_links(fps: DataFrame, n_blocks: int = BITS + 2) -> DataFrame:
    """(a, b): links that connect every two of the distinct fingerprints fps(fp, doc_id) at most BITS apart.

    a and b are structs (none, least, fp) that sort by doc_id, null ones (none) last.
    """
    keys = F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(_masks(n_blocks))])
    keyed = fps.select("fp", F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("least"), F.explode(keys).alias("unit"))
    large = keyed.groupBy("unit").agg(F.count("*").alias("n")).where(F.col("n") > UNIT_ROWS).select("unit", F.ceil(F.col("n") / UNIT_ROWS).cast("int").alias("pieces"))
    joined = keyed.join(large, "unit", "left")
    part = F.when(F.col("pieces").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int"))
    met = joined.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("pieces"), F.lit(1)) - 1)))
    unit = F.when(F.col("pieces").isNull(), F.col("unit")).otherwise(F.xxhash64("unit", F.least("part", "other"), F.greatest("part", "other")))
    # part == other: within a piece; the piece's rows also meet each other piece, where only pairs of different parts count.
    units = met.select(unit.alias("unit"), "none", "least", "fp", "part", (F.col("part") == F.col("other")).alias("whole"))
    node = "struct<none: boolean, least: long, fp: long>"
    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(released(_scan), f"a {node}, b {node}")


def _counted(fps: DataFrame) -> tuple[DataFrame, int]:
    """(fp, n, component_id) of fps(fp, doc_id), n counting its rows, and the number of all rows."""
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").cast("long").alias("doc_id"), F.count("*").alias("n")))
    different, total = nodes.agg(F.count("*"), F.sum("n")).first()
    linked = components(fingerprint_links(nodes, blocks_for(different)))
    placed = nodes.join(linked, nodes["fp"] == linked["node"]["fp"], "left")
    least = F.when(~F.col("component")["none"], F.col("component")["least"])
    return placed.select("fp", "n", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(least).alias("component_id")), total or 0


def components_of(fps: DataFrame) -> DataFrame:
    """(fp, component_id) of fps(fp, doc_id), any number of rows a fingerprint: the least doc_id reachable over links.

    Null doc_ids are ignored in the minimum; a component of null doc_ids only has a null component_id. An empty table
    gives an empty one.
    """
    return _counted(fps)[0].drop("n")


def with_components(marked: DataFrame, fp: str = "fp", fps: DataFrame | None = None) -> DataFrame:
    """marked with component_id by its column of fingerprints; fps(fp, doc_id) are its fingerprints, if kept elsewhere.

    Fingerprints that over a quarter of a partition's share of all rows have, of which there are fewer than four a
    partition, are broadcast, and their rows are dealt by doc_id; only the others meet their component by fingerprint.
    """
    placed, total = _counted(marked.select(F.col(fp).alias("fp"), "doc_id") if fps is None else fps)
    share = total / (4 * partitions(marked.sparkSession))
    is_hot, hot_fp, hot_id, key, cold_fp, cold_id = (unused(c, marked.columns) for c in ("_hot", "_hot_fp", "_hot_id", "_key", "_cold_fp", "_cold_id"))
    hot = placed.where(F.col("n") > share).select(F.col("fp").alias(hot_fp), F.col("component_id").alias(hot_id), F.lit(True).alias(is_hot))
    cold = placed.where(F.col("n") <= share).select(F.col("fp").alias(cold_fp), F.col("component_id").alias(cold_id))
    met = marked.join(F.broadcast(hot), F.col(fp) == F.col(hot_fp), "left")
    met = met.withColumn(key, F.when(F.col(is_hot), F.xxhash64("doc_id")).otherwise(F.col(fp))).join(cold, F.col(key) == F.col(cold_fp), "left")
    return met.select(*marked.columns, F.when(F.col(is_hot), F.col(hot_id)).otherwise(F.col(cold_id)).alias("component_id"))


def mark_near_copies(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """docs with fingerprint (16 hex digits) and component_id, one row for each row of docs.

    A null text has no words and fingerprint zero, like an empty one; such documents link with each other. Repeated
    rows get the same component. Columns of docs with these two names are replaced, all others come back as they were;
    an empty table gives an empty one.
    """
    base = docs.drop("fingerprint", "component_id")
    fp = unused("_fp", base.columns)
    marked = with_fingerprints(base, fp, shingle)
    joined = with_components(marked, fp, cut(marked.select(F.col(fp).alias("fp"), "doc_id")))
    return joined.select(*base.columns, F.lpad(F.lower(F.hex(fp)), 16, "0").alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """The rows of docs whose doc_id is their component's least; rows without a component id stay."""
    marked = mark_near_copies(docs, shingle)
    return marked.where(F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id"))).select(*docs.columns)
