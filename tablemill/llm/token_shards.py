"""Training-order materialisation of token ids as binary shards.

A sequence is a document's token ids and an end id. Its index is its partition's offset plus its place in the
partition; a keyed Feistel permutation of the next even power of two, walked along its cycle until it falls below the
number of sequences, turns the index into a global slot. So any slot can be found without sorting or shuffling indices.
Range partitions of slots then tokenise and write shards: `per_shard` slots each, ids in slot order as little-endian
unsigned 16-bit integers in records of `record` ids (the last record is filled with the end id), beside an index of
fixed-stride entries. Record k of a shard starts at byte 2 * record * k, so a reader resumes from any record or slot.
A shard is written under a temporary name and renamed, so that a repeated task replaces equal bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.llm import word_tokens
from tablemill.llm.common import partitions, released, text_or_empty, unused

PER_SHARD, RECORD, ROUNDS = 4096, 2048, 6
#: Documents come in a random order here, which a larger cache of pieces makes up for.
CACHE_PIECES = 600_000
ENTRY = np.dtype([("slot", "<i8"), ("doc_id", "<i8"), ("no_id", "<i8"), ("start", "<i8"), ("length", "<i8"), ("crc32", "<i8")])


def _round(x: np.ndarray, key: int, step: int) -> np.ndarray:
    """A 64-bit finaliser of (x, key, step)."""
    h = x ^ np.uint64((key * 0x9E3779B97F4A7C15 + step * 0xD1B54A32D192ED03) % 2**64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return h ^ (h >> np.uint64(31))


def slots(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """The permutation of 0..n-1 that key names, at index."""
    if n <= 1:
        return index.astype(np.int64)
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    out = index.astype(np.uint64)
    walk = np.ones(len(out), bool)
    while walk.any():
        x = out[walk]
        left, right = x >> half, x & mask
        for step in range(ROUNDS):
            left, right = right, left ^ (_round(right, key, step) & mask)
        out[walk] = (left << half) | right
        walk = out >= np.uint64(n)
    return out.astype(np.int64)


def with_slots(docs: DataFrame, key: int) -> tuple[DataFrame, int]:
    """docs with a long column slot, in place of any of that name, and the number of rows.

    docs must be a stable scan: counted and numbered apart, it has to give the same rows in the same order both times
    (files or a checkpoint do; another partitioning raises an error, another order of rows alone can't be noticed).
    The driver gets one count for each partition of the scan. Nulls and repeated rows each get a slot; an empty table
    gives an empty one.
    """
    docs = docs.drop("slot")
    at = unused("__ts_at", docs.columns)
    placed = docs.withColumn(at, F.monotonically_increasing_id())
    counts = placed.groupBy(F.shiftright(at, 33).alias("part")).count().collect()
    size = np.zeros(max([r["part"] for r in counts], default=0) + 1, np.int64)
    for r in counts:
        size[r["part"]] = r["count"]
    before, total = np.cumsum(size) - size, int(size.sum())

    @F.pandas_udf("long")
    def slot(ids):
        ids = ids.to_numpy()
        part, nth = ids >> 33, ids & ((1 << 33) - 1)
        if (nth >= size[part]).any():
            raise ValueError("the scan's partitions changed between counting and numbering")
        import pandas as pd

        return pd.Series(slots(before[part] + nth, total, key))

    return placed.withColumn("slot", slot(at)).drop(at), total


def _files(uri: str) -> tuple[pa.fs.FileSystem, str]:
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pa.fs.FileSystem.from_uri(uri)


def write_shards(docs: DataFrame, path: str, tokenizer: str, key: int = 1, per_shard: int = PER_SHARD, record: int = RECORD, end_id: int = 0) -> DataFrame:
    """Write shards of docs(doc_id, text) under path; returns (shard, n_sequences, n_ids, crc32) of what was written.

    Null texts are empty (the end id alone); null doc_ids are marked in the index; repeated rows are sequences of their
    own. An empty table writes nothing. A token id of 65,536 or more is an error. docs must be a stable scan (with_slots).
    """
    numbered, _ = with_slots(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), key)
    ranged = numbered.withColumn("shard", F.floor(F.col("slot") / per_shard)).repartitionByRange(partitions(docs.sparkSession), "shard").sortWithinPartitions("slot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = word_tokens.load(tokenizer, CACHE_PIECES)
        fs, top = _files(path)
        fs.create_dir(top, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        if not 0 <= end_id < 2**16:
            raise ValueError(f"end id {end_id} doesn't fit into 16 bits")
        end = np.array([end_id], "<u2").tobytes()
        shard, out, entries, at, crc = -1, None, [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal crc
            if at % record:
                out.write(fill := end * (record - at % record))
                crc = zlib.crc32(fill, crc)
            out.close()
            name = f"{top}/{shard:08d}"
            with fs.open_output_stream(f"{name}.idx.{attempt}") as f:
                f.write(np.array(entries, ENTRY).tobytes())
            for kind in ("bin", "idx"):
                if fs.get_file_info(f"{name}.{kind}").type != pa.fs.FileType.NotFound:
                    fs.delete_file(f"{name}.{kind}")  # a repeated task's equal bytes; not every file system replaces
                fs.move(f"{name}.{kind}.{attempt}", f"{name}.{kind}")
            return pa.RecordBatch.from_pylist([{"shard": shard, "n_sequences": len(entries), "n_ids": at, "crc32": crc}])

        def shards() -> Iterator[pa.RecordBatch]:
            nonlocal shard, out, entries, at, crc
            for b in (whole.slice(k, 1500) for whole in batches for k in range(0, whole.num_rows, 1500)):
                coded = model.batch(b.column("text").to_pylist())
                for own, slot, doc, ids in zip(b.column("shard").to_pylist(), b.column("slot").to_pylist(), b.column("doc_id").to_pylist(), coded, strict=True):
                    if own != shard:
                        if out:
                            yield close()
                        shard, entries, at, crc = own, [], 0, 0
                        out = fs.open_output_stream(f"{top}/{shard:08d}.bin.{attempt}")
                    wide = np.frombuffer(ids, "<u4")
                    if len(wide) and wide.max() >= 2**16:
                        raise ValueError(f"token id {wide.max()} doesn't fit into 16 bits")
                    narrow = wide.astype("<u2").tobytes() + end
                    out.write(narrow)
                    crc = zlib.crc32(narrow, crc)
                    entries.append((slot, doc or 0, doc is None, at, len(narrow) // 2, zlib.crc32(narrow)))
                    at += len(narrow) // 2
            if out:
                yield close()

        try:
            yield from shards()
        except BaseException:  # a failed or cancelled attempt leaves nothing behind
            if out and not out.closed:
                out.close()
            for kind in ("bin", "idx"):
                if fs.get_file_info(left := f"{top}/{shard:08d}.{kind}.{attempt}").type != pa.fs.FileType.NotFound:
                    fs.delete_file(left)
            raise

    return ranged.mapInArrow(released(run), "shard long, n_sequences long, n_ids long, crc32 long")


def read_shard(path: str, shard: int, from_slot: int | None = None, record: int = RECORD) -> Iterator[tuple[int, int | None, int, np.ndarray]]:
    """(slot, doc_id, start, ids) of a shard in order, from its first slot or from one on; reads the file once, forward."""
    fs, top = _files(path)
    with fs.open_input_stream(f"{top}/{shard:08d}.idx") as f:
        entries = np.frombuffer(f.read(), ENTRY)
    if from_slot is not None:
        entries = entries[entries["slot"] >= from_slot]
    if not len(entries):
        return
    with fs.open_input_file(f"{top}/{shard:08d}.bin") as f:
        f.seek(2 * int(entries["start"][0]))
        for e in entries:
            yield int(e["slot"]), None if e["no_id"] else int(e["doc_id"]), int(e["start"]), np.frombuffer(f.read(2 * int(e["length"])), "<u2")


def read_index(spark: SparkSession, written: DataFrame, path: str) -> DataFrame:
    """(doc_id, slot, shard, start, n_ids, ids_crc32) of all sequences, from the shards' files.

    written: what write_shards returned, a row a shard; an empty table gives an empty one, a repeated row its shard twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard in b.column("shard").to_pylist():
                rows = [(doc, slot, shard, start, len(ids), zlib.crc32(ids.tobytes())) for slot, doc, start, ids in read_shard(path, shard)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "slot", "shard", "start", "n_ids", "ids_crc32"])

    return written.select("shard").mapInArrow(run, "doc_id long, slot long, shard long, start long, n_ids long, ids_crc32 long")
