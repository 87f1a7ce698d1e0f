"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that a Python worker turns into numpy arrays at a time.
CHUNK_BYTES = 2_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where it isn't set, a local folder will do for a local master only; on a cluster that is an error, since every
    executor would write to a disk of its own.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "checkpoints"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, what: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so a lost executor costs no recomputation of earlier rounds."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def unused(name: str, columns: Iterable[str]) -> str:
    """name, with underscores put before it until no column has it, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def wider(df: DataFrame, **columns: str) -> StructType:
    """The schema of df with more columns; df keeps its own."""
    out = StructType(list(df.schema.fields))
    for name, kind in columns.items():
        out = out.add(name, StructType.fromDDL(f"c {kind}")[0].dataType)
    return out


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker hands freed memory back, since it lives on to serve other stages."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries keep what they keep
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, in the order of the rows; a run may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        seen = list(zip(*(b.column(k).to_pylist() for k in keys), strict=True))
        at = 0
        for i, key in enumerate(seen):
            if key != last:
                if i > at:
                    held.append(b.slice(at, i - at))
                if held:
                    yield pa.Table.from_batches(held)
                held, at, last = [], i, key
        if len(seen) > at:
            held.append(b.slice(at))
    if held:
        yield pa.Table.from_batches(held)
