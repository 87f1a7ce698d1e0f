"""Exact dedup by content sort, in DataFrame operations only.

Sampled splitters range-partition the documents on a short key that equal texts share; an external sort within each
range places equal texts adjacent; a window over the sorted rows compares neighbours' whole texts. The range key is a
prefix and a hash rather than the text, so that the driver's sample of splitters stays small however long texts are.

Copies of one text share a range. So that a text with very many copies doesn't fill one, a map-side combined count of
hashes finds all texts whose copies hold more than HOT_PART of a partition's share of bytes; their key gets a salt of as
many values as it takes to bring them below it, and one map-side combined aggregate replaces what the ranges found for
them. There are at most partitions / HOT_PART of them, each broadcast as hashes and numbers only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemill.llm.common import cut, partitions, text_or_empty, unused

#: Share of a partition's bytes from which copies of one text are spread, and the least number of copies.
HOT_PART, HOT_COPIES = 0.25, 20
#: What a row weighs beside its text.
ROW_BYTES = 64


def _hot(keyed: DataFrame, h: str, norm: str) -> DataFrame | None:
    """(hh, salts) of texts with very many copies, or None where there are none."""
    counted = keyed.groupBy(F.col(h).alias("hh")).agg(F.count("*").alias("n"), F.sum(F.octet_length(norm) + ROW_BYTES).alias("w"))
    # Rare texts join in one row without a hash, so that the totals come from the same pass over the texts.
    often = cut(counted.groupBy(F.when(F.col("n") >= HOT_COPIES, F.col("hh")).alias("hh")).agg(F.sum("w").alias("w")))
    share = (often.agg(F.sum("w")).first()[0] or 0) / partitions(keyed.sparkSession) * HOT_PART
    hot = often.where(F.col("hh").isNotNull() & (F.col("w") > F.lit(share))).select("hh", F.ceil(F.col("w") / F.lit(max(share, 1.0))).cast("int").alias("salts"))
    return None if hot.isEmpty() else hot


def mark_copies(docs: DataFrame, normalised: Column | None = None, keep: str = "smallest") -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256.

    normalised: the text that is compared; by default the text as it is, null as empty. keep: the smallest or largest
    doc_id of equal texts stays. A null doc_id counts as below all others; of rows that also share the doc_id, each
    has kept set alike. Columns that docs already has under these names are replaced, all others come back as they were;
    an empty table gives an empty one.
    """
    names = ("keep_id", "group_size", "kept", "text_sha256")
    base = docs.drop(*names)
    n, h, p, s, k, c, hh, salts, wh, ws = (unused(f"__ed_{x}", base.columns) for x in ("n", "h", "p", "s", "k", "c", "hh", "salts", "wh", "ws"))
    norm = text_or_empty() if normalised is None else normalised
    keyed = base.withColumn(n, norm).withColumn(h, F.xxhash64(n))
    hot = _hot(keyed, h, n)
    dealt = keyed.withColumn(p, F.substring(n, 1, 24))
    key = [p, h]
    if hot is not None:  # a constant salt would be folded away, and the window below would shuffle again
        dealt = dealt.join(F.broadcast(hot.toDF(hh, salts)), F.col(h) == F.col(hh), "left")
        salt = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.monotonically_increasing_id())), F.coalesce(salts, F.lit(1)))
        dealt, key = dealt.withColumn(s, salt.cast("int")).drop(salts), [*key, s]
    dealt = dealt.repartitionByRange(partitions(docs.sparkSession), *key)
    first = F.col("doc_id").asc_nulls_first() if keep == "smallest" else F.col("doc_id").desc_nulls_last()
    near = Window.partitionBy(*key, n).orderBy(first)
    out = dealt.withColumn("keep_id", F.first("doc_id").over(near)).withColumn("group_size", F.count("*").over(near.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    out = out.withColumn("text_sha256", F.sha2(F.col(n).cast("binary"), 256))
    if hot is not None:
        pick = (F.min("doc_id"), F.count("doc_id") < F.count("*")) if keep == "smallest" else (F.max("doc_id"), F.lit(False))
        whole = keyed.join(F.broadcast(hot.toDF(hh, salts)), F.col(h) == F.col(hh)).groupBy(hh, n).agg(F.when(~pick[1], pick[0]).alias(k), F.count("*").alias(c))
        # As many rows as hot texts (equal hashes of different texts aside), told by digests: bounded in rows and bytes.
        whole = whole.select(F.col(hh).alias(wh), F.sha2(F.col(n).cast("binary"), 256).alias(ws), k, c)
        out = out.join(F.broadcast(whole), (F.col(hh) == F.col(wh)) & (F.col("text_sha256") == F.col(ws)), "left")
        found = F.col(c).isNotNull()
        out = out.withColumn("keep_id", F.when(found, F.col(k)).otherwise(F.col("keep_id"))).withColumn("group_size", F.when(found, F.col(c)).otherwise(F.col("group_size")))
    out = out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return out.select(*base.columns, *names)


def exact_dedup(docs: DataFrame, normalised: Column | None = None, keep: str = "smallest") -> DataFrame:
    """The rows of docs whose text no other row with a smaller (or larger) doc_id has; repeated rows of one doc_id stay."""
    return mark_copies(docs, normalised, keep).where("kept").select(*docs.columns)
