"""Stacking differently shaped tables by what their headings mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemill.functions.headings import identify
from tablemill.functions.text import trim

SOURCE = "__source"


def resolve_headings(named: DataFrame, by: list[str]) -> DataFrame:
    """named(by..., col_ord, heading) with key and label: one column of a document wins each identity."""
    found = named.withColumn("id", identify(F.col("heading")))
    rival = Window.partitionBy(*by, "id.key").orderBy("id.rank", "col_ord")
    found = found.withColumn("won", F.row_number().over(rival) == 1)
    lost_label = F.when(trim("heading") != "", trim("heading")).otherwise(F.col("id.label"))
    key = F.when(F.col("won"), F.col("id.key")).otherwise(F.concat("id.key", F.lit(":"), "id.norm"))
    return found.select(*named.columns, key.alias("key"), F.when(F.col("won"), F.col("id.label")).otherwise(lost_label).alias("label"))


def primary_sheets(rows: DataFrame, sheets: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """(doc_id, primary): the sheet of most cells, narrow ones counting little, the first on a tie; or the chosen one."""
    sizes = rows.groupBy("doc_id", "sheet_ord").agg(F.count("*").alias("n"), F.max(F.size("cells")).alias("widest"))
    width = F.greatest(F.size("columns"), F.col("widest"))
    scored = sheets.join(sizes, ["doc_id", "sheet_ord"]).withColumn("score", F.col("n") * F.when(width <= 2, 0.25).otherwise(width))
    best = sheets.groupBy("doc_id").agg(F.max("sheet_ord").alias("last")).join(scored.groupBy("doc_id").agg(F.max_by("sheet_ord", F.struct("score", -F.col("sheet_ord"))).alias("found")), "doc_id", "left")
    if chosen is None:
        return best.select("doc_id", F.coalesce("found", F.lit(-1)).alias("primary"))
    best = best.join(chosen.select("doc_id", "primary_index"), "doc_id", "left")
    return best.select("doc_id", F.coalesce(F.when(F.col("primary_index").between(0, F.col("last")), F.col("primary_index")), "found", F.lit(-1)).alias("primary"))


def discover(resolved: DataFrame) -> DataFrame:
    """(key, label, ord) of resolved(doc_ord, col_ord, key, label): the source first, then keys as they are first met."""
    met = resolved.groupBy("key").agg(F.min(F.struct("doc_ord", "col_ord", "label")).alias("first"))
    listed = met.select("key", F.col("first.label").alias("label"), F.row_number().over(Window.orderBy("first.doc_ord", "first.col_ord")).alias("ord"))
    return listed.sparkSession.createDataFrame([(SOURCE, "Source", 0)], "key string, label string, ord int").unionByName(listed)


def layout(columns: list[tuple[str, str]], prefs: dict[str, dict] | None = None) -> list[tuple[str, str]]:
    """(key, label) of discovered columns under remembered labels, order and inclusion; unseen ones come last."""
    prefs = prefs or {}
    order = sorted(range(len(columns)), key=lambda i: (prefs.get(columns[i][0], {}).get("order", float("inf")), i))
    return [(columns[i][0], prefs.get(columns[i][0], {}).get("label") or columns[i][1]) for i in order if prefs.get(columns[i][0], {}).get("include", True)]


def moved(keys: list[str], key: str, by: int, prefs: dict[str, dict]) -> dict[str, dict]:
    """prefs after a column moved by one place; the whole order is pinned."""
    at = keys.index(key)
    to = max(0, min(len(keys) - 1, at + by))
    keys = [*keys[:at], *keys[at + 1 :]]
    keys.insert(to, key)
    return {**prefs, **{k: {**prefs.get(k, {}), "order": i} for i, k in enumerate(keys)}}


def combine(rows: DataFrame, resolved: DataFrame, docs: DataFrame, keys: list[str]) -> DataFrame:
    """rows(doc_id, row_ord, cells) of all documents under the columns `keys`, missing cells blank.

    resolved has (doc_id, col_ord, key); docs has (doc_id, doc_ord, filename). Where two columns of a document share a
    key the later one that a row reaches counts, also where it is blank.
    """
    places = resolved.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("col_ord")).alias("at")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "at"))).alias("at"))
    joined = rows.join(docs, "doc_id").join(places, "doc_id", "left")

    def cell(k: str) -> Column:
        reached = F.filter(F.try_element_at("at", F.lit(k)), lambda at: at < F.size("cells"))
        return F.coalesce(F.get("cells", F.array_max(reached)), F.lit(""))

    return joined.select("doc_ord", "row_ord", *(F.col("filename").alias(k) if k == SOURCE else cell(k).alias(k) for k in keys))
