"""Holding the sums of columns against the totals that a document states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablemill.functions import figures
from tablemill.functions.text import END, START, blank, trim
from tablemill.operators.profile import profile

TOLERANCE = 0.05
#: Labels of totals, most telling first, and headings of columns that add up to one.
TIERS = [
    r"(?i)genel\s*toplam|[öÖ]denecek|odenecek|grand\s*total|total\s*payable|vergiler\s*dahil",
    rf"(?i){START}(?:toplam|total){END}",
    rf"(?i){START}(?:tutar|amount|sum){END}",
]
AMOUNT = r"(?i)tutar|amount|total|toplam|bedel"


def stated_totals(rows: DataFrame) -> DataFrame:
    """(doc_id, label, value, tier, place): rows of just a label and a figure, read without a column's mark."""
    pair = rows.withColumn("two", F.filter("cells", lambda c: ~blank(c))).where(F.size("two") == 2)
    tier = F.lit(None).cast("int")
    for k in range(len(TIERS) - 1, -1, -1):
        tier = F.when(F.col("two")[0].rlike(TIERS[k]), k).otherwise(tier)
    read = pair.select("doc_id", trim(F.col("two")[0]).alias("label"), figures.parse_number(F.col("two")[1]).alias("value"), tier.alias("tier"), F.struct("sheet_ord", "row_ord").alias("place"))
    return read.where("value is not null and tier is not null")


def column_sums(rows: DataFrame, sheets: DataFrame) -> DataFrame:
    """(doc_id, sheet_name, column_name, total, col): number columns of sheets with two rows and two figures or more."""
    long = rows.groupBy("doc_id", "sheet_ord").agg(F.count("*").alias("n_rows")).where("n_rows >= 2")
    columns = profile(rows).where("kind = 'number' and n_numbers >= 2").join(long, ["doc_id", "sheet_ord"]).join(sheets, ["doc_id", "sheet_ord"])
    heading = F.coalesce(F.get("columns", F.col("col_ord")), F.lit(""))
    name = F.when(heading != "", heading).otherwise(F.concat(F.lit("Column "), (F.col("col_ord") + 1).cast("string")))
    total = (F.floor(F.col("total") * 100 + F.lit(0.5).cast("decimal(2,1)")) / 100).cast("decimal(38,2)")
    return columns.select("doc_id", F.col("name").alias("sheet_name"), name.alias("column_name"), total.alias("total"), F.struct("sheet_ord", "col_ord").alias("col"))


def reconcile(rows: DataFrame, sheets: DataFrame) -> DataFrame:
    """One verdict a document that states a total to check: ok, sheet_name, column_name, total, stated, stated_label, delta.

    A match is the first within the tolerance by (tier, value from the largest, column); without one, the column that
    claims to add up and comes closest to the best stated total.
    """
    stated, sums = stated_totals(rows), column_sums(rows, sheets)
    best = Window.partitionBy("doc_id").orderBy("tier", F.desc("value"), "place")
    ranked = stated.withColumn("rank", F.row_number().over(best))
    # A document has few totals and few columns: an equi-join on the document, the band is a filter.
    pairs = ranked.join(sums, "doc_id").withColumn("gap", F.abs(F.col("total") - F.col("value")))
    choice = F.struct("rank", "col", F.struct("sheet_name", "column_name", "total", "value", "label").alias("x"))
    miss = F.struct("gap", "col", F.struct("sheet_name", "column_name", "total", "value", "label").alias("x"))
    claims = (F.col("rank") == 1) & F.col("column_name").rlike(AMOUNT) & (F.col("value") != 0)
    found = pairs.groupBy("doc_id").agg(F.min(F.when(F.col("gap") <= TOLERANCE, choice)).alias("hit"), F.min(F.when(claims, miss)).alias("near"))
    x = F.coalesce("hit.x", "near.x")
    out = found.where(x.isNotNull()).select("doc_id", F.col("hit").isNotNull().alias("ok"), x.alias("x"))
    delta = F.when(F.col("ok"), F.lit(0).cast("decimal(38,10)")).otherwise(F.col("x.total") - F.col("x.value"))
    return out.select("doc_id", "ok", "x.sheet_name", "x.column_name", "x.total", F.col("x.value").alias("stated"), F.col("x.label").alias("stated_label"), delta.cast("decimal(38,10)").alias("delta"))
