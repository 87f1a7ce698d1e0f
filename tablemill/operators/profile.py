"""Column statistics: decimal mark, kind, places, sums and barcode shape of every column in one aggregate.

Rows are rows(doc_id, sheet_ord, row_ord, cells array<string>); headings are sheets(doc_id, sheet_ord, name, columns
array<string>). Counts are kept for each possible mark at once, so that one pass over the cells settles all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.functions import barcodes, figures, headings
from tablemill.functions.text import trim

SHARE, SHAPE = 0.75, 0.6
MARKS = {"dot": ".", "comma": ",", "cell": None}
KEY = ["doc_id", "sheet_ord", "col_ord"]


def cells(rows: DataFrame, row_limit: int | None = None) -> DataFrame:
    kept = rows if row_limit is None else rows.where(F.col("row_ord") < row_limit)
    return kept.select("doc_id", "sheet_ord", "row_ord", F.posexplode("cells").alias("col_ord", "raw"))


def profile(rows: DataFrame, row_limit: int | None = None) -> DataFrame:
    """One row a column that has a filled cell: filled, mark, kind, places, n_numbers, total and code_share."""
    each = cells(rows, row_limit).withColumn("raw", trim(F.coalesce("raw", F.lit("")))).where("raw <> ''")
    each = figures.with_readings(each.withColumn("date", figures.date_of(F.col("raw")).isNotNull()), "raw", MARKS, "vote", skip="date")
    code = barcodes.normalize_barcode("raw")
    each = each.withColumn("code", F.coalesce(F.length(code) >= 8, F.lit(False)))
    sums = [a for n in MARKS for a in (F.count(F.col(n)["value"]).alias(f"n_{n}"), F.max(F.col(n)["places"]).alias(f"p_{n}"), F.sum(F.col(n)["value"]).alias(f"s_{n}"))]
    found = each.groupBy(*KEY).agg(
        F.count("*").alias("filled"), F.count_if("date").alias("dates"), F.count_if(F.col("vote") == ".").alias("dots"), F.count_if(F.col("vote") == ",").alias("commas"),
        F.coalesce(F.bool_or(F.col("raw").rlike("^0[0-9]") & ~F.col("date")), F.lit(False)).alias("padded"), F.count_if("code").alias("codes"), *sums,
    )
    mark = F.when(F.col("dots") > F.col("commas"), ".").when(F.col("commas") > F.col("dots"), ",")

    def by_mark(prefix: str) -> Column:
        return F.when(mark == ".", F.col(f"{prefix}_dot")).when(mark == ",", F.col(f"{prefix}_comma")).otherwise(F.col(f"{prefix}_cell"))

    numeric, dated = by_mark("n") / F.col("filled"), F.col("dates") / F.col("filled")
    kind = F.when(F.col("padded"), "text").when((numeric >= SHARE) & (numeric >= dated), "number").when(dated >= SHARE, "date").otherwise("text")
    return found.select(
        *KEY, "filled", mark.alias("mark"), kind.alias("kind"), F.least(F.coalesce(by_mark("p"), F.lit(0)), F.lit(figures.MAX_PLACES)).alias("places"),
        by_mark("n").alias("n_numbers"), by_mark("s").alias("total"), (F.col("codes") / F.col("filled")).alias("code_share"),
    )


def heading_rows(sheets: DataFrame) -> DataFrame:
    return sheets.select("doc_id", "sheet_ord", F.posexplode("columns").alias("col_ord", "heading")).withColumn("heading", F.coalesce("heading", F.lit("")))


def barcode_columns(sheets: DataFrame, columns: DataFrame) -> DataFrame:
    """(doc_id, sheet_ord, barcode_col): the first heading that names barcodes, else the best shape above 0.6, else -1."""
    named = heading_rows(sheets).where(headings.normalize_heading(F.col("heading")).rlike(headings.pattern(headings.BARCODE_TERMS)))
    named = named.groupBy("doc_id", "sheet_ord").agg(F.min("col_ord").alias("by_name"))
    shaped = columns.where(F.col("code_share") > SHAPE).groupBy("doc_id", "sheet_ord").agg(F.max_by("col_ord", F.struct("code_share", -F.col("col_ord"))).alias("by_shape"))
    joined = sheets.select("doc_id", "sheet_ord").join(named, ["doc_id", "sheet_ord"], "left").join(shaped, ["doc_id", "sheet_ord"], "left")
    return joined.select("doc_id", "sheet_ord", F.coalesce("by_name", "by_shape", F.lit(-1)).alias("barcode_col"))


def name_columns(sheets: DataFrame) -> DataFrame:
    """(doc_id, sheet_ord, name_col): the first heading whose settled identity is item."""
    from tablemill.operators.stack import resolve_headings

    return resolve_headings(heading_rows(sheets), ["doc_id", "sheet_ord"]).where("key = 'item'").groupBy("doc_id", "sheet_ord").agg(F.min("col_ord").alias("name_col"))


def writers(rows: DataFrame, sheets: DataFrame, row_limit: int | None = None) -> DataFrame:
    """(doc_id, sheet_ord, kinds, marks, places, barcode_col): how each sheet's cells are written; barcodes are text."""
    columns = profile(rows, row_limit)
    code = barcode_columns(sheets, columns)
    packed = F.map_from_entries(F.collect_list(F.struct("col_ord", F.struct("kind", "mark", "places"))))
    packs = columns.groupBy("doc_id", "sheet_ord").agg(packed.alias("by_col"))
    return code.join(packs, ["doc_id", "sheet_ord"], "left")


def written(cells_: Column, by_col: Column, barcode_col: Column, mark: str) -> Column:
    """Cells as a file shows them: figures at their column's places, all else as it was."""

    def cell(raw: Column, at: Column) -> Column:
        how = F.try_element_at(by_col, at)
        figure = figures.read_by(raw, how["mark"])
        return F.when((how["kind"] == "number") & (at != barcode_col), F.coalesce(figures.print_figure(figure["value"], how["places"], mark), raw)).otherwise(raw)

    return F.transform(cells_, lambda raw, at: F.coalesce(cell(F.coalesce(raw, F.lit("")), at), F.lit("")))


def preview(rows: DataFrame, sheets: DataFrame, limit: int = 200) -> DataFrame:
    """The kinds that a preview of the first rows shows."""
    columns = profile(rows, limit)
    code = barcode_columns(sheets, columns)
    shown = F.when(F.col("col_ord") == F.col("barcode_col"), "text").otherwise(F.col("kind"))
    return columns.join(code, ["doc_id", "sheet_ord"]).select("doc_id", "sheet_ord", "col_ord", shown.alias("kind"), "filled")


def mended(rows: DataFrame, code: DataFrame) -> DataFrame:
    """rows with barcodes repaired in their sheet's barcode column, and whether a cell was."""
    joined = rows.join(code, ["doc_id", "sheet_ord"], "left")
    fixed = F.transform("cells", lambda c, i: F.when(i == F.col("barcode_col"), barcodes.repair_barcode(c)).otherwise(c))
    return joined.withColumn("fixed", fixed).select("doc_id", "sheet_ord", "row_ord", F.col("fixed").alias("cells"), (F.col("fixed") != F.col("cells")).alias("repaired"))


