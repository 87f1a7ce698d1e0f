"""Writing tables: delimited text, clipboard text and HTML, JSON, and typed cells for workbooks.

A sheet's lines are expressions over its rows; text of a whole sheet is only put together for one (doc_id, sheet_ord),
whose size the readers bound.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.functions import figures
from tablemill.functions.text import escape_html
from tablemill.operators.profile import writers, written
from tablemill.sources.workbook import write_workbook

BOM = "\ufeff"


def guard(c: Column) -> Column:
    """A cell that a spreadsheet would run as a formula gets a mark; signed figures don't."""
    return F.when(c.rlike("^[=+@]") & ~c.rlike(r"^[-+]?[0-9.,]+$"), F.concat(F.lit("'"), c)).otherwise(c)


def unguard(c: Column) -> Column:
    return F.regexp_replace(c, "^'(?=[=+@])", "")


def quoted(c: Column, delimiter: str) -> Column:
    must = c.contains('"') | c.contains("\n") | c.contains("\r") | c.contains(delimiter)
    return F.when(must, F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def csv_line(cells: Column, delimiter: str) -> Column:
    return F.array_join(F.transform(cells, lambda c: quoted(guard(c), delimiter)), delimiter)


def tsv_line(cells: Column, width: Column) -> Column:
    flat = F.transform(cells, lambda c: F.regexp_replace(c, r"[\t\r\n]+", " "))
    return F.array_join(F.concat(flat, F.array_repeat(F.lit(""), F.greatest(width - F.size(cells), F.lit(0)))), "\t")


def html_row(cells: Column, width: Column, is_text: Column, tag: str = "td") -> Column:
    """A table row; cells of text columns are pinned as text."""
    padded = F.concat(cells, F.array_repeat(F.lit(""), F.greatest(width - F.size(cells), F.lit(0))))
    style = " style=\"mso-number-format:'\\@'\""
    cell = lambda c, i: F.concat(F.lit(f"<{tag}"), F.when(F.coalesce(F.get(is_text, i), F.lit(True)), style).otherwise(""), F.lit(">"), escape_html(c), F.lit(f"</{tag}>"))
    return F.concat(F.lit("<tr>"), F.array_join(F.transform(padded, cell), ""), F.lit("</tr>"))


def prepared(rows: DataFrame, sheets: DataFrame, mark: str) -> DataFrame:
    """rows with cells as files show them."""
    joined = rows.join(writers(rows, sheets), ["doc_id", "sheet_ord"])
    return joined.withColumn("cells", written(F.col("cells"), F.col("by_col"), F.col("barcode_col"), mark)).drop("by_col", "barcode_col")


def csv_files(rows: DataFrame, sheets: DataFrame, lang: str = "en") -> DataFrame:
    """(doc_id, sheet_ord, name, content): a file a sheet, with a byte order mark and no line end after the last line."""
    mark, delimiter = (",", ";") if lang == "tr" else (".", ",")
    lines = prepared(rows, sheets, mark).groupBy("doc_id", "sheet_ord").agg(F.array_sort(F.collect_list(F.struct("row_ord", csv_line(F.col("cells"), delimiter).alias("line")))).alias("lines"))
    head = F.when(F.size("columns") > 0, F.array(csv_line(F.transform("columns", lambda c: F.coalesce(c, F.lit(""))), delimiter))).otherwise(F.array().cast("array<string>"))
    body = F.coalesce(F.transform("lines", lambda x: x["line"]), F.array().cast("array<string>"))
    return sheets.join(lines, ["doc_id", "sheet_ord"], "left").select("doc_id", "sheet_ord", "name", F.concat(F.lit(BOM), F.array_join(F.concat(head, body), "\r\n")).alias("content"))


def json_files(rows: DataFrame, sheets: DataFrame) -> DataFrame:
    """(doc_id, content): {sheets} with raw text."""
    body = rows.groupBy("doc_id", "sheet_ord").agg(F.array_sort(F.collect_list(F.struct("row_ord", "cells"))).alias("r"))
    one = sheets.join(body, ["doc_id", "sheet_ord"], "left").withColumn("rows", F.coalesce(F.transform("r", lambda x: x["cells"]), F.array().cast("array<array<string>>")))
    packed = one.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sheet_ord", "name", "columns", "rows"))).alias("s"))
    sheet = F.transform("s", lambda x: F.struct(x["name"].alias("name"), x["columns"].alias("columns"), x["rows"].alias("rows")))
    return packed.select("doc_id", F.to_json(F.struct(sheet.alias("sheets")), {"pretty": "true"}).alias("content"))


def typed_cells(rows: DataFrame, sheets: DataFrame) -> DataFrame:
    """rows with typed: array of (kind, number, day, text, format) as a workbook holds them; barcodes stay text."""
    joined = rows.join(writers(rows, sheets), ["doc_id", "sheet_ord"])

    def cell(raw: Column, at: Column) -> Column:
        how = F.try_element_at("by_col", at)
        value, day = figures.read_by(raw, how["mark"])["value"], figures.parse_date(raw)
        kind = (
            F.when(F.trim(raw) == "", "blank")
            .when((at != F.col("barcode_col")) & (how["kind"] == "number") & value.isNotNull(), "number")
            .when((at != F.col("barcode_col")) & (how["kind"] == "date") & day.isNotNull(), "date")
            .otherwise("text")
        )
        return F.struct(kind.alias("kind"), F.when(kind == "number", value).alias("number"), F.when(kind == "date", day).alias("day"), raw.alias("text"), figures.number_format(how["places"]).alias("format"))

    return joined.select("doc_id", "sheet_ord", "row_ord", F.transform("cells", lambda c, i: cell(F.coalesce(c, F.lit("")), i)).alias("typed"))


def workbooks(rows: DataFrame, sheets: DataFrame) -> DataFrame:
    """(doc_id, content): an XLSX file a document."""
    body = typed_cells(rows, sheets).groupBy("doc_id", "sheet_ord").agg(F.array_sort(F.collect_list(F.struct("row_ord", "typed"))).alias("rows"))
    one = sheets.join(body, ["doc_id", "sheet_ord"], "left").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sheet_ord", "name", "columns", "rows"))).alias("s"))

    @F.pandas_udf("binary")
    def book(s: pd.Series) -> pd.Series:
        def value(c: dict) -> tuple:
            kind = c["kind"]
            return kind, c["text"] if kind in ("text", "blank") else c["number"].normalize().__format__("f") if kind == "number" else c["day"], c["format"]

        def made(found: list[dict]) -> bytes:
            return write_workbook([(x["name"], list(x["columns"]), [[value(c) for c in r["typed"]] for r in (x["rows"] if x["rows"] is not None else [])]) for x in found])

        return s.map(made)

    return one.select("doc_id", book("s").alias("content"))
