"""Reading files into rows: delimited text and workbooks by their names, PDFs only probed."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tablemill.sources.delimited import parse_delimited
from tablemill.sources.limits import MAX_ROWS, ROWS, UPLOAD_BYTES
from tablemill.sources.workbook import parse_workbook

TEXT = re.compile(r"\.(csv|tsv|txt)$", re.IGNORECASE)


def sheets_of(name: str, raw: bytes, max_rows: int | None = MAX_ROWS) -> list[tuple[str, list[str], list[list[str]]]]:
    if TEXT.search(name):
        stem = re.sub(r"\.[^.]*$", "", name.rsplit("/", 1)[-1])
        return [(stem or "Sheet1", *parse_delimited(raw.decode("utf-8", errors="replace"), max_rows))]
    return parse_workbook(raw, max_rows)


def read_sheets(files: DataFrame, max_rows: int | None = MAX_ROWS, max_bytes: int | None = UPLOAD_BYTES) -> DataFrame:
    """files(path, content) as rows; a file that can't be read gives one row with its error, so that none is lost.

    A sheet without rows gives one row with row_ord -1 and null cells. The limits are those of an upload; None lifts one,
    for files that a caller wrote.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                out, error = [], None
                try:
                    if not content:
                        raise ValueError("empty file")
                    if max_bytes is not None and len(content) > max_bytes:
                        raise ValueError("file too large")
                    for k, (name, columns, rows) in enumerate(sheets_of(path, bytes(content), max_rows)):
                        out += [(path, k, name, columns, r, cells, None) for r, cells in enumerate(rows)] or [(path, k, name, columns, -1, None, None)]
                except Exception as e:  # a damaged file can fail anywhere in its reader
                    error = str(e) or type(e).__name__
                if error:
                    out = [(path, None, None, None, None, None, error)]
                yield pd.DataFrame(out, columns=["doc_id", "sheet_ord", "name", "columns", "row_ord", "cells", "error"]).astype(object)

    return files.select("path", "content").mapInPandas(run, ROWS)


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    return read_sheets(spark.read.format("binaryFile").load(path))


#: Marks of images, drawn strings, and the least sizes that say something.
_IMAGE = re.compile(rb"/Subtype\s*/Image|/DCTDecode|/JPXDecode|/CCITTFaxDecode|/JBIG2Decode")
_LITERAL = re.compile(rb"\(((?:\\.|[^\\()])*)\)")
_HEX = re.compile(rb"<([0-9A-Fa-f\s]{2,})>\s*(?:Tj|TJ)")
_FLATE = re.compile(rb"/Filter[^>]*/FlateDecode")
DECODED_BYTES, SHOWN_CHARS = 200, 64


def _inflated(body: bytes) -> bytes | None:
    for window in (zlib.MAX_WBITS, -zlib.MAX_WBITS):  # with a header, then raw
        try:
            reader = zlib.decompressobj(window)
            out = reader.decompress(body)
            if reader.eof:
                return out
        except zlib.error:
            continue
    return None


def _streams(raw: bytes) -> Iterator[bytes]:
    """What the streams hold that are plain or deflated; others, such as images, are passed over."""
    at = 0
    while (start := raw.find(b"stream", at)) >= 0:
        body = start + len(b"stream")
        body += raw[body : body + 1] == b"\r"
        body += raw[body : body + 1] == b"\n"
        end = raw.find(b"endstream", body)
        if end < 0:
            return
        at = end + len(b"endstream")
        head = raw.rfind(b"<<", 0, start)
        if head < 0:
            continue
        if _FLATE.search(raw, head, start):
            if (plain := _inflated(raw[body:end])) is not None:
                yield plain
        elif raw.find(b"/Filter", head, start) < 0:
            yield raw[body:end]


def has_text_layer(raw: bytes) -> bool | None:
    """Whether a PDF draws text: true from 64 characters on, false if it only shows images, null if it can't be told."""
    if b"/Encrypt" in raw:
        return None
    decoded = shown = 0
    for body in _streams(raw):
        decoded += len(body)
        if b"BT" in body:
            shown += sum(map(len, _LITERAL.findall(body))) + sum(len(b"".join(h.split())) // 2 for h in _HEX.findall(body))
    if decoded < DECODED_BYTES:
        return None
    if shown >= SHOWN_CHARS:
        return True
    return False if _IMAGE.search(raw) else None


@F.pandas_udf(BooleanType())
def text_layer(content: pd.Series) -> pd.Series:
    return content.map(lambda c: None if c is None else has_text_layer(bytes(c))).astype(object)


def engine_choice(layer: Column, text_rows: Column) -> Column:
    """Which engine's answer counts: OCR where there is no text layer, or where the text engine found no rows."""
    return F.when(~layer, "ocr").when(text_rows > 0, "text").otherwise("ocr")


def engine_cost(layer: Column, text_rows: Column, text_cost: Column, ocr_cost: Column) -> Column:
    """What the engines that ran cost together: the sum of the known costs, null if none is known."""
    text = F.when(F.coalesce(layer, F.lit(True)), text_cost)
    ocr = F.when(~F.coalesce(layer, F.lit(True)) | (text_rows <= 0), ocr_cost)
    return F.when(text.isNotNull() | ocr.isNotNull(), F.coalesce(text, F.lit(0)) + F.coalesce(ocr, F.lit(0)))
