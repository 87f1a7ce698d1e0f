"""Delimited text: the delimiter is sniffed, quotes count anywhere in a cell, and rows keep their printed text."""

from __future__ import annotations

import re

from tablemill.sources.limits import MAX_COLUMNS, MAX_ROWS

#: Delimiters, the first winning a tie.
DELIMITERS = ";\t,|"


def sniff(text: str) -> str:
    """The delimiter that occurs most often outside quotes in the first 20 lines; a comma if none does."""
    sample = "\n".join(re.split(r"\r?\n", text)[:20])
    outside = "".join(sample.split('"')[::2])
    counts = [outside.count(d) for d in DELIMITERS]
    return DELIMITERS[counts.index(max(counts))] if max(counts) else ","


def split_rows(text: str, delimiter: str) -> list[list[str]]:
    """Cells as they stand between delimiters and line ends outside quotes; a doubled quote inside quotes is one."""
    rows, row = [], []
    # Alternately outside and inside quotes; an empty piece outside, between two inside ones, was a doubled quote.
    cell, pieces = "", text.split('"')
    for k, piece in enumerate(pieces):
        if k % 2:
            cell += piece
            continue
        if piece == "" and 0 < k < len(pieces) - 1:
            cell += '"'
            continue
        lines = piece.replace("\r", "").split("\n")
        for n, line in enumerate(lines):
            if n:
                rows.append([*row, cell])
                row, cell = [], ""
            first, *others = line.split(delimiter)
            cell += first
            for other in others:
                row.append(cell)
                cell = other
    if cell or row:
        rows.append([*row, cell])
    return rows


def parse_delimited(text: str, max_rows: int | None = MAX_ROWS) -> tuple[list[str], list[list[str]]]:
    """(headings, rows), padded to one width; ValueError if nothing is there. Without max_rows every row is read."""
    text = text.removeprefix("\ufeff")
    rows = [[re.sub(r"^'(?=[=+@])", "", c.strip()) for c in r] for r in split_rows(text, sniff(text))]
    rows = [r for r in rows if len(r) > 1 or r[0]][: None if max_rows is None else max_rows + 1]
    if not rows:
        raise ValueError("no rows")
    width = min(MAX_COLUMNS, max(map(len, rows)))
    rows = [(r + [""] * width)[:width] for r in rows]
    return rows[0], rows[1:]
