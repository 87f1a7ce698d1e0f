"""Operating limits of one upload: features of the readers, not of the engine."""

MAX_ROWS, MAX_SHEETS, MAX_COLUMNS = 20_000, 20, 200
UPLOAD_BYTES = 25 * 1024 * 1024
MAX_LIST_CHARS, MAX_LOOKUPS, MAX_PRODUCTS, MAX_CHILD_SITEMAPS = 500_000, 200, 500, 3

#: What every reader of files gives: a row for each row of each sheet, the heading row apart.
ROWS = "doc_id string, sheet_ord int, name string, columns array<string>, row_ord int, cells array<string>, error string"
