"""XLSX workbooks, read and written with the standard library alone."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

from tablemill.sources.limits import MAX_COLUMNS, MAX_ROWS, MAX_SHEETS

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
RID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Built-in number formats that show dates, and those that show decimal places.
DATE_FORMATS = {14, 15, 16, 17, 22}
PLACES = {2: 2, 4: 2, 10: 2, 39: 2, 40: 2}
EPOCH = dt.date(1899, 12, 30)
SHEET_TITLE = 31


def format_places(fmt: str) -> int | None:
    """Decimal places that a number format declares: the run of zeros behind its first point or comma."""
    m = re.search(r"[.,](0+)", re.sub(r'"[^"]*"', "", fmt).split(";")[0])
    return len(m[1]) if m else None


def _is_date(fmt: str) -> bool:
    plain = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", fmt).lower()
    return bool(re.search(r"[yd]", plain)) and not re.search(r"[#0]", plain)


def _number(text: str, style: tuple[int | None, bool]) -> str:
    places, dated = style
    value = float(text)
    if dated:
        return (EPOCH + dt.timedelta(days=int(value))).strftime("%d.%m.%Y")
    if places is not None:
        return f"{value:.{min(places, 6)}f}"
    return str(int(value)) if value == int(value) and abs(value) < 1e21 else repr(value)


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _texts(node: ET.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{{{NS['m']}}}t"))


def parse_workbook(raw: bytes, max_rows: int | None = MAX_ROWS) -> list[tuple[str, list[str], list[list[str]]]]:
    """(name, headings, rows) of each sheet with a filled row; ValueError if there is none. Without max_rows every row is read."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    names = set(z.namelist())
    shared = [_texts(s) for s in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", NS)] if "xl/sharedStrings.xml" in names else []
    styles: list[tuple[int | None, bool]] = [(None, False)]
    if "xl/styles.xml" in names:
        root = ET.fromstring(z.read("xl/styles.xml"))
        custom = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.findall("m:numFmts/m:numFmt", NS)}
        ids = [int(x.get("numFmtId", 0)) for x in root.findall("m:cellXfs/m:xf", NS)]
        styles = [(format_places(custom[i]), _is_date(custom[i])) if i in custom else (PLACES.get(i), i in DATE_FORMATS) for i in ids] or styles
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    sheets = ET.fromstring(z.read("xl/workbook.xml")).findall("m:sheets/m:sheet", NS)[:MAX_SHEETS]
    for at, sheet in enumerate(sheets):
        path = targets[sheet.get(RID)].lstrip("/")
        rows = []
        for row in ET.fromstring(z.read(path if path.startswith("xl/") else f"xl/{path}")).iterfind("m:sheetData/m:row", NS):
            if max_rows is not None and int(row.get("r", 0)) > max_rows + 1:
                break
            cells: list[str] = []
            for c in row.findall("m:c", NS):
                k = _column(c.get("r")) if c.get("r") else len(cells)
                if k >= MAX_COLUMNS:
                    continue
                kind, v = c.get("t", "n"), c.find("m:v", NS)
                if kind == "inlineStr":
                    text = _texts(c)
                elif v is None or v.text is None:
                    text = ""
                elif kind == "s":
                    text = shared[int(v.text)]
                elif kind == "b":
                    text = "true" if v.text == "1" else "false"
                elif kind in ("str", "e"):
                    text = v.text
                else:
                    text = _number(v.text, styles[int(c.get("s", 0))])
                cells += [""] * (k - len(cells)) + [text.strip()]
            if any(cells):
                rows.append(cells)
        if rows:
            width = max(map(len, rows))
            rows = [r + [""] * (width - len(r)) for r in rows]
            out.append((sheet.get("name") or f"Sheet{at + 1}", rows[0], rows[1:]))
    if not out:
        raise ValueError("no rows")
    return out


def sheet_title(name: str, used: set[str]) -> str:
    """A title that workbooks allow and that no other sheet has in any case; `used` gets it."""
    base = re.sub(r"[\[\]*?/\\:]", "", name).strip()[:SHEET_TITLE] or "Sheet"
    title, n = base, 0
    while title.lower() in used:
        n += 1
        tail = f" ({n})"
        title = base[: SHEET_TITLE - len(tail)] + tail
    used.add(title.lower())
    return title


def file_stem(name: str) -> str:
    return re.sub(r"[^\w.\- ]+", "_", re.sub(r"\.[^.]*$", "", name)).strip() or "export"


def _letters(k: int) -> str:
    out, k = "", k + 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


def write_workbook(sheets: list[tuple[str, list[str], list[list[tuple[str, object, str]]]]]) -> bytes:
    """XLSX bytes. Cells are (kind, value, number format): number and date become real ones, text stays, blank is empty."""
    formats: dict[str, int] = {}
    bodies, titles, used = [], [], set()
    for name, columns, rows in sheets:
        titles.append(sheet_title(name, used))
        widths = [min(60, max(8, len(h) + 2)) for h in columns]
        lines = ['<row r="1">' + "".join(f'<c r="{_letters(k)}1" s="1" t="inlineStr"><is><t xml:space="preserve">{escape(h)}</t></is></c>' for k, h in enumerate(columns)) + "</row>"]
        for r, row in enumerate(rows, 2):
            cells = []
            for k, (kind, value, fmt) in enumerate(row):
                ref = f"{_letters(k)}{r}"
                if k < len(widths) and kind != "blank":
                    widths[k] = min(60, max(widths[k], len(str(value)) + 2))
                if kind == "number":
                    cells.append(f'<c r="{ref}" s="{formats.setdefault(fmt, len(formats)) + 2}"><v>{value}</v></c>')
                elif kind == "date":
                    cells.append(f'<c r="{ref}" s="{formats.setdefault("dd.mm.yyyy", len(formats)) + 2}"><v>{(value - EPOCH).days}</v></c>')
                elif kind == "text":
                    cells.append(f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>')
            lines.append(f'<row r="{r}">{"".join(cells)}</row>')
        cols = "".join(f'<col min="{k + 1}" max="{k + 1}" width="{w}" customWidth="1"/>' for k, w in enumerate(widths))
        pane = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
        bodies.append(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{NS["m"]}">{pane}{f"<cols>{cols}</cols>" if cols else ""}<sheetData>{"".join(lines)}</sheetData></worksheet>')
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    fmts = "".join(f'<numFmt numFmtId="{164 + k}" formatCode={quoteattr(f)}/>' for f, k in formats.items())
    xfs = '<xf numFmtId="0" fontId="0"/><xf numFmtId="0" fontId="1" applyFont="1"/>' + "".join(f'<xf numFmtId="{164 + k}" fontId="0" applyNumberFormat="1"/>' for k in formats.values())
    n = range(1, len(bodies) + 1)
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in n) + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="{pack}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{NS["m"]}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name={quoteattr(t)} sheetId="{k}" r:id="rId{k}"/>' for k, t in zip(n, titles, strict=True)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{pack}/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in n) + f'<Relationship Id="rId{len(bodies) + 1}" Type="{rel}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{NS["m"]}">' + (f'<numFmts count="{len(formats)}">{fmts}</numFmts>' if formats else "") + f"<fonts><font/><font><b/></font></fonts><fills><fill/></fills><borders><border/></borders><cellStyleXfs><xf/></cellStyleXfs><cellXfs>{xfs}</cellXfs></styleSheet>",
        **{f"xl/worksheets/sheet{k}.xml": b for k, b in zip(n, bodies, strict=True)},
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()
