"""Column profiles, filling, layouts, reading folders and streams."""

import pytest
from pyspark.sql import functions as F

from tablemill.operators import catalog, profile, reconcile, sinks, stack
from tablemill.sources.files import read_folder
from tablemill.streaming.drop_folder import watch

ROWS = "doc_id string, sheet_ord int, row_ord int, cells array<string>"
SHEETS = "doc_id string, sheet_ord int, name string, columns array<string>"


def carrier(spark, columns, rows):
    return spark.createDataFrame([("d", 0, i, r) for i, r in enumerate(rows)], ROWS), spark.createDataFrame([("d", 0, "S", columns)], SHEETS)


def test_profile_of_a_messy_column(spark):
    cells = ["", "iade", "1,50", "2,50", "3,50", "4,50", "5,50", "6,50"]
    rows, _ = carrier(spark, ["Ürün", "Fiyat"], [[f"0{i}x", c] for i, c in enumerate(cells)])
    found = {r["col_ord"]: r for r in profile.profile(rows).collect()}
    assert (found[1]["kind"], found[1]["mark"], found[1]["places"], found[1]["filled"]) == ("number", ",", 2, 7)
    assert found[0]["kind"] == "text"


def test_barcode_column_by_shape_and_by_heading(spark):
    rows, sheets = carrier(spark, ["x", "y"], [["1", "8697742122934"], ["2", "8697742122934"]])
    assert profile.barcode_columns(sheets, profile.profile(rows)).first()["barcode_col"] == 1
    rows, sheets = carrier(spark, ["Barkod", "y"], [["1", "8697742122934"]])
    assert profile.barcode_columns(sheets, profile.profile(rows)).first()["barcode_col"] == 0


def test_empty_tables(spark):
    rows, sheets = carrier(spark, ["a"], [])
    assert profile.profile(rows).count() == 0
    assert profile.barcode_columns(sheets, profile.profile(rows)).first()["barcode_col"] == -1
    assert reconcile.reconcile(rows, sheets).count() == 0
    assert sinks.csv_files(rows, sheets).first()["content"] == "﻿a"
    assert stack.primary_sheets(rows, sheets).first()["primary"] == -1


def test_reconcile_gap(spark):
    rows = spark.createDataFrame([("d", 0, 0, ["a", "60,00"]), ("d", 0, 1, ["b", "40,00"]), ("d", 1, 0, ["Toplam", "110,00"])], ROWS)
    sheets = spark.createDataFrame([("d", 0, "S", ["x", "Tutar"]), ("d", 1, "T", ["", ""])], SHEETS)
    r = reconcile.reconcile(rows, sheets).first()
    assert (r["ok"], float(r["total"]), float(r["stated"]), float(r["delta"])) == (False, 100.0, 110.0, -10.0)


def test_labels_layout_and_moves():
    assert catalog.distinct_label("Ürün Adı", ["urun adi", "Ürün Adı (2)"]) == "Ürün Adı (3)"
    assert stack.layout([("a", "A"), ("b", "B"), ("c", "C")], {"c": {"order": 0}, "b": {"include": False}, "a": {"label": "Z"}}) == [("c", "C"), ("a", "Z")]
    assert stack.moved(["a", "b"], "b", -1, {}) == {"b": {"order": 0}, "a": {"order": 1}}


def test_lookup_prefers_the_printed_form(spark):
    entry = "barcode string, name string, source string, price string, brand string, note string, priority int, ordinal int"
    known = spark.createDataFrame([("012345678905", "twelve", "a", "1", None, None, 0, 0), ("12345678905", "eleven", "b", None, None, None, 1, 0), ("x", "bad", "b", None, None, None, 1, 1)], entry)
    codes = spark.createDataFrame([("012345678905",), ("12345678905",), ("00012345678905",), ("99999999",), (None,)], "digits string")
    got = {r["digits"]: r["hit"] and (r["hit"]["name"], r["hit"]["price"]) for r in catalog.lookup(codes, known).collect()}
    assert got == {"012345678905": ("twelve", "1.00"), "12345678905": ("eleven", "1.00"), "00012345678905": ("eleven", "1.00"), "99999999": None, None: None}


def test_folder_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("Barkod;Adet\n8697742122934;2\n")
    (tmp_path / "in" / "b.xlsx").write_bytes(b"not a workbook")
    rows = {r["doc_id"].rsplit("/", 1)[-1]: r for r in read_folder(spark, str(tmp_path / "in")).collect()}
    assert rows["a.csv"]["cells"] == ["8697742122934", "2"] and rows["b.xlsx"]["error"]
    seen = []
    watch(spark, str(tmp_path / "in"), str(tmp_path / "ck"), lambda df, batch: seen.extend(df.where(F.col("error").isNull()).collect())).awaitTermination()
    assert [r["cells"] for r in seen] == [["8697742122934", "2"]]


@pytest.mark.parametrize("cell, want", [("=A1", "'=A1"), ("+340,50", "+340,50"), ("-x", "-x"), ("@x", "'@x"), ("plain", "plain")])
def test_formula_guard(spark, cell, want):
    got = spark.range(1).select(sinks.guard(F.lit(cell)).alias("g"), sinks.unguard(sinks.guard(F.lit(cell))).alias("u")).first()
    assert (got["g"], got["u"]) == (want, cell)


def test_headings_that_rival_for_one_identity(spark):
    headings = {"a.pdf": ["Barkod", "Açıklama", "Ürün Adı", "Adet"], "b.pdf": ["Barkod", "Ürün Adı", "Açıklama", "Adet"], "d.pdf": ["Barkod", "Description"], "e.pdf": ["Ürün Adı", "Eşya Cinsi", "Açıklama"]}
    keys = {"a.pdf": ["barcode", "item:aciklama", "item", "quantity"], "b.pdf": ["barcode", "item", "item:aciklama", "quantity"], "d.pdf": ["barcode", "item"], "e.pdf": ["item", "item:esya cinsi", "item:aciklama"]}
    rows = [(d, k, i, h) for k, (d, hs) in enumerate(headings.items()) for i, h in enumerate(hs)]
    named = stack.resolve_headings(spark.createDataFrame(rows, "doc_id string, doc_ord int, col_ord int, heading string"), ["doc_id"])
    got = {(r["doc_id"], r["col_ord"]): r["key"] for r in named.select("doc_id", "col_ord", "key").collect()}
    assert got == {(d, i): k for d, ks in keys.items() for i, k in enumerate(ks)}
    assert [r["label"] for r in stack.discover(stack.resolve_headings(spark.createDataFrame(rows, "doc_id string, doc_ord int, col_ord int, heading string"), ["doc_id", "doc_ord"])).orderBy("ord").collect()] == ["Source", "Barcode", "Açıklama", "Item", "Quantity", "Eşya Cinsi"]


def test_turkish_order(spark):
    names = ["çam", "cam", "ılık", "ilik", "İyi", "zar", "şan", "sar", "Öz", "on", "Ufuk", "ürün"]
    got = catalog.by_turkish_name(spark.createDataFrame([(n, str(k)) for k, n in enumerate(names)], "name string, barcode string")).collect()
    assert [r["name"] for r in got] == ["cam", "çam", "ılık", "ilik", "İyi", "on", "Öz", "sar", "şan", "Ufuk", "ürün", "zar"]


def test_replies_that_readers_must_survive():
    from tablemill.sources.documents import cell_text, ld_nodes, load_json, reply_sheets

    assert reply_sheets("a\x0cb\u2028c\n\nd") == [("Text", ["content"], [["a\x0cb\u2028c"], ["d"]])]
    assert reply_sheets("[" * 100_000)[0][0] == "Text" and load_json("[" * 100_000) is None and load_json("NaN") is None
    assert reply_sheets('{"sheets": [1, {"name": "b"}, null]}') == [("b", [], [])] and reply_sheets('{"sheets": [3]}') == [("Text", ["content"], [])]
    assert [cell_text(x) for x in (1e21, 1e-7, 0.00001, 1.5, -2.0, 10**20, 2**70, float("inf"), [1.0, None, {"a": True}])] == ["1e+21", "1e-7", "0.00001", "1.5", "-2", "100000000000000000000", "1.1805916207174113e+21", "Infinity", '[1,null,{"a":true}]']
    assert ld_nodes(None) == []


def test_comma_lines(spark):
    from tablemill.sources.documents import split_commas

    lines = {'a,"b,c",d': ["a", "b,c", "d"], '"x ""y"", z",2': ['x "y", z', "2"], "": [""], ",": ["", ""], '"",a': ["", "a"], ",".join(['"a,b"'] * 20_000): ["a,b"] * 20_000}
    got = spark.createDataFrame([(x,) for x in lines], "line string").select("line", split_commas(F.col("line")).alias("cells")).collect()
    assert {r["line"]: r["cells"] for r in got} == lines


def test_unreadable_files_are_not_lost(spark):
    from tablemill.sources.files import has_text_layer, read_sheets
    import zlib

    files = spark.createDataFrame([("a.xlsx", bytearray(b"PK\x03\x04" + b"x" * 60)), ("b.csv", bytearray(b"")), ("c.csv", bytearray(b"a;b\n1;2"))], "path string, content binary")
    got = {r["doc_id"]: r["error"] for r in read_sheets(files).collect()}
    assert got["a.xlsx"] and got["b.csv"] and got["c.csv"] is None
    body = b"BT (" + b"x" * 300 + b") Tj ET"
    pdf = lambda data, how: b"%PDF\n<< " + how + b" >>\nstream\n" + data + b"\nendstream"
    packer = zlib.compressobj(wbits=-15)
    assert has_text_layer(pdf(zlib.compress(body), b"/Filter /FlateDecode")) and has_text_layer(pdf(packer.compress(body) + packer.flush(), b"/Filter /FlateDecode"))
    assert has_text_layer(pdf(b"x" * 400, b"/Subtype /Image /Filter /DCTDecode")) is None and has_text_layer(pdf(body[:100] + b") Tj ET", b"")) is None
