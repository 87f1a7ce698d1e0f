"""Golden vectors of the scalar functions, and round trips."""

from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablemill.functions import barcodes, figures, headings, text
from tablemill.sources.delimited import parse_delimited, sniff
from tablemill.sources.documents import extract_json, ld_nodes, offer_price, reply_sheets
from tablemill.sources.files import has_text_layer
from tablemill.sources.workbook import format_places, sheet_title


def over(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", expr(F.col("v")).alias("x")).collect()
    return [r["x"] for r in sorted(rows, key=lambda r: r["i"])]


NUMBERS = {
    ",": [("837,338 TL", "837.338"), ("1.088,9005 TL", "1088.9005"), ("1,234.56", None), ("1,2,3", None), ("4200", "4200"), ("1.234.567,89", "1234567.89"), ("₺340,50", "340.5"), ("%10", "10"), ("-370,162", "-370.162"), ("(1.234,50)", "-1234.5"), ("24.07.2026", None)],
    ".": [("1.234,56", None), ("1,234,567.89", "1234567.89"), ("4200", "4200")],
    None: [("1,250", "1250"), ("1.250", "1250"), ("340,50", "340.5"), ("1.234.567", "1234567"), ("24.07.2026", None), ("711,5625", None), ("100TL", None), ("", None), (" 12 ", "12"), (None, None), ("abc", None)],
}


@pytest.mark.parametrize("mark", NUMBERS)
def test_numbers(spark, mark):
    got = over(spark, [v for v, _ in NUMBERS[mark]], lambda c: figures.parse_number(c, mark))
    assert got == [None if w is None else Decimal(w) for _, w in NUMBERS[mark]]


def test_mark_votes(spark):
    cases = [("1.234,56", ","), ("1,234.56", "."), ("711,5625", ","), ("340,50", ","), ("340.50", "."), ("1.234.567", ","), ("1,234,567", "."), ("1.250", None), ("12", None)]
    assert over(spark, [v for v, _ in cases], figures.mark_vote) == [w for _, w in cases]


def test_dates(spark):
    cases = [("24/07/2026", "2026-07-24"), ("07/24/2026", "2026-07-24"), ("05/08/2026", None), ("31.02.2026", None), ("1-2.2026", "2026-02-01"), ("2026-7-4", "2026-07-04"), ("x", None), (None, None)]
    assert [None if d is None else str(d) for d in over(spark, [v for v, _ in cases], figures.parse_date)] == [w for _, w in cases]


def test_prices(spark):
    assert over(spark, ["1.299,90 TL", "349", "0", "abc", None], figures.normalize_price) == ["1299.90", "349.00", None, None, None]


def test_barcodes(spark):
    cases = [("869 774 212 2934", "8697742122934"), ("8697742122934.0", "8697742122934"), ("'8697742122934", "8697742122934"), ("B69774212293A", "8697742122934"), ("B12", None), ("129,50", None), ("12345", None), (None, None)]
    assert over(spark, [v for v, _ in cases], barcodes.normalize_barcode) == [w for _, w in cases]
    assert over(spark, ["8697742122934", "8697742122935", "12", None], barcodes.valid_check_digit) == [True, False, False, False]
    assert over(spark, ["012345678905"], barcodes.barcode_keys) == [["012345678905", "12345678905", "0012345678905", "00012345678905"]]


def test_headings_agree_with_the_driver(spark):
    texts = ["Ürün Adı", "İLAÇ ADI", "Mal/Hizmet  Cinsi", "ŞIĞ", "crème brûlée", "日本", "%"]
    assert over(spark, texts, headings.normalize_heading) == [headings.normalize_heading_text(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\r\x00﻿", exclude_categories=["Cs", "Zs", "Zl", "Zp", "Cc"]), max_size=8), min_size=3, max_size=3), min_size=2, max_size=6))
def test_delimited_round_trip(rows):
    rows = [[c.lstrip("'") or "x" for c in r] for r in rows]
    text = "\r\n".join(";".join('"' + c.replace('"', '""') + '"' for c in r) for r in rows)
    head, body = parse_delimited("﻿" + text + "\r\n")
    assert [head, *body] == [[c.strip() for c in r] for r in rows]


def test_delimited_details():
    assert sniff("a;b,c\n") == ";" and sniff("a") == "," and sniff('"a;b;c",d') == ","
    assert parse_delimited("h;k\n;;\n\nx;'=1\n") == (["h", "k", ""], [["", "", ""], ["x", "=1", ""]])
    assert parse_delimited('a,b"x, y"z\n1,2') == (["a", "bx, yz"], [["1", "2"]])
    with pytest.raises(ValueError):
        parse_delimited("\n\n")


def test_replies():
    assert reply_sheets("a\n\nb") == [("Text", ["content"], [["a"], ["b"]])]
    assert reply_sheets('{"sheets":[{"columns":["a","b"],"rows":[{"b":1,"a":null},[true],"x"]}]}') == [("Sheet1", ["a", "b"], [["", "1"], ["TRUE", ""], ["x", ""]])]
    assert extract_json("no") is None


def test_product_walk():
    assert [n.get("n") for n in ld_nodes({"n": 1, "@graph": [{"n": 2, "item": {"n": 3}}], "item": {"n": 4}})] == [1, 2, 3, 4]
    assert offer_price([{"price": " "}, {"priceSpecification": {"price": 5}}]) == "5" and offer_price(None) is None


def test_small_helpers():
    used = set()
    assert [sheet_title(t, used) for t in ("A/B", "ab", "AB", "")] == ["AB", "ab (1)", "AB (2)", "Sheet"]
    assert format_places('0.00" TL"') == 2 and format_places("#,000") == 3 and format_places("0") is None
    assert has_text_layer(b"%PDF /Encrypt") is None and has_text_layer(b"%PDF") is None


def test_readings_of_a_profile_are_the_readings_of_a_cell(spark):
    cells = ["", "x", "12", "1.234,56", "1,234.56", "1.234.567", "1,5", "1.", "1,", "1.234", "12.34.5", "(1.200,50)", "-3,5 TL", "$ 1,000", "%12", "1'000", "١٢", "12 34", "1,2.3,4", "0.001234567", "9" * 40, "1..2", "1.,2", " 7　", "\n8\n"]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cells)], "k int, raw string").withColumn("skip", F.lit(False)).withColumn("raw", text.trim("raw"))
    marks = {"dot": ".", "comma": ",", "cell": None}
    got = figures.with_readings(df, "raw", marks, "vote", skip="skip").select("k", *marks, "vote")
    want = df.select("k", *(figures.read("raw", m).alias(n) for n, m in marks.items()), figures.mark_vote("raw").alias("vote"))
    assert {r["k"]: r for r in got.collect()} == {r["k"]: r for r in want.collect()}
    by = {cells[r["k"]]: r for r in want.collect()}
    assert [by[c]["vote"] for c in ("1.234,56", "1,234.56", "1.234.567", "1,5", "1.", "1.234", "12", "x")] == [",", ".", ",", ",", None, None, None, None]
    assert by["(1.200,50)"]["comma"]["value"] == Decimal("-1200.5") and by["1'000"]["cell"]["value"] == 1000 and by["x"]["cell"] is None


def test_codes_of_digits_alone(spark):
    cells = ["12345", "123456", "12345678901234", "123456789012345", "12345678\n", " 12345678 ", "12345678.00", "abc", "", None, "I2345678"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = [r[0] for r in df.select(barcodes.normalize_barcode("c")).collect()]
    assert got == [None, "123456", "12345678901234", None, "12345678", "12345678", "12345678", None, None, None, "12345678"]
