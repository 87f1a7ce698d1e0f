"""Barcodes: reading digits with repair of misread letters, check digits, and the forms under which a code is found."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablemill.functions.text import col, let, trim

#: Letters that a reader mistakes for digits, and those digits.
CONFUSED = "OoDQIli|!ZzASsGbTBgq"
MEANT = "00001111122455667899"
MISREAD_SHARE = 0.25
LETTERS = "A-Za-z|!"


def read_digits(text: Column) -> Column:
    """Digits of the tokens that have one; in a token with few letters those are read as the digits they look like."""

    def token(t: Column) -> Column:
        letters = F.length(F.regexp_replace(t, "[0-9]", ""))
        mended = F.regexp_replace(F.translate(t, CONFUSED, MEANT), "[^0-9]", "")
        return F.when(letters / F.length(t) <= MISREAD_SHARE, mended).otherwise(F.regexp_replace(t, "[^0-9]", ""))

    tokens = F.filter(F.split(text, f"[^0-9{LETTERS}]+"), lambda t: t.rlike("[0-9]"))
    return F.array_join(F.transform(tokens, token), "")


def normalize_barcode(raw: Column | str) -> Column:
    """6 to 14 digits, or null. A cell of digits alone needs no reading, one without any has none."""
    cut = F.regexp_replace(trim(raw), "[.,]0+$", "")
    plain = lambda s: F.when(F.length(s).between(6, 14), s)
    read = let(cut, lambda s: F.when((s != "") & ~s.rlike("[.,][0-9]*[1-9]"), let(read_digits(s), plain)))
    c = col(raw)
    return F.when(c.rlike(r"^[0-9]+\z"), plain(c)).when(c.rlike("[0-9]"), read)


def check_digit(body: Column) -> Column:
    """The last digit of a code whose other digits are `body`."""
    padded = F.lpad(body, 13, "0")
    total = sum((F.substring(padded, k + 1, 1).cast("int") * (3 if k % 2 == 0 else 1) for k in range(13)), F.lit(0))
    return ((10 - total % 10) % 10).cast("string")


def valid_check_digit(digits: Column | str) -> Column:
    d = col(digits)
    well = d.rlike("^[0-9]+$") & F.length(d).isin(8, 12, 13, 14)
    body = d.substr(F.lit(1), F.length(d) - 1)
    return F.coalesce(F.when(well, check_digit(body) == F.substring(d, -1, 1)), F.lit(False))


def repair_barcode(cell: Column | str) -> Column:
    """The cell, or the digits that its letters stand for if the check digit proves them."""
    c = col(cell)
    plain = F.regexp_replace(c, "[^0-9]", "")
    return let(normalize_barcode(c), lambda d: F.when(c.rlike(f"[{LETTERS}]") & d.isNotNull() & (d != plain) & valid_check_digit(d), d).otherwise(c))


def bare_code(digits: Column | str) -> Column:
    """Without leading zeros; all zeros are one."""
    return let(F.regexp_replace(col(digits), "^0+", ""), lambda b: F.when(b == "", "0").otherwise(b))


def barcode_keys(digits: Column | str) -> Column:
    """The forms under which a code may be printed, the given one first."""
    d = col(digits)

    def forms(b: Column) -> Column:
        longer = [F.when(F.length(b) < n, F.lpad(b, n, "0")) for n in (13, 14)]
        return F.array_compact(F.array_distinct(F.array(d, b, *longer)))

    return let(bare_code(d), forms)
