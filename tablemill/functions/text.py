"""Text expressions shared by the parsers: white space, let-bindings, plain replacements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that ECMAScript's trim() and \s take as white space.
SPACE = r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: ASCII word boundaries: Java's \b would count Turkish letters as part of the word.
START, END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once a row."""
    return F.transform(F.array(value), body)[0]


def trim(c: Column | str) -> Column:
    """Without white space at both ends; what begins and ends with a printable ASCII character has none."""
    t = col(c)
    ends = [t.substr(1, 1), F.right(t, F.lit(1))]
    return F.when(ends[0].between("!", "~") & ends[1].between("!", "~"), t).otherwise(F.regexp_replace(t, f"^{SPACE}+|{SPACE}+$", ""))


def blank(c: Column | str) -> Column:
    return trim(F.coalesce(col(c), F.lit(""))) == ""


def escape_html(c: Column | str) -> Column:
    return F.replace(F.replace(F.replace(col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
