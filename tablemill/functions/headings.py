"""Turkish and English column headings, mapped to stable identities."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablemill.functions.text import let, trim

#: Endings that any word of a heading may carry.
SUFFIX = "(?:leri|lari|ler|lar|nin|nun|si|su|in|un|i|u|s)?"
#: Identities, their labels, and the terms that name them, plainest first.
BARCODE_TERMS = ["barkod", "barcode", "karekod", "gtin", "ean", "upc"]
CODE_TERMS = ["malzeme kod", "urun kod", "stok kod", "mal kod", "reference", "code", "sku", "kod", "ref"]
ITEM_TERMS = [
    "mal hizmet cins", "mal hizmet", "malzeme ad", "urun ad", "urun ism", "urun cins", "esya ad", "esya cins", "mal ad", "mal cins",
    "emtia cins", "emtia", "stok ad", "ilac ad", "ticari ad", "preparat ad", "mustahzar ad", "product name", "product description",
    "item name", "item description", "goods", "article", "malzeme", "product", "urun", "hizmet", "mal", "name", "item", "cins", "aciklama", "description",
]
QUANTITY_TERMS = ["miktar", "adet", "aded", "quantity", "qty"]
UNIT_TERMS = ["olcu birim", "birim", "unit", "olcu"]
UNIT_PRICE_TERMS = ["birim fiyat", "bir fiyat", "br fiyat", "b fiyat", "unit price", "fiyat", "price"]
DISCOUNT_TERMS = ["iskonto", "indirim", "discount"]
VAT_TERMS = ["kdv", "vat", "tax", "vergi"]
AMOUNT_TERMS = ["mal hizmet tutar", "genel toplam", "ara toplam", "net tutar", "line total", "toplam", "amount", "tutar", "total"]
DATE_TERMS = ["tarih", "date"]
SYNONYMS = [
    ("barcode", "Barcode", BARCODE_TERMS, False),
    ("code", "Code", CODE_TERMS, False),
    ("item", "Item", ITEM_TERMS, False),
    ("quantity", "Quantity", QUANTITY_TERMS, False),
    ("unit", "Unit", UNIT_TERMS, True),
    ("unit_price", "Unit price", UNIT_PRICE_TERMS, False),
    ("discount", "Discount", DISCOUNT_TERMS, False),
    ("vat", "VAT", VAT_TERMS, False),
    ("amount", "Amount", AMOUNT_TERMS, False),
    ("date", "Date", DATE_TERMS, False),
]
#: Further headings of pasted lists and of registries.
LIST_PRICE_TERMS = ["etiket fiyat", "satis fiyat", "perakende", "liste fiyat", "birim fiyat", "urun fiyat", "kdv dahil", "fiyat", "price", "psf", "ptf"]
LIST_BRAND_TERMS = ["firma", "marka", "uretici", "imalatci", "brand", "manufacturer"]
REGISTRY_TERMS = {
    "barcode": ["barkod", "gtin", "ean"],
    "name": ["ilac ad", "urun ad", "ticari ad", "urun ism"],
    "firm": ["ruhsat sahibi", "firma ad", "firma", "uretici"],
    "atc": ["atc kod", "atc ad", "atc"],
}


def pattern(terms: list[str], exact: bool = False) -> str:
    """Matches a heading in normal form that begins with one of the terms, whose words may all be inflected."""
    spelled = "|".join(rf"{SUFFIX}\s+".join(t.split(" ")) for t in terms)
    return f"^(?:{spelled}){SUFFIX}" + ("$" if exact else r"\b")


def _plain_letters() -> tuple[str, str, str]:
    """Letters whose decomposition begins with an ASCII letter or digit, those, and the combining marks to drop."""
    fancy, plain = "", ""
    for k in range(128, min(sys.maxunicode, 0xFFFF) + 1):
        c = chr(k)
        d = unicodedata.normalize("NFD", c)
        rest = [x for x in d[1:] if not 0x300 <= ord(x) <= 0x36F]
        if d != c and d[0].isascii() and d[0].isalnum() and not rest:
            fancy, plain = fancy + c, plain + d[0]
    return fancy, plain, "".join(map(chr, range(0x300, 0x370)))


FANCY, PLAIN, MARKS = _plain_letters()


def normalize_heading(c: Column) -> Column:
    """Lower case, without accents and punctuation."""
    dotted = F.translate(c, "ıİ", "ii")
    return F.trim(F.regexp_replace(F.lower(F.translate(dotted, FANCY + MARKS, PLAIN)), "[^a-z0-9]+", " "))


def normalize_heading_text(text: str) -> str:
    """The same for one heading on the driver or in a worker."""
    import re

    t = unicodedata.normalize("NFD", text.replace("ı", "i").replace("İ", "i"))
    return re.sub("[^a-z0-9]+", " ", "".join(x for x in t if not 0x300 <= ord(x) <= 0x36F).lower()).strip()


def identify(heading: Column) -> Column:
    """struct(key, label, rank, norm): the identity of the longest match, the first in the table on a tie."""

    def found(n: Column) -> Column:
        hits = []
        for at, (key, label, terms, exact) in enumerate(SYNONYMS):
            rank = F.lit(len(terms))
            for k in range(len(terms) - 1, -1, -1):
                rank = F.when(n.rlike(pattern([terms[k]], exact)), k).otherwise(rank)
            size = F.length(F.regexp_extract(n, pattern(terms, exact), 0))
            hits.append(F.when(size > 0, F.struct(size.alias("size"), F.lit(-at).alias("at"), F.lit(key).alias("key"), F.lit(label).alias("label"), rank.alias("rank"))))
        best = F.array_max(F.array_compact(F.array(*hits)))
        blank = F.struct(F.lit("__blank").alias("key"), heading.alias("label"), F.lit(0).alias("rank"), n.alias("norm"))
        own = F.struct(n.alias("key"), trim(heading).alias("label"), F.lit(0).alias("rank"), n.alias("norm"))
        named = let(best, lambda b: F.when(b.isNull(), own).otherwise(F.struct(b["key"].alias("key"), b["label"].alias("label"), b["rank"].alias("rank"), n.alias("norm"))))
        return F.when(n == "", blank).otherwise(named)

    return let(normalize_heading(heading), found)


