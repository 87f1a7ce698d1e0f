"""Half-structured texts as tables: model replies, product pages, pasted lists, sitemaps."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemill.functions import figures
from tablemill.functions.barcodes import normalize_barcode
from tablemill.functions.headings import BARCODE_TERMS, ITEM_TERMS, LIST_BRAND_TERMS, LIST_PRICE_TERMS, normalize_heading, pattern
from tablemill.functions.text import blank, trim
from tablemill.functions.web import host, is_public_https
from tablemill.sources.limits import MAX_CHILD_SITEMAPS, MAX_LIST_CHARS, MAX_PRODUCTS

# --- model replies


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def load_json(text: str) -> object | None:
    """The value of a JSON text, None for one that is none; NaN and Infinity aren't JSON, deep nesting isn't read."""
    try:
        return json.loads(text, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return None


def extract_json(text: str) -> object | None:
    """The reply's JSON: the whole of it without a code fence, else from its first to its last brace."""
    plain = text.strip()
    if plain.startswith("```"):
        plain = re.sub(r"\n?```$", "", re.sub(r"^```[a-zA-Z0-9]*\n?", "", plain)).strip()
    whole = load_json(plain)
    return load_json(plain[plain.find("{") : plain.rfind("}") + 1]) if whole is None else whole


def _plain_number(value: float) -> str:
    """A float as JavaScript prints it: no point for whole ones, exponents from 1e21 on and below 1e-6."""
    if value in (float("inf"), float("-inf")):
        return "Infinity" if value > 0 else "-Infinity"
    if value == int(value) and abs(value) < 1e21:
        return str(int(value))
    shown = repr(value)
    if "e" in shown:
        digits, _, power = shown.partition("e")
        if -7 < int(power) < 0:
            return f"{value:.{len(digits.replace('.', '').lstrip('-')) - 1 - int(power)}f}"
        return f"{digits.removesuffix('.0')}e{int(power):+d}"
    return shown


def cell_text(value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, str):
        return value
    if isinstance(value, (int, float)):
        return _plain_number(value) if isinstance(value, float) or abs(value) < 2**53 else _plain_number(float(value)) if abs(value) < 10**308 else "Infinity" if value > 0 else "-Infinity"
    return _compact(value)


def _compact(value: object) -> str:
    """A list or object as JSON, numbers as cells print them and what is beyond them as null."""
    if isinstance(value, list):
        return "[" + ",".join(map(_compact, value)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_compact(v)}" for k, v in value.items()) + "}"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        shown = cell_text(value)
        return "null" if "Infinity" in shown else shown
    return json.dumps(value, ensure_ascii=False)


def reply_sheets(text: str) -> list[tuple[str, list[str], list[list[str]]]]:
    """(name, headings, rows) of a reply, padded to one width; text without tables is one column of its lines.

    What should be a list and isn't counts as none; entries that are no objects are passed over and don't number others.
    """
    data = extract_json(text)
    found = data.get("sheets") if isinstance(data, dict) else None
    if not isinstance(found, list) or not found:
        return [("Text", ["content"], [[x] for x in text.split("\n") if x.strip()])]
    listed = lambda x: x if isinstance(x, list) else []
    out = []
    for at, sheet in enumerate(found):
        if isinstance(sheet, list):
            sheet = {}
        if not isinstance(sheet, dict):
            continue
        columns = [cell_text(c) for c in listed(sheet.get("columns"))]
        rows = []
        for row in listed(sheet.get("rows")):
            if isinstance(row, list):
                rows.append([cell_text(v) for v in row])
            elif isinstance(row, dict):
                rows.append([cell_text(row.get(c)) for c in columns] if columns else [cell_text(v) for v in row.values()])
            else:
                rows.append([cell_text(row)])
        width = max([len(columns), *map(len, rows)], default=0)
        name = f"Sheet{at + 1}" if sheet.get("name") is None else cell_text(sheet["name"])
        out.append((name, columns + [""] * (width - len(columns)), [r + [""] * (width - len(r)) for r in rows]))
    return out or [("Text", ["content"], [])]


def read_replies(replies: DataFrame) -> DataFrame:
    """replies(doc_id, reply) as (doc_id, sheet_ord, name, columns, row_ord, cells).

    A sheet without rows gives one row with row_ord -1 and null cells, so that none is lost. A null reply is empty.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, k, name, columns, n, cells) for d, t in zip(b["doc_id"], b["reply"], strict=True) for k, (name, columns, body) in enumerate(reply_sheets(t or "")) for n, cells in (enumerate(body) if body else [(-1, None)])]
            yield pd.DataFrame(rows, columns=["doc_id", "sheet_ord", "name", "columns", "row_ord", "cells"])

    return replies.select(F.col("doc_id").cast("string").alias("doc_id"), "reply").mapInPandas(run, "doc_id string, sheet_ord int, name string, columns array<string>, row_ord int, cells array<string>")


# --- product pages

#: Fields that hold a code, best first; wrappers that hold products; fields that hold a price.
CODE_FIELDS = ["gtin13", "gtin14", "gtin12", "gtin8", "gtin", "ean", "barcode", "sku"]
CHILDREN = ["@graph", "graph", "mainEntity", "item", "itemListElement", "hasVariant"]
PRICE_FIELDS = ["price", "lowPrice", "highPrice"]
LD_BLOCK = r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
MAX_DEPTH, MAX_NODES, OFFER_DEPTH = 5, 200, 3


def ld_nodes(data: object) -> list[dict]:
    """Objects in the order they are met, a level counting for each wrapper and list, until there are over 200."""
    out, todo = [], [(data, 0)]
    while todo and len(out) <= MAX_NODES:
        value, depth = todo.pop()
        if depth > MAX_DEPTH:
            continue
        if isinstance(value, list):
            todo += [(v, depth + 1) for v in reversed(value)]
        elif isinstance(value, dict):
            out.append(value)
            todo += [(value[k], depth + 1) for k in reversed(CHILDREN) if value.get(k)]
    return out


def offer_price(offers: object, depth: int = 0) -> str | None:
    if depth > OFFER_DEPTH or not isinstance(offers, (dict, list)):
        return None
    if isinstance(offers, list):
        return next((p for o in offers if (p := offer_price(o, depth + 1)) is not None), None)
    for name in PRICE_FIELDS:
        if offers.get(name) is not None and cell_text(offers[name]).strip():
            return cell_text(offers[name])
    inner = offers.get("priceSpecification")
    return offer_price(offers.get("offers") if inner is None else inner, depth + 1)


def products(pages: DataFrame, source: str) -> DataFrame:
    """pages(url, html): the first named product with a code of 8 digits or more, as a catalog entry; others have none.

    Blocks are cut out natively; only pages that have one reach the workers, which walk the JSON and give every named
    node's candidate codes in order. Codes and prices are then read by the same expressions as everywhere.
    """
    blocks = pages.select("url", F.regexp_extract_all("html", F.lit(LD_BLOCK), F.lit(1)).alias("blocks"))
    blocks = blocks.where(F.size("blocks") > 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for url, texts in zip(b["url"], b["blocks"], strict=True):
                n = 0
                for text in texts:
                    for node in ld_nodes(load_json(text)):
                        name = node.get("name")
                        if not isinstance(name, str) or not name.strip():
                            continue
                        brand = node.get("brand")
                        brand = brand.get("name") if isinstance(brand, dict) else brand
                        brand = brand.strip() if isinstance(brand, str) and brand.strip() else None
                        codes = [cell_text(node[f]) for f in CODE_FIELDS if node.get(f) is not None]
                        rows.append((url, n, name.strip(), codes, offer_price(node.get("offers")), brand))
                        n += 1
            yield pd.DataFrame(rows, columns=["url", "at", "name", "codes", "price", "brand"])

    nodes = blocks.mapInPandas(run, "url string, at int, name string, codes array<string>, price string, brand string")
    read = F.filter(F.transform("codes", normalize_barcode), lambda d: d.isNotNull() & (F.length(d) >= 8))
    coded = nodes.withColumn("barcode", F.get(read, F.lit(0))).where("barcode is not null")
    first = coded.groupBy("url").agg(F.min_by(F.struct("barcode", "name", "price", "brand"), "at").alias("p"))
    return first.select("url", "p.barcode", "p.name", F.lit(source).alias("source"), figures.normalize_price("p.price").alias("price"), "p.brand")


# --- sitemaps

#: Paths of products, and words in addresses that aren't products.
PRODUCT_PATH = r"(?i)/(urun|product|products|pd)/"
NOT_PRODUCT = r"(?i)(categor|kategori|marka|brand|blog|page|sayfa|haber|collection)"


def locations(xml: Column) -> Column:
    return F.transform(F.regexp_extract_all(xml, F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))


def newest_workbook(html: Column, publisher: str) -> Column:
    """The first .xlsx link on the publisher's host, else the first one."""
    links = F.regexp_extract_all(html, F.lit(r'(?i)href="([^"]+\.xlsx)"'), F.lit(1))
    own = F.filter(links, lambda u: F.lower(u).contains(publisher))
    return F.replace(F.coalesce(F.get(own, F.lit(0)), F.get(links, F.lit(0))), F.lit("&amp;"), F.lit("&"))


#: Where a sitemap stands if robots.txt names none; marks of one; children that name products.
SITEMAP_PLACES = ["/sitemap.xml", "/sitemap/", "/sitemap_index.xml"]
SITEMAP = r"(?i)<(urlset|sitemapindex)"
SITEMAP_INDEX = r"(?i)<sitemapindex"
PRODUCT_CHILD = r"(?i)(product|urun)"


def sitemap_candidates(sites: DataFrame) -> DataFrame:
    """sites(site, robots) as (site, ord, url): what robots.txt names, in its order, then the usual places."""
    named = F.regexp_extract_all(F.coalesce("robots", F.lit("")), F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1))
    usual = F.transform(F.array(*map(F.lit, SITEMAP_PLACES)), lambda p: F.concat("site", p))
    return sites.select("site", F.posexplode(F.concat(named, usual)).alias("ord", "url"))


def find_sitemaps(sites: DataFrame, fetched: DataFrame) -> DataFrame:
    """(site, xml): each site's first candidate among fetched(url, body) that is a sitemap; a site without one has no row."""
    read = sitemap_candidates(sites).join(fetched.where(F.col("body").rlike(SITEMAP)).select("url", "body"), "url")
    return read.groupBy("site").agg(F.min_by("body", "ord").alias("xml"))


def expand_sitemaps(roots: DataFrame, fetched: DataFrame, children: int = MAX_CHILD_SITEMAPS) -> DataFrame:
    """roots(site, xml) as sitemaps(site, ord, xml): an index gives its first `children` maps, those that name products
    if there are any; a child that wasn't fetched is passed over. Other roots are themselves."""
    index = F.col("xml").rlike(SITEMAP_INDEX)
    named = roots.where(index).select("site", F.posexplode(locations(F.col("xml"))).alias("ord", "url"))
    named = named.withColumn("product", F.col("url").rlike(PRODUCT_CHILD) & ~F.col("url").rlike(NOT_PRODUCT))
    some = F.max("product").over(Window.partitionBy("site"))
    place = F.row_number().over(Window.partitionBy("site").orderBy("ord"))
    chosen = named.withColumn("some", some).where(F.col("product") | ~F.col("some")).withColumn("place", place).where(F.col("place") <= children)
    maps = chosen.join(fetched.select("url", "body"), "url").select("site", F.col("place").alias("ord"), F.col("body").alias("xml"))
    return maps.unionByName(roots.where(~index).select("site", F.lit(0).alias("ord"), "xml"))


def product_urls(sitemaps: DataFrame, limit: int = MAX_PRODUCTS) -> DataFrame:
    """sitemaps(site, ord, xml) as (site, url, n): a site's own product addresses in order, or all its own if none is one."""
    each = sitemaps.select("site", "ord", F.posexplode(locations(F.col("xml"))).alias("pos", "url"))
    own = each.where(host(F.col("url")) == host(F.col("site"))).withColumn("url", F.regexp_replace("url", "^(?i)http://", "https://")).where(is_public_https(F.col("url")))
    marked = own.withColumn("product", F.col("url").rlike(PRODUCT_PATH) & ~F.col("url").rlike(NOT_PRODUCT))
    some = marked.groupBy("site").agg(F.bool_or("product").alias("some"))
    chosen = marked.join(some, "site").where(F.col("product") | ~F.col("some"))
    n = F.row_number().over(Window.partitionBy("site").orderBy("ord", "pos"))
    return chosen.select("site", "url", n.alias("n")).where(F.col("n") <= limit)


# --- pasted lists


def split_commas(line: Column) -> Column:
    """Cells between commas outside quotes; a doubled quote inside quotes is one.

    One linear pass: between quotes, every second piece is inside; an empty piece outside, between two inside ones, was
    a doubled quote. Commas outside become cell ends before the pieces are joined again.
    """
    pieces = F.split(line, '"', -1)
    last = F.size(pieces) - 1

    def piece(x: Column, at: Column) -> Column:
        doubled = (x == "") & (at > 0) & (at < last)
        return F.when(at % 2 == 1, x).when(doubled, F.lit('"')).otherwise(F.replace(x, F.lit(","), F.lit("\u0001")))

    return F.split(F.array_join(F.transform(pieces, piece), ""), "\u0001", -1)


def split_line(line: Column) -> Column:
    """Cells of a pasted line: by tabs, else semicolons, else commas unless it is one figure, else wide gaps."""
    figure = trim(line).rlike(r"^[0-9][0-9\s]*,[0-9]{1,2}$")
    cut = F.when(line.contains("\t"), F.split(line, "\t")).when(line.contains(";"), F.split(line, ";")).when(line.contains(",") & ~figure, split_commas(line)).otherwise(F.split(line, r"\s{2,}"))
    return F.transform(cut, lambda c: F.regexp_replace(trim(c), '^"|"$', ""))


def _place(cells: Column, test, taken: list[Column]) -> Column:
    """The first cell, none of `taken`, whose normal form passes."""
    at = F.filter(F.transform(cells, lambda c, i: F.struct(i.alias("i"), test(normalize_heading(c)).alias("ok"))), lambda x: x["ok"] & ~F.array_contains(F.array(*taken), x["i"]) if taken else x["ok"])
    return F.coalesce(F.get(at, F.lit(0))["i"], F.lit(-1))


def parse_list(lines: DataFrame, source: str) -> DataFrame:
    """lines(list_id, n, line) as (list_id, n, barcode, name, price, brand, source, skipped), one row a line that counts.

    Blank lines and comments don't. The first line may be a heading, which then places the columns and gives no row.
    Without a heading the name is a line's longest text and the price its figure with most decimals.
    """
    kept = lines.withColumn("line", trim("line")).where((F.col("line") != "") & ~F.col("line").startswith("#")).withColumn("cells", split_line(F.col("line")))
    kept = kept.withColumn("codes", F.transform("cells", normalize_barcode))
    firsts = kept.groupBy("list_id").agg(F.min_by(F.struct("cells", "codes", "n"), "n").alias("f"))
    c = F.col("f.cells")
    word = lambda terms: lambda h: h.rlike(pattern(terms))
    barcode = _place(c, word(BARCODE_TERMS), [])
    heads = firsts.withColumn("b", barcode).withColumn("p", _place(c, word(LIST_PRICE_TERMS), [F.col("b")]))
    heads = heads.withColumn("r", _place(c, word(LIST_BRAND_TERMS), [F.col("b"), F.col("p")])).withColumn("m", _place(c, word(ITEM_TERMS), [F.col("b"), F.col("p"), F.col("r")]))
    ok = ~F.exists("f.codes", lambda d: d.isNotNull()) & (F.col("b") >= 0) & ((F.col("m") >= 0) | (F.col("p") >= 0))
    heads = heads.where(ok).select("list_id", F.col("f.n").alias("head"), "b", "p", "r", "m")
    # One small row a list.
    body = kept.join(heads, "list_id", "left").where(F.col("head").isNull() | (F.col("n") > F.col("head")))
    shaped = F.array_position(F.transform("codes", lambda d: d.isNotNull()), True).cast("int") - 1
    body = body.withColumn("named", F.col("b").isNotNull() & F.get("codes", F.col("b")).isNotNull()).withColumn("at", F.when(F.col("named"), F.col("b")).otherwise(shaped))

    def line(x: Column) -> Column:
        """struct(name, price) by the cells alone."""
        others = F.filter(x, lambda y: (y["i"] != F.col("at")) & (y["c"] != ""))
        size = lambda y: F.struct(F.length(y["c"]).alias("n"), (-y["i"]).alias("i"), y["c"].alias("c"))
        texts = F.array_max(F.transform(F.filter(others, lambda y: y["places"].isNull()), size))["c"]
        longest = F.array_max(F.transform(others, size))["c"]
        prices = F.array_max(F.transform(F.filter(others, lambda y: y["places"] > 0), lambda y: F.struct(y["places"].alias("n"), y["i"].alias("i"), y["c"].alias("c"))))["c"]
        return F.struct(F.coalesce(texts, longest).alias("name"), F.when(texts.isNotNull(), prices).alias("price"))

    cell = lambda k: F.when(F.col(k) >= 0, F.get("cells", F.col(k)))
    indexed = lambda cells: F.transform(cells, lambda v, i: F.struct(i.alias("i"), v.alias("c"), figures.read(v)["places"].alias("places")))
    priceless = F.transform("cells", lambda v, i: F.when(i == F.col("p"), "").otherwise(v))
    body = body.withColumn("free", line(indexed(F.col("cells")))).withColumn("nameless", line(indexed(priceless)))
    name = F.when(F.col("named"), F.when(F.col("m") >= 0, cell("m")).otherwise(F.col("nameless.name"))).otherwise(F.col("free.name"))
    price = F.when(F.col("named"), cell("p")).otherwise(F.col("free.price"))
    brand = F.when(F.col("named"), trim(cell("r")))
    out = body.select("list_id", "n", F.get("cells", F.col("at")).alias("barcode"), trim(name).alias("name"), figures.normalize_price(price).alias("price"), F.when(brand != "", brand).alias("brand"), F.lit(source).alias("source"))
    return out.withColumn("skipped", F.col("barcode").isNull() | blank("name"))


def append_list(old: str, new: str, limit: int = MAX_LIST_CHARS) -> str:
    """A pasted list with another put after it, cut at `limit` characters as the reader's limit says."""
    return (f"{old.rstrip()}\n{new}" if old.strip() else new)[:limit]

