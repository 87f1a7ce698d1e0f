"""The engine's queries over the driver's tables, and SQL that gives the same rows from the same tables.

A query prints a table's values as documents print them and reads them back with the engine's operators; the SQL works
the expected values out directly, so the two ways are independent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablemill.functions import barcodes, figures, headings, web
from tablemill.operators import catalog, profile, reconcile, sinks, stack
from tablemill.sources import documents, files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def printed_tr(c: Column, tail: str = "") -> Column:
    return F.concat(F.translate(F.format_number(c, 2), ",.", ".,"), F.lit(tail))


def printed_en(c: Column, head: str = "") -> Column:
    return F.concat(F.lit(head), F.format_number(c, 2))


def cents(c: Column) -> Column:
    return (c * 100).cast("bigint")


def sheet(spark: SparkSession, docs: DataFrame, columns: list[str], name: str = "Sheet1") -> DataFrame:
    return docs.select("doc_id", F.lit(0).alias("sheet_ord"), F.lit(name).alias("name"), F.array(*map(F.lit, columns)).alias("columns"))


# --- figures, dates, amounts


@query("SELECT l_returnflag, count(*) AS n, sum(cast(round(l_extendedprice * 100) AS bigint))::bigint AS cents FROM lineitem GROUP BY 1")
def parse_figures_tr(spark, sf_dir):
    read = table(spark, sf_dir, "lineitem").select("l_returnflag", figures.parse_number(printed_tr(F.col("l_extendedprice"), " TL"), ",").alias("v"))
    return read.groupBy("l_returnflag").agg(F.count("v").alias("n"), F.sum(cents(F.col("v"))).alias("cents"))


@query("SELECT o_orderstatus, count(*) AS n, sum(cast(round(o_totalprice * 100) AS bigint))::bigint AS cents FROM orders GROUP BY 1")
def parse_figures_en(spark, sf_dir):
    read = table(spark, sf_dir, "orders").select("o_orderstatus", figures.parse_number(printed_en(F.col("o_totalprice"), "$")).alias("v"))
    return read.groupBy("o_orderstatus").agg(F.count("v").alias("n"), F.sum(cents(F.col("v"))).alias("cents"))


@query("SELECT c_mktsegment, count(*) AS n, sum(cast(round(c_acctbal * 100) AS bigint))::bigint AS cents FROM customer GROUP BY 1")
def parse_signed(spark, sf_dir):
    size = printed_tr(F.abs("c_acctbal"))
    text = F.when(F.col("c_acctbal") >= 0, size).when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("("), size, F.lit(")"))).otherwise(F.concat(F.lit("-"), size, F.lit(" ₺")))
    read = table(spark, sf_dir, "customer").select("c_mktsegment", figures.parse_number(text, ",").alias("v"))
    return read.groupBy("c_mktsegment").agg(F.count("v").alias("n"), F.sum(cents(F.col("v"))).alias("cents"))


@query("SELECT p_partkey, replace(cast(cast(p_retailprice AS decimal(18,2)) AS varchar), '.', ',') AS shown, '0.00' AS format, 2::int AS places FROM part")
def print_prices(spark, sf_dir):
    read = table(spark, sf_dir, "part").select("p_partkey", figures.read(printed_tr(F.col("p_retailprice")), ",").alias("x"))
    return read.select("p_partkey", figures.print_figure(F.col("x.value"), F.col("x.places"), ",").alias("shown"), figures.number_format(F.col("x.places")).alias("format"), F.col("x.places").alias("places"))


@query(
    "SELECT cast(month(o_orderdate) AS int) AS m, count(*) AS n, "
    "count(*) FILTER (WHERE o_orderkey % 4 < 3 OR day(o_orderdate) > 12) AS n_read, "
    "sum(CASE WHEN o_orderkey % 4 < 3 OR day(o_orderdate) > 12 THEN day(o_orderdate) END)::bigint AS days FROM orders GROUP BY 1"
)
def parse_dates(spark, sf_dir):
    d = F.col("o_orderdate")
    slash = F.when(F.col("o_orderkey") % 8 == 3, F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "MM/dd/yyyy"))
    way = F.col("o_orderkey") % 4
    text = F.when(way == 0, F.date_format(d, "yyyy-MM-dd")).when(way == 1, F.date_format(d, "d.M.yyyy")).when(way == 2, F.date_format(d, "dd-MM-yyyy")).otherwise(slash)
    read = table(spark, sf_dir, "orders").select(F.month(d).alias("m"), figures.parse_date(text).alias("v"))
    return read.groupBy("m").agg(F.count("*").alias("n"), F.count("v").alias("n_read"), F.sum(F.day("v")).alias("days"))


@query(
    "SELECT s_suppkey, CASE WHEN s_acctbal <= 0 THEN '$0' WHEN s_acctbal / 1000000 < 0.01 THEN '$' || cast(cast(cast(s_acctbal AS decimal(18,2)) / 1000000 AS decimal(18,4)) AS varchar) "
    "ELSE '$' || cast(cast(cast(s_acctbal AS decimal(18,2)) / 1000000 AS decimal(18,2)) AS varchar) END AS cost FROM supplier"
)
def print_costs(spark, sf_dir):
    rounded = F.round(F.col("s_acctbal") * 100) / 100
    return table(spark, sf_dir, "supplier").select("s_suppkey", figures.format_cost(F.col("s_acctbal") / 1000000, rounded / 1000000).alias("cost"))


# --- columns


def _mixed(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    cells = F.array(printed_tr(F.col("l_extendedprice")), printed_en(F.col("l_extendedprice")), F.format_number(F.col("l_quantity") * 1000, 0), F.date_format("l_shipdate", "dd.MM.yyyy"))
    return li.select(F.col("l_returnflag").alias("doc_id"), F.lit(0).alias("sheet_ord"), F.lit(0).alias("row_ord"), cells.alias("cells"))


@query("SELECT f.l_returnflag AS doc_id, v.col_ord, v.mark, f.filled FROM (SELECT l_returnflag, count(*) AS filled FROM lineitem GROUP BY 1) f, (VALUES (0, ','), (1, '.'), (2, NULL), (3, NULL)) v(col_ord, mark)")
def mark_vote(spark, sf_dir):
    return profile.profile(_mixed(spark, sf_dir)).select("doc_id", "col_ord", "mark", "filled")


def _orders_sheet(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    cells = F.array(F.concat(F.lit("0"), F.col("o_orderkey").cast("string")), F.col("o_orderstatus"), printed_tr(F.col("o_totalprice"), " TL"), F.date_format("o_orderdate", "dd.MM.yyyy"), F.col("o_custkey").cast("string"))
    rows = o.select(F.col("o_orderpriority").alias("doc_id"), F.lit(0).alias("sheet_ord"), F.col("o_orderkey").alias("row_ord"), cells.alias("cells"))
    return rows, sheet(spark, rows.select("doc_id").distinct(), ["Sipariş", "Durum", "Tutar", "Tarih", "Müşteri"])


@query(
    "SELECT o.p AS doc_id, v.col_ord, v.kind, v.places, CASE WHEN v.col_ord = 2 THEN o.cents END AS cents FROM (SELECT o_orderpriority AS p, sum(cast(round(o_totalprice * 100) AS bigint))::bigint AS cents FROM orders GROUP BY 1) o, "
    "(VALUES (0, 'text', 0), (1, 'text', 0), (2, 'number', 2), (3, 'date', 0), (4, 'number', 0)) v(col_ord, kind, places)"
)
def column_kinds(spark, sf_dir):
    found = profile.profile(_orders_sheet(spark, sf_dir)[0])
    return found.select("doc_id", "col_ord", "kind", "places", F.when(F.col("col_ord") == 2, cents(F.col("total"))).alias("cents"))


@query(
    "SELECT o.p AS doc_id, v.col_ord, v.kind, least(200, o.n) AS filled FROM (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1) o, "
    "(VALUES (0, 'text'), (1, 'text'), (2, 'number'), (3, 'date'), (4, 'number')) v(col_ord, kind)"
)
def preview_kinds(spark, sf_dir):
    from pyspark.sql import Window

    rows, sheets = _orders_sheet(spark, sf_dir)
    numbered = rows.withColumn("row_ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("row_ord")) - 1)
    shown = profile.preview(numbered, sheets)
    return shown.select("doc_id", "col_ord", "kind", "filled")


def gtin(key: str = "p_partkey") -> Column:
    body = F.concat(F.lit("869"), F.lpad(F.col(key).cast("string"), 9, "0"))
    return F.concat(body, barcodes.check_digit(body))


#: A code of 13 digits made from a part key, in SQL.
GTIN_SQL = "(SELECT p_partkey AS k, '869' || lpad(cast(p_partkey AS varchar), 9, '0') AS body FROM part)"
CHECK_SQL = "cast((10 - (list_sum(list_transform(range(1, 13), lambda i: cast(substr(body, cast(i AS bigint), 1) AS int) * (CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END))) % 10)) % 10 AS varchar)"
CODE_SQL = f"(SELECT k, body || {CHECK_SQL} AS code FROM {GTIN_SQL})"


@query(f"SELECT k AS p_partkey, code, k % 3 <> 0 AS valid FROM {CODE_SQL}")
def gtin_check(spark, sf_dir):
    last = F.when(F.col("p_partkey") % 3 == 0, ((F.substring("code", -1, 1).cast("int") + 1) % 10).cast("string")).otherwise(F.substring("code", -1, 1))
    parts = table(spark, sf_dir, "part").withColumn("code", gtin())
    return parts.select("p_partkey", "code", barcodes.valid_check_digit(F.concat(F.substring("code", 1, 12), last)).alias("valid"))


@query(f"SELECT k AS p_partkey, code AS digits FROM {CODE_SQL}")
def barcode_normalize(spark, sf_dir):
    code, way = F.col("code"), F.col("p_partkey") % 4
    printed = F.when(way == 0, F.concat(F.substring(code, 1, 3), F.lit(" "), F.substring(code, 4, 3), F.lit(" "), F.substring(code, 7, 7))).when(way == 1, F.concat(code, F.lit(".0"))).when(way == 2, F.concat(F.lit("B"), F.substring(code, 2, 12))).otherwise(F.concat(F.lit("'"), code))
    return table(spark, sf_dir, "part").withColumn("code", gtin()).select("p_partkey", barcodes.normalize_barcode(printed).alias("digits"))


@query(f"SELECT k AS p_partkey, CASE k % 3 WHEN 0 THEN code WHEN 1 THEN 'B' || substr(code, 2, 11) || cast((cast(substr(code, 13, 1) AS int) + 1) % 10 AS varchar) ELSE code END AS cell, k % 3 = 0 AS repaired FROM {CODE_SQL}")
def barcode_repair(spark, sf_dir):
    code, way = F.col("code"), F.col("p_partkey") % 3
    wrong = F.concat(F.lit("B"), F.substring(code, 2, 11), ((F.substring(code, 13, 1).cast("int") + 1) % 10).cast("string"))
    printed = F.when(way == 0, F.concat(F.lit("B"), F.substring(code, 2, 12))).when(way == 1, wrong).otherwise(code)
    rows = table(spark, sf_dir, "part").withColumn("code", gtin()).select(F.lit("d").alias("doc_id"), F.lit(0).alias("sheet_ord"), F.col("p_partkey").alias("row_ord"), F.array(F.lit("x"), printed).alias("cells"))
    sheets = sheet(spark, rows.select("doc_id").limit(1), ["Ürün", "Barkod"])
    code_col = profile.barcode_columns(sheets, profile.profile(rows))
    return profile.mended(rows, code_col).select(F.col("row_ord").alias("p_partkey"), F.col("cells")[1].alias("cell"), "repaired")


@query("SELECT p_partkey, concat_ws('|', lpad(cast(p_partkey AS varchar), 12, '0'), cast(p_partkey AS varchar), lpad(cast(p_partkey AS varchar), 13, '0'), lpad(cast(p_partkey AS varchar), 14, '0')) AS forms FROM part")
def barcode_keys(spark, sf_dir):
    digits = F.lpad(F.col("p_partkey").cast("string"), 12, "0")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(barcodes.barcode_keys(digits), "|").alias("forms"))


# --- catalogs


def _entries(spark, sf_dir) -> DataFrame:
    """Three sources that overlap; the middle one has no prices, the last one no brands."""
    parts = table(spark, sf_dir, "part").withColumn("code", gtin())
    null = F.lit(None).cast("string")

    def source(name: str, priority: int, keep: Column, price: Column, brand: Column) -> DataFrame:
        return parts.where(keep).select(F.col("code").alias("barcode"), F.concat(F.lit(f" {name} "), "p_name", F.lit("\u00a0 ")).alias("name"), F.lit(name).alias("source"), price.alias("price"), brand.alias("brand"), null.alias("note"), F.lit(priority).alias("priority"), F.col("p_partkey").alias("ordinal"))

    k = F.col("p_partkey")
    price = printed_tr(F.col("p_retailprice"), " TL")
    return source("open", 0, k % 2 == 0, price, F.col("p_brand")).unionByName(source("shop", 1, k % 3 == 0, null, F.col("p_type"))).unionByName(source("own", 2, k % 5 == 0, printed_en(F.col("p_retailprice") + 1), null))


@query(
    f"""SELECT c.code AS bare, CASE WHEN k % 5 = 0 THEN 'own' WHEN k % 3 = 0 THEN 'shop' ELSE 'open' END AS source,
    CASE WHEN k % 5 = 0 THEN cast(cast(p_retailprice + 1 AS decimal(18,2)) AS varchar) WHEN k % 2 = 0 THEN cast(cast(p_retailprice AS decimal(18,2)) AS varchar) END AS price,
    CASE WHEN k % 3 = 0 THEN p_type WHEN k % 2 = 0 THEN p_brand END AS brand
    FROM {CODE_SQL} c JOIN part ON p_partkey = k WHERE k % 2 = 0 OR k % 3 = 0 OR k % 5 = 0"""
)
def catalog_merge(spark, sf_dir):
    return catalog.build(_entries(spark, sf_dir)).select("bare", "source", "price", "brand")


@query(
    """SELECT l_returnflag, count(*) AS barcode_rows, count(*) FILTER (WHERE k % 2 = 0 OR k % 3 = 0 OR k % 5 = 0) AS matched,
    count(*) FILTER (WHERE k % 2 = 0 OR k % 5 = 0) AS priced, count(DISTINCT CASE WHEN NOT (k % 2 = 0 OR k % 3 = 0 OR k % 5 = 0) THEN (k, l_linenumber % 2) END) AS unmatched
    FROM (SELECT *, l_partkey AS k FROM lineitem) GROUP BY 1"""
)
def catalog_lookup(spark, sf_dir):
    body = F.concat(F.lit("869"), F.lpad(F.col("l_partkey").cast("string"), 9, "0"))
    printed = F.concat(F.when(F.col("l_linenumber") % 2 == 1, "0").otherwise(""), body, barcodes.check_digit(body))
    codes = table(spark, sf_dir, "lineitem").select("l_returnflag", barcodes.normalize_barcode(printed).alias("digits"))
    found = catalog.lookup(codes, _entries(spark, sf_dir))
    missing = F.when(F.col("hit").isNull(), F.col("digits"))
    return found.groupBy("l_returnflag").agg(F.count("digits").alias("barcode_rows"), F.count("hit").alias("matched"), F.count("hit.price").alias("priced"), F.count_distinct(missing).alias("unmatched"))


@query(f"SELECT k AS p_partkey, CASE WHEN k % 7 = 0 THEN 'old' WHEN k % 2 = 0 OR k % 3 = 0 OR k % 5 = 0 THEN CASE WHEN k % 5 = 0 THEN 'own ' WHEN k % 3 = 0 THEN 'shop ' ELSE 'open ' END || p_name ELSE ' ' END AS name, coalesce(CASE WHEN k % 5 = 0 THEN replace(cast(cast(p_retailprice + 1 AS decimal(18,2)) AS varchar), '.', ',') WHEN k % 2 = 0 THEN replace(cast(cast(p_retailprice AS decimal(18,2)) AS varchar), '.', ',') END, '') AS price FROM {CODE_SQL} JOIN part ON p_partkey = k")
def fill_names(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 7 == 0, "old").otherwise(" ")
    rows = table(spark, sf_dir, "part").withColumn("code", gtin()).select("p_partkey", F.array(F.col("code"), name).alias("cells"))
    filled, _ = catalog.fill(rows, 0, _entries(spark, sf_dir), name_col=1, extras=("price",), mark=",")
    return filled.select("p_partkey", F.col("cells")[1].alias("name"), F.col("cells")[2].alias("price"))


@query(f"SELECT code AS digits, CASE WHEN k % 2 = 0 THEN 'registry' ELSE 'open' END AS source FROM {CODE_SQL} WHERE k % 2 = 0 OR k % 3 = 0")
def lookup_cascade(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumn("digits", gtin())
    named = lambda s, keep: parts.where(keep).select("digits", F.col("p_name").alias("name"), F.lit(s).alias("source"))
    return catalog.cascade(parts, named("registry", F.col("p_partkey") % 2 == 0), [named("open", F.col("p_partkey") % 3 == 0)]).select("digits", "source")


@query(f"SELECT code AS digits FROM {CODE_SQL} WHERE k % 2 = 1 AND k IN (SELECT l_partkey FROM lineitem) ORDER BY code LIMIT 200")
def untried_codes(spark, sf_dir):
    """The next 200 codes to ask for: a lookup takes that many."""
    body = F.concat(F.lit("869"), F.lpad(F.col("l_partkey").cast("string"), 9, "0"))
    seen = table(spark, sf_dir, "lineitem").select(F.concat(body, barcodes.check_digit(body)).alias("digits"))
    tried = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(gtin().alias("digits"))
    return catalog.untried(seen, tried)


@query(f"SELECT code AS digits, CASE WHEN k % 3 = 0 THEN 'passive ' || p_name ELSE 'active ' || p_name END AS name FROM {CODE_SQL} JOIN part ON p_partkey = k")
def registry_first_wins(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumn("code", gtin())
    rows = lambda kind, passive: parts.select(F.col("code").alias("barcode"), F.concat(F.lit(f"{kind} "), "p_name").alias("name"), F.lit(passive).alias("is_passive"), F.lit(0).alias("sheet_ord"), F.col("p_partkey").alias("row_ord"))
    both = rows("passive", True).unionByName(rows("active", False).where("row_ord % 3 <> 0"))
    return catalog.registry_index(both).select("digits", "name")


# --- headings and stacking

#: Headings and the identities they must get.
HEADINGS = [
    ("Barkod", "barcode"), ("BARKODU", "barcode"), ("GTIN", "barcode"), ("Malzeme Kodu", "code"), ("Ürünün Kodu", "code"), ("SKU", "code"), ("Ürün Adı", "item"),
    ("Malın Cinsi", "item"), ("Mal / Hizmet Cinsi", "item"), ("Eşya Cinsi", "item"), ("İlaç Adı", "item"), ("AÇIKLAMA", "item"), ("Product Description", "item"), ("Item", "item"),
    ("Miktar", "quantity"), ("Adet", "quantity"), ("Qty", "quantity"), ("Birim", "unit"), ("Birim Fiyatı", "unit_price"), ("Unit price", "unit_price"), ("İskonto %", "discount"),
    ("KDV Oranı", "vat"), ("Toplam Tutar", "amount"), ("Mal Hizmet Tutarı", "amount"), ("Tarih", "date"), ("Maliyet", "maliyet"), ("Son Kullanma", "son kullanma"), ("  ", "__blank"),
]


def _values(rows: list[tuple]) -> str:
    text = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)


@query(
    f"SELECT n.n_nationkey AS doc, h.heading, h.key FROM nation n, ({_values(HEADINGS)}) h(heading, key) UNION ALL SELECT p_partkey, p_name, lower(p_name) FROM part "
    "UNION ALL SELECT p_partkey, 'Malın Cinsi: ' || p_name, 'item' FROM part UNION ALL SELECT p_partkey, p_brand || ' (KDV)', lower(replace(p_brand, '#', ' ')) || ' kdv' FROM part"
)
def heading_identity(spark, sf_dir):
    """Known headings in every document, and tables' own texts as headings: unknown, named by their first words, or not."""
    known = F.explode(F.array(*(F.lit(h) for h, _ in HEADINGS))).alias("heading")
    parts = table(spark, sf_dir, "part")
    texts = F.explode(F.array(F.col("p_name"), F.concat(F.lit("Malın Cinsi: "), "p_name"), F.concat("p_brand", F.lit(" (KDV)")))).alias("heading")
    each = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc"), known).unionByName(parts.select(F.col("p_partkey").alias("doc"), texts))
    return each.select("doc", "heading", headings.identify(F.col("heading"))["key"].alias("key"))


@query(
    "SELECT s_suppkey, c.col_ord, CASE c.col_ord WHEN 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'item:aciklama ' || lower(replace(s_name, '#', ' ')) ELSE 'item' END WHEN 1 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'item' ELSE 'item:aciklama' END "
    "WHEN 2 THEN lower(replace(s_name, '#', ' ')) ELSE 'barcode' END AS key FROM supplier, (VALUES (0), (1), (2), (3)) c(col_ord)"
)
def heading_arbitration(spark, sf_dir):
    """Each supplier's table has two columns that could be the item, its own name as a heading, and a barcode column."""
    even = F.col("s_suppkey") % 2 == 0
    own = F.concat(F.lit("Açıklama "), "s_name")
    heads = F.array(F.when(even, own).otherwise("Ürün Adı"), F.when(even, "Ürün Adı").otherwise("AÇIKLAMA"), F.col("s_name"), F.lit("Barkodu"))
    named = table(spark, sf_dir, "supplier").select("s_suppkey", F.posexplode(heads).alias("col_ord", "heading"))
    return stack.resolve_headings(named, ["s_suppkey"]).select("s_suppkey", "col_ord", "key")


@query(
    "SELECT '__source' AS key, 'Source' AS label, 0 AS ord UNION ALL SELECT 'barcode', 'Barcode', 1 UNION ALL "
    "SELECT lower(replace(n_name, '_', ' ')), n_name, (1 + row_number() OVER (ORDER BY n_nationkey))::int FROM nation"
)
def discover_columns(spark, sf_dir):
    """A document a customer, whose columns are a barcode and the name of the customer's nation, met in the order of nations."""
    named = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.array(F.lit("Barkod"), F.concat(F.lit(" "), "n_name")).alias("heads"))
    docs = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("doc")).join(named, "nation", "right")
    each = docs.select(F.coalesce("doc", F.lit(-1)).alias("doc_id"), F.col("nation").alias("doc_ord"), F.posexplode("heads").alias("col_ord", "heading"))
    return stack.discover(stack.resolve_headings(each, ["doc_id", "doc_ord"]))


@query(
    "SELECT 0 AS doc_ord, c_custkey AS row_ord, 'musteri.csv' AS __source, c_name AS item, cast(cast(c_acctbal AS decimal(18,2)) AS varchar) AS amount, c_mktsegment AS segment, '' AS code FROM customer "
    "UNION ALL SELECT 1, s_suppkey, 'suppliers.csv', s_name, cast(cast(s_acctbal AS decimal(18,2)) AS varchar), '', 'S' || s_suppkey FROM supplier "
    "UNION ALL SELECT 2, n_nationkey, 'nations.csv', n_name, '1', '', CASE WHEN n_nationkey % 3 = 0 THEN '3' WHEN n_nationkey % 3 = 1 THEN '2' ELSE '' END FROM nation"
)
def stack_documents(spark, sf_dir):
    money = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    customers = table(spark, sf_dir, "customer").select(F.lit("c").alias("doc_id"), F.col("c_custkey").alias("row_ord"), F.array("c_name", money("c_acctbal"), "c_mktsegment").alias("cells"))
    suppliers = table(spark, sf_dir, "supplier").select(F.lit("s").alias("doc_id"), F.col("s_suppkey").alias("row_ord"), F.array(money("s_acctbal"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")), F.col("s_name")).alias("cells"))
    # Ragged rows: two columns share the key amount:tutar, the later one counts in rows that reach it.
    third = F.slice(F.array(F.col("n_name"), F.lit("1"), F.lit("2"), F.lit("3")), F.lit(1), (4 - F.col("n_nationkey") % 3).cast("int"))
    nations = table(spark, sf_dir, "nation").select(F.lit("n").alias("doc_id"), F.col("n_nationkey").alias("row_ord"), third.alias("cells"))
    more = spark.createDataFrame([("n", 0, "Ürün Adı"), ("n", 1, "Tutar"), ("n", 2, "Tutar"), ("n", 3, "tutar")], "doc_id string, col_ord int, heading string")
    named = spark.createDataFrame([("c", 0, "Ürün Adı"), ("c", 1, "Tutar"), ("c", 2, "Segment"), ("s", 0, "Amount"), ("s", 1, "Stok Kodu"), ("s", 2, "Product Name")], "doc_id string, col_ord int, heading string")
    docs = spark.createDataFrame([("c", 0, "musteri.csv"), ("s", 1, "suppliers.csv"), ("n", 2, "nations.csv")], "doc_id string, doc_ord int, filename string")
    whole = stack.combine(customers.unionByName(suppliers).unionByName(nations), stack.resolve_headings(named.unionByName(more), ["doc_id"]), docs, [stack.SOURCE, "item", "amount", "segment", "code", "amount:tutar"])
    return whole.withColumn("code", F.concat("code", "amount:tutar")).drop("amount:tutar")


@query(
    "SELECT o_orderpriority AS doc_id, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'F') * 0.25 >= 3 * count(*) FILTER (WHERE o_orderstatus = 'O') AND count(*) FILTER (WHERE o_orderstatus = 'F') > 0 THEN 0 "
    "WHEN count(*) FILTER (WHERE o_orderstatus = 'O') > 0 THEN 1 ELSE -1 END::int AS \"primary\" FROM orders GROUP BY 1"
)
def primary_sheet(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    narrow = F.array(F.col("o_orderkey").cast("string"), F.lit("x"))
    rows = o.where("o_orderstatus in ('F', 'O')").select(F.col("o_orderpriority").alias("doc_id"), F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("sheet_ord"), F.when(F.col("o_orderstatus") == "F", narrow).otherwise(F.concat(narrow, F.array(F.lit("y")))).alias("cells"))
    docs = o.select(F.col("o_orderpriority").alias("doc_id")).distinct()
    sheets = docs.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("sheet_ord"), F.lit("s").alias("name"), F.array(F.lit("a")).alias("columns"))
    return stack.primary_sheets(rows, sheets)


def _invoices(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """An invoice an order: its lines, and a total that every third order states 10 too high."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.array(F.concat(F.lit("K"), F.col("l_partkey").cast("string")), printed_tr(F.col("l_extendedprice"), " TL")).alias("cells"), F.col("l_extendedprice").cast("decimal(18,2)").alias("v"))
    totals = li.groupBy("doc_id").agg(F.sum("v").alias("t")).withColumn("t", F.when(F.col("doc_id") % 3 == 0, F.col("t") + 10).otherwise(F.col("t")))
    lines = li.select("doc_id", F.lit(0).alias("sheet_ord"), F.xxhash64("cells").alias("row_ord"), "cells")
    stated = totals.select("doc_id", F.lit(1).alias("sheet_ord"), F.lit(0).cast("bigint").alias("row_ord"), F.array(F.lit("Genel Toplam"), printed_tr(F.col("t"))).alias("cells"))
    two = F.array(F.struct(F.lit(0).alias("sheet_ord"), F.lit("Kalemler").alias("name"), F.array(F.lit("Kod"), F.lit("Tutar")).alias("columns")), F.struct(F.lit(1).alias("sheet_ord"), F.lit("Özet").alias("name"), F.array(F.lit(""), F.lit("")).alias("columns")))
    return lines.unionByName(stated), totals.select("doc_id", F.explode(two).alias("s")).select("doc_id", "s.*")


@query(
    """SELECT l_orderkey AS doc_id, l_orderkey % 3 <> 0 AS ok, 'Tutar' AS column_name, sum(cast(round(l_extendedprice * 100) AS bigint))::bigint AS total,
    (CASE WHEN l_orderkey % 3 = 0 THEN -1000 ELSE 0 END)::bigint AS delta FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 2"""
)
def reconcile_orders(spark, sf_dir):
    found = reconcile.reconcile(*_invoices(spark, sf_dir))
    return found.select("doc_id", "ok", "column_name", cents(F.col("total")).alias("total"), cents(F.col("delta")).alias("delta"))


# --- sinks and sources

#: A part as a row with a name that needs quoting, a formula or a line break, in SQL and as cells.
NAME_SQL = "CASE p_partkey % 4 WHEN 0 THEN p_name || '; \"x\"' WHEN 1 THEN '=' || p_name WHEN 2 THEN p_name || chr(10) || 'b' ELSE '-' || p_name END"


def _part_cells() -> Column:
    way = F.col("p_partkey") % 4
    name = F.when(way == 0, F.concat("p_name", F.lit('; "x"'))).when(way == 1, F.concat(F.lit("="), "p_name")).when(way == 2, F.concat("p_name", F.lit("\nb"))).otherwise(F.concat(F.lit("-"), "p_name"))
    return F.array(F.concat(F.lit("0"), F.col("p_partkey").cast("string")), name, printed_tr(F.col("p_retailprice"), " TL"))


def _part_sheet(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), F.lit(0).alias("sheet_ord"), F.col("p_partkey").alias("row_ord"), _part_cells().alias("cells"))
    return rows, sheet(spark, rows.select("doc_id").distinct(), ["Kod", "Ürün; Adı", "Fiyat"])


#: Part keys that one file of a brand spans, so that no file grows with the table.
FILE_KEYS = 20_000


def _part_files(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows and sheets of files that each hold a brand's parts of one range of keys, and (doc_id, brand, start) of each file.

    start: how many of the brand's parts come in earlier files.
    """
    keyed = table(spark, sf_dir, "part").withColumn("block", F.expr(f"p_partkey div {FILE_KEYS}")).withColumn("doc_id", F.to_json(F.struct("p_brand", "block")))
    rows = keyed.select("doc_id", F.lit(0).alias("sheet_ord"), F.col("p_partkey").alias("row_ord"), _part_cells().alias("cells"))
    sizes = keyed.groupBy("doc_id", F.col("p_brand").alias("brand"), "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("brand").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("doc_id", "brand", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return rows, sheet(spark, sizes.select("doc_id"), ["Kod", "Ürün; Adı", "Fiyat"]), starts


def _read_back(written: DataFrame, starts: DataFrame, tail: str) -> DataFrame:
    """The parts of written(doc_id, content), numbered through each brand's files; no limit of uploads cuts what was just written."""
    read = files.read_sheets(written.select(F.concat("doc_id", F.lit(tail)).alias("path"), "content"), max_rows=None, max_bytes=None)
    met = read.join(starts.select(F.concat("doc_id", F.lit(tail)).alias("doc_id"), "brand", "start"), "doc_id")
    cell = lambda k: F.col("cells")[k]
    return met.select(F.concat("brand", F.lit(tail)).alias("doc_id"), (F.col("start") + F.col("row_ord")).alias("row_ord"), cell(0).alias("code"), cell(1).alias("name"), cell(2).alias("price"))


PRICE_SQL = "replace(cast(cast(p_retailprice AS decimal(18,2)) AS varchar), '.', ',')"
CELL_SQL = f"CASE p_partkey % 4 WHEN 0 THEN '\"' || p_name || '; \"\"x\"\"\"' WHEN 1 THEN '''=' || p_name WHEN 2 THEN '\"' || p_name || chr(10) || 'b\"' ELSE '-' || p_name END"


@query(f"SELECT p_brand AS doc_id, chr(65279) || 'Kod;\"Ürün; Adı\";Fiyat' || chr(13) || chr(10) || string_agg('0' || p_partkey || ';' || {CELL_SQL} || ';' || {PRICE_SQL}, chr(13) || chr(10) ORDER BY p_partkey) AS content FROM part GROUP BY 1")
def csv_files(spark, sf_dir):
    return sinks.csv_files(*_part_sheet(spark, sf_dir), lang="tr").select("doc_id", "content")


@query(f"SELECT p_partkey AS row_ord, '0' || p_partkey || chr(9) || replace({NAME_SQL}, chr(10), ' ') || chr(9) || {PRICE_SQL} || chr(9) AS line FROM part")
def tsv_lines(spark, sf_dir):
    return sinks.prepared(*_part_sheet(spark, sf_dir), ",").select("row_ord", sinks.tsv_line(F.col("cells"), F.lit(4)).alias("line"))


@query(f"SELECT p_partkey AS row_ord, '<tr><td style=\"mso-number-format:''\\@''\">0' || p_partkey || '</td><td>' || {NAME_SQL} || '</td><td>' || {PRICE_SQL} || '</td></tr>' AS line FROM part")
def html_rows(spark, sf_dir):
    is_text = F.array(F.lit(True), F.lit(False), F.lit(False))
    return sinks.prepared(*_part_sheet(spark, sf_dir), ",").select("row_ord", sinks.html_row(F.col("cells"), F.lit(3), is_text).alias("line"))


@query(f"SELECT p_brand || '.csv' AS doc_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS row_ord, '0' || p_partkey AS code, {NAME_SQL} AS name, {PRICE_SQL} AS price FROM part")
def csv_roundtrip(spark, sf_dir):
    rows, sheets, starts = _part_files(spark, sf_dir)
    written = sinks.csv_files(rows, sheets, lang="tr").select("doc_id", F.encode("content", "UTF-8").alias("content"))
    return _read_back(written, starts, ".csv")


@query(f"SELECT p_brand || '.xlsx' AS doc_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS row_ord, '0' || p_partkey AS code, {NAME_SQL} AS name, replace({PRICE_SQL}, ',', '.') AS price FROM part")
def xlsx_roundtrip(spark, sf_dir):
    rows, sheets, starts = _part_files(spark, sf_dir)
    return _read_back(sinks.workbooks(rows, sheets), starts, ".xlsx")


@query("SELECT p_brand AS list_id, p_partkey AS n, '869' || lpad(cast(p_partkey AS varchar), 9, '0') AS barcode, p_name AS name, cast(cast(p_retailprice AS decimal(18,2)) AS varchar) AS price, CASE WHEN p_partkey % 2 = 0 THEN 'headed' ELSE 'bare' END AS kind FROM part")
def list_parse(spark, sf_dir):
    """Lists with a heading, and lines without one whose cells stand in any order."""
    parts = table(spark, sf_dir, "part").withColumn("code", F.concat(F.lit("869"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")))
    headed, k = F.col("p_partkey") % 2 == 0, F.col("p_partkey")
    line = F.when(headed, F.concat_ws(";", "p_name", "code", printed_tr(F.col("p_retailprice"), " TL"))).otherwise(F.concat_ws("\t", "code", F.lit("2"), printed_en(F.col("p_retailprice")), F.col("p_name")))
    kind = F.when(headed, "headed").otherwise("bare")
    lines = parts.select(F.concat_ws("/", "p_brand", kind).alias("list_id"), k.alias("n"), line.alias("line"))
    heads = parts.where(headed).select(F.concat_ws("/", "p_brand", F.lit("headed")).alias("list_id"), F.lit(-1).cast("bigint").alias("n"), F.lit("Ürün Adı;Barkod;Fiyat").alias("line")).distinct()
    read = documents.parse_list(lines.unionByName(heads), "own").where(~F.col("skipped"))
    return read.select(F.split("list_id", "/")[0].alias("list_id"), "n", "barcode", "name", "price", F.split("list_id", "/")[1].alias("kind"))


@query(
    "SELECT cast(o_orderkey AS varchar) AS doc_id, 'Fatura' AS name, cast(o_orderkey AS varchar) AS a, CASE WHEN o_orderkey % 2 = 0 THEN 'TRUE' ELSE '' END AS b, o_orderstatus AS c FROM orders "
    "UNION ALL SELECT 'x' || o_orderkey, CASE o_orderkey % 6 WHEN 1 THEN 'Sheet2' WHEN 2 THEN '' WHEN 3 THEN 'Text' WHEN 4 THEN 'Text' WHEN 5 THEN 'e' ELSE 'n' END, "
    "CASE o_orderkey % 6 WHEN 0 THEN 'Infinity' WHEN 1 THEN cast(o_orderkey AS varchar) WHEN 2 THEN o_orderstatus WHEN 3 THEN '{\"sheets\":[{\"rows\":[[NaN,' || o_orderkey || ']]}]}' WHEN 4 THEN '[' || o_orderkey || ',{' END, "
    "CASE o_orderkey % 6 WHEN 0 THEN '[1,\"a\",1.5]' END, NULL FROM orders"
)
def reply_sheets(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    row = F.array(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "true").otherwise("null"), F.concat(F.lit('"'), "o_orderstatus", F.lit('"')))
    body = F.concat(F.lit('{"sheets":[{"name":"Fatura","columns":["a","b","c"],"rows":[['), F.array_join(row, ","), F.lit("]]}]}"))
    reply = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Here it is: "), body, F.lit(" Done."))).otherwise(body)
    # Replies that a model may give and no reader must fall over.
    key, way = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 6
    odd = (
        F.when(way == 0, F.lit('{"sheets":[{"name":"n","columns":["a","b"],"rows":[[1e999,[1,"a",1.50]]]}]}'))
        .when(way == 1, F.concat(F.lit('{"sheets":["no table",{"columns":5,"rows":[['), key, F.lit("]]}]}")))
        .when(way == 2, F.concat(F.lit('{"sheets":[{"name":"","rows":[["'), "o_orderstatus", F.lit('"]]}]}')))
        .when(way == 3, F.concat(F.lit('{"sheets":[{"rows":[[NaN,'), key, F.lit("]]}]}")))
        .when(way == 4, F.concat(F.lit("["), key, F.lit(",{"), F.repeat(F.lit('"a":['), 0)))
        .otherwise(F.lit('{"sheets":[{"name":"e","columns":["a"],"rows":7}]}'))
    )
    both = o.select(F.col("o_orderkey").cast("string").alias("doc_id"), reply.alias("reply")).unionByName(o.select(F.concat(F.lit("x"), key).alias("doc_id"), odd.alias("reply")))
    read = documents.read_replies(both)
    return read.select("doc_id", "name", F.get("cells", F.lit(0)).alias("a"), F.get("cells", F.lit(1)).alias("b"), F.get("cells", F.lit(2)).alias("c"))


@query(f"SELECT 'https://shop.example.com/urun/' || k AS url, code AS barcode, p_name AS name, cast(cast(p_retailprice AS decimal(18,2)) AS varchar) AS price, p_brand AS brand FROM {CODE_SQL} JOIN part ON p_partkey = k")
def jsonld_products(spark, sf_dir):
    """Products in pages of the shapes that shops use, among real pages that have none."""
    offer = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('[{"price":"'), printed_tr(F.col("p_retailprice")), F.lit('"}]'))).otherwise(F.concat(F.lit('{"lowPrice":"'), printed_en(F.col("p_retailprice")), F.lit('"}')))
    node = F.concat(F.lit('{"@type":"Product","name":" '), "p_name", F.lit(' ","brand":{"name":"'), "p_brand", F.lit('"},"sku":"A1","gtin13":"'), "code", F.lit('","offers":'), offer, F.lit("}"))
    data = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('{"@graph":[{"name":"Shop"},'), node, F.lit("]}"))).otherwise(node)
    html = F.concat(F.lit('<html><script type="application/ld+json">{bad</script><script type="application/ld+json">'), data, F.lit("</script></html>"))
    made = table(spark, sf_dir, "part").withColumn("code", gtin()).select(F.concat(F.lit("https://shop.example.com/urun/"), F.col("p_partkey").cast("string")).alias("url"), html.alias("html"))
    return documents.products(made.unionByName(table(spark, sf_dir, "pages").select("url", "html")), "shop").drop("source")


@query("SELECT 'https://www.shop.example.com' AS site, 'https://shop.example.com/product/' || p_partkey || '?a=1&b=2' AS url, row_number() OVER (ORDER BY p_partkey) AS n FROM part WHERE p_partkey % 4 = 0 ORDER BY p_partkey LIMIT 500")
def sitemap_urls(spark, sf_dir):
    """A site's first 500 products: a crawl takes that many."""
    k = F.col("p_partkey").cast("string")
    way = F.col("p_partkey") % 4
    url = F.when(way == 0, F.concat(F.lit("http://shop.example.com/product/"), k, F.lit("?a=1&amp;b=2"))).when(way == 1, F.concat(F.lit("https://shop.example.com/category/product/"), k)).when(way == 2, F.concat(F.lit("https://other.example.com/product/"), k)).otherwise(F.concat(F.lit("https://shop.example.com/about/"), k))
    maps = table(spark, sf_dir, "part").select(F.lit("https://www.shop.example.com").alias("site"), F.col("p_partkey").alias("ord"), F.concat(F.lit("<urlset><url><loc> "), url, F.lit(" </loc></url></urlset>")).alias("xml"))
    return documents.product_urls(maps)


URLS = [("http://shop.example.com/", 0), ("https://shop.example.com/a", 1), ("https://localhost/a", 0), ("https://10.0.0.1/a", 0), ("https://printer.local/", 0), ("https://host/a", 0), ("nonsense", 0)]


@query(f"SELECT url, url LIKE 'https://%' AS ok FROM pages UNION ALL SELECT v.url, v.ok = 1 FROM ({_values(URLS)}) v(url, ok)")
def public_url(spark, sf_dir):
    both = table(spark, sf_dir, "pages").select("url").unionByName(spark.createDataFrame([(u,) for u, _ in URLS], "url string"))
    return both.select("url", web.is_public_https(F.col("url")).alias("ok"))


@query("SELECT p_brand AS doc_id, 1 AS n_sheets, count(*) AS n_rows FROM part GROUP BY 1")
def json_files(spark, sf_dir):
    read = sinks.json_files(*_part_sheet(spark, sf_dir)).withColumn("x", F.from_json("content", "struct<sheets:array<struct<name:string,columns:array<string>,rows:array<array<string>>>>>"))
    return read.select("doc_id", F.size("x.sheets").alias("n_sheets"), F.size(F.col("x.sheets")[0]["rows"]).cast("bigint").alias("n_rows"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 7 IN (0, 6) THEN true WHEN p_partkey % 7 = 1 THEN false END AS has_text FROM part")
def pdf_probe(spark, sf_dir):
    """Documents that draw text, plain or by hex strings, that only show an image beside plain streams, that are encrypted,
    whose only stream is a JPEG, that draw text in less than 200 bytes, and that have no image."""
    stream = lambda body: F.concat(F.lit("%PDF-1.4\n1 0 obj\n<< >>\nstream\n"), body, F.lit("\nendstream\nendobj\n"))
    drawn = stream(F.concat(F.lit("BT ("), F.repeat(F.col("p_name"), 60), F.lit(") Tj ET")))
    image = F.concat(F.lit("<< /Subtype /Image >>"), stream(F.repeat(F.lit("q 1 0 0 1 0 0 cm /Im0 Do Q "), 12)))
    jpeg = F.concat(F.lit("%PDF-1.4\n1 0 obj\n<< /Subtype /Image /Filter /DCTDecode >>\nstream\n"), F.repeat(F.col("p_name"), 40), F.lit("\nendstream\nendobj\n"))
    short = stream(F.concat(F.lit("BT ("), F.rpad(F.col("p_name"), 80, "x"), F.lit(") Tj ET")))
    lines = stream(F.repeat(F.lit("0 0 m 1 1 l S "), 30))
    hexed = stream(F.concat(F.lit("BT <"), F.repeat(F.hex("p_name"), 60), F.lit("> Tj ET")))
    way = F.col("p_partkey") % 7
    raw = F.when(way == 0, drawn).when(way == 1, image).when(way == 2, F.concat(F.lit("/Encrypt "), drawn)).when(way == 3, jpeg).when(way == 4, short).when(way == 5, lines).otherwise(hexed)
    return table(spark, sf_dir, "part").select("p_partkey", files.text_layer(F.encode(raw, "UTF-8")).alias("has_text"))


