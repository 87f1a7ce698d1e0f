"""Queries of filling, registries, discovery and lookups, with SQL that gives the same rows from the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemill.functions import barcodes, figures, web
from tablemill.operators import catalog, profile
from tablemill.plans.queries import CODE_SQL, _entries, gtin, query, sheet, table
from tablemill.sources import documents, files

#: What the three sources of the queries' catalog know of a part, in SQL.
KNOWN_SQL = f"""(SELECT k, code, p_name, p_brand, k % 2 = 0 OR k % 3 = 0 OR k % 5 = 0 AS hit,
    CASE WHEN k % 5 = 0 THEN 'own ' WHEN k % 3 = 0 THEN 'shop ' WHEN k % 2 = 0 THEN 'open ' END || p_name AS name,
    CASE WHEN k % 5 = 0 THEN cast(cast(p_retailprice + 1 AS decimal(18,2)) AS varchar) WHEN k % 2 = 0 THEN cast(cast(p_retailprice AS decimal(18,2)) AS varchar) END AS price,
    CASE WHEN k % 3 = 0 THEN p_type WHEN k % 2 = 0 THEN p_brand END AS brand FROM {CODE_SQL} JOIN part ON p_partkey = k)"""


def _brand_sheets(spark, sf_dir):
    """A sheet a brand, of three shapes: without a barcode column, with a name column, and ragged without one."""
    kind = F.substring("p_brand", -1, 1).cast("int") % 3
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").withColumn("code", gtin()).withColumn("kind", kind)
    named = F.array(F.col("code"), F.when(k % 4 == 0, "kept").otherwise(" "))
    ragged = F.when(k % 2 == 0, F.array("code")).otherwise(F.array(F.col("code"), F.lit("5")))
    cells = F.when(F.col("kind") == 0, F.array(F.lit("no code"), F.col("p_name"))).when(F.col("kind") == 1, named).otherwise(ragged)
    rows = parts.select(F.col("p_brand").alias("doc_id"), F.lit(0).alias("sheet_ord"), k.alias("row_ord"), cells.alias("cells"))
    heads = F.when(F.col("kind") == 0, F.array(F.lit("Not"), F.lit("Metin"))).when(F.col("kind") == 1, F.array(F.lit("Barkod"), F.lit("Ürün Adı"))).otherwise(F.array(F.lit("GTIN"), F.lit("Adet"), F.lit("marka")))
    sheets = parts.select(F.col("p_brand").alias("doc_id"), "kind").distinct().select("doc_id", F.lit(0).alias("sheet_ord"), F.lit("s").alias("name"), heads.alias("columns"))
    return rows, sheets


def _filled(spark, sf_dir):
    rows, sheets = _brand_sheets(spark, sf_dir)
    code = profile.barcode_columns(sheets, profile.profile(rows))
    extras = (("price", "Label price"), ("brand", "Marka"), ("note", "Note"))
    return catalog.fill_sheets(rows, sheets, _entries(spark, sf_dir), code, profile.name_columns(sheets), "Product name", extras, ",")


SHAPE_SQL = "cast(substr(p_brand, -1) AS int) % 3"


@query(f"""SELECT p_brand AS doc_id, k AS row_ord, CASE {SHAPE_SQL} WHEN 0 THEN 'no code|' || p_name
    WHEN 1 THEN code || '|' || CASE WHEN k % 4 = 0 THEN 'kept' ELSE coalesce(name, ' ') END || more
    ELSE code || CASE WHEN k % 2 = 0 THEN '|' ELSE '|5' END || '||' || coalesce(name, '') || more END AS line
    FROM (SELECT *, CASE WHEN max(price IS NOT NULL) OVER (PARTITION BY p_brand) THEN '|' || coalesce(replace(price, '.', ','), '') ELSE '' END
        || CASE WHEN max(brand IS NOT NULL) OVER (PARTITION BY p_brand) THEN '|' || coalesce(brand, '') ELSE '' END AS more FROM {KNOWN_SQL})""")
def fill_sheets(spark, sf_dir):
    rows, _, _ = _filled(spark, sf_dir)
    return rows.select("doc_id", "row_ord", F.array_join("cells", "|").alias("line"))


@query(f"""SELECT p_brand AS doc_id, CASE {SHAPE_SQL} WHEN 0 THEN 'Not|Metin' WHEN 1 THEN 'Barkod|Ürün Adı' || CASE WHEN max(price IS NOT NULL) THEN '|Label price' ELSE '' END || CASE WHEN max(brand IS NOT NULL) THEN '|Marka' ELSE '' END
    ELSE 'GTIN|Adet|marka|Product name' || CASE WHEN max(price IS NOT NULL) THEN '|Label price' ELSE '' END || CASE WHEN max(brand IS NOT NULL) THEN '|Marka (2)' ELSE '' END END AS columns,
    CASE WHEN {SHAPE_SQL} = 0 THEN -1 ELSE 0 END AS barcode_col, CASE WHEN {SHAPE_SQL} = 0 THEN 0 ELSE count(*) END AS barcode_rows, CASE WHEN {SHAPE_SQL} = 0 THEN 0 ELSE count(*) FILTER (WHERE hit) END AS matched,
    CASE WHEN {SHAPE_SQL} = 0 THEN 0 ELSE count(price) END AS priced, CASE WHEN {SHAPE_SQL} = 0 THEN 0 ELSE count(*) FILTER (WHERE NOT hit) END AS unmatched FROM {KNOWN_SQL} GROUP BY p_brand""")
def fill_counts(spark, sf_dir):
    _, sheets, counts = _filled(spark, sf_dir)
    return sheets.join(counts, ["doc_id", "sheet_ord"]).select("doc_id", F.array_join("columns", "|").alias("columns"), "barcode_col", "barcode_rows", "matched", "priced", "unmatched")


@query(f"""SELECT count(*) AS rows, count(*) FILTER (WHERE hit) AS matched, count(price) AS priced, count(*) FILTER (WHERE NOT hit) AS unmatched, true AS has_barcode_column
    FROM {KNOWN_SQL} WHERE {SHAPE_SQL} <> 0 HAVING count(*) > 0""")
def match_stats(spark, sf_dir):
    rows, sheets = _brand_sheets(spark, sf_dir)
    code = profile.barcode_columns(sheets, profile.profile(rows))
    first = sheets.select("doc_id", F.lit(0).alias("primary"))
    return catalog.match_stats(rows, _entries(spark, sf_dir), code, [], first)


@query("SELECT sum(CASE WHEN o_orderkey % 3 <> 0 THEN cast(o_orderkey % 7 AS bigint) END)::bigint AS cost, sum(cast(o_custkey AS bigint))::bigint AS n_rows, sum(cast(o_orderkey % 5 AS bigint))::bigint AS repaired FROM orders")
def batch_totals(spark, sf_dir):
    key = F.col("o_orderkey").cast("long")
    return catalog.batch_totals(table(spark, sf_dir, "orders").select(F.when(key % 3 != 0, key % 7).alias("cost"), F.col("o_custkey").cast("long").alias("n_rows"), (key % 5).alias("repaired")))


@query("SELECT 'open' AS source, count(*) FILTER (WHERE p_partkey % 2 = 0) AS n FROM part UNION ALL SELECT 'shop', count(*) FILTER (WHERE p_partkey % 3 = 0) FROM part UNION ALL SELECT 'own', count(*) FILTER (WHERE p_partkey % 5 = 0) FROM part")
def catalog_sizes(spark, sf_dir):
    return catalog.catalog_sizes(_entries(spark, sf_dir))


# --- registries


@query(f"""SELECT p_brand AS doc_id, code AS digits, CASE WHEN k % 3 = 0 THEN 'PASIF ' || p_name ELSE p_name || ' 20 MG' END AS name,
    CASE WHEN k % 3 = 0 THEN p_type WHEN k % 4 = 0 THEN NULL ELSE p_brand END AS brand, CASE WHEN k % 3 <> 0 THEN 'A' || k END AS note FROM {CODE_SQL} JOIN part ON p_partkey = k""")
def registry_scan(spark, sf_dir):
    """A workbook a brand: passive products first, active ones under titles in another order, and notes without headings."""
    parts = table(spark, sf_dir, "part").withColumn("code", gtin())
    k = F.col("p_partkey")
    row = lambda doc, ord_, at, cells: doc.select(F.col("p_brand").alias("doc_id"), F.lit(ord_).alias("sheet_ord"), at.cast("long").alias("row_ord"), cells.alias("cells"))
    makers = parts.select("p_brand").distinct()
    title = lambda ord_, at, *texts: row(makers, ord_, F.lit(at), F.array(*map(F.lit, texts)))
    rows = row(parts, 0, k + 20, F.array(F.concat(F.lit("PASIF  "), "p_name"), F.concat(F.lit(" "), "code"), F.col("p_type")))
    rows = rows.unionByName(title(0, 3, "İlaç Adı", "Barkod No", "Üretici"))
    active = F.array(k.cast("string"), F.col("code"), F.concat(F.lit("A"), k.cast("string")), F.concat("p_name", F.lit("\n20  MG ")), F.when(k % 4 == 0, " ").otherwise(F.col("p_brand")))
    rows = rows.unionByName(row(parts.where(k % 3 != 0), 1, k + 20, active))
    rows = rows.unionByName(title(1, 0, "RUHSATLI ÜRÜNLER LİSTESİ")).unionByName(title(1, 2, "Sıra", "BARKODU", "ATC Kodu", "Ürün İsmi", "Ruhsat Sahibi Firma Adı"))
    rows = rows.unionByName(row(parts, 2, k + 20, F.array(F.col("code"), F.lit("note")))).unionByName(title(2, 12, "Barkod", "Ürün Adı"))
    sheets = makers.select(F.col("p_brand").alias("doc_id"), F.posexplode(F.array(F.lit("Pasif Ürünler"), F.lit("Aktif"), F.lit("Notlar"))).alias("sheet_ord", "name"))
    return catalog.registry_scan(rows, sheets)


# --- discovery

SITE_SQL = "'https://www.shop' || s_nationkey || '.example.com'"


@query(f"""SELECT site, url, n FROM (SELECT {SITE_SQL} AS site, 'https://shop' || s_nationkey || '.example.com/urun/' || s_suppkey AS url,
    row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 4, s_suppkey) AS n FROM supplier WHERE s_nationkey % 4 <> 2 AND (s_nationkey % 4 = 3 OR s_suppkey % 4 < 3)) WHERE n <= 500""")
def sitemap_discovery(spark, sf_dir):
    """Shops whose robots.txt names an index, that keep one at a usual place, that have none, and whose map is a plain one."""
    sup = table(spark, sf_dir, "supplier").withColumn("site", F.concat(F.lit("https://www.shop"), F.col("s_nationkey").cast("string"), F.lit(".example.com")))
    way = F.col("s_nationkey") % 4
    sites = sup.select("site", "s_nationkey").distinct()
    robots = sites.select("site", F.when(way == 0, F.concat(F.lit("User-agent: *\n Sitemap: "), "site", F.lit("/maps/root.xml\n"))).alias("robots"))
    child = lambda c: F.concat(F.col("site"), F.lit("/maps/product-"), c.cast("string"), F.lit(".xml"))
    loc = lambda u: F.concat(F.lit("<loc>"), u, F.lit("</loc>"))
    index = F.concat(F.lit("<sitemapindex>"), loc(F.concat("site", F.lit("/maps/blog-product.xml"))), *(loc(child(F.lit(c))) for c in range(4)), F.lit("</sitemapindex>"))
    address = F.concat(F.lit("http://shop"), F.col("s_nationkey").cast("string"), F.lit(".example.com/urun/"), F.col("s_suppkey").cast("string"))
    listed = lambda by: F.concat(F.lit("<urlset>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("s_suppkey") % 4, "s_suppkey", loc(address).alias("l")))), lambda x: x["l"]), ""), F.lit("</urlset>"))
    maps = sup.where(way < 2).groupBy("site", (F.col("s_suppkey") % 4).alias("c")).agg(listed("c").alias("body")).select(child(F.col("c")).alias("url"), "body")
    plain = sup.where(way == 3).groupBy("site").agg(listed("site").alias("body")).select(F.concat("site", F.lit("/sitemap/")).alias("url"), "body")
    roots = sites.where(way == 0).select(F.concat("site", F.lit("/maps/root.xml")).alias("url"), index.alias("body")).unionByName(sites.where(way == 1).select(F.concat("site", F.lit("/sitemap_index.xml")).alias("url"), index.alias("body")))
    pages = sites.where(way != 3).select(F.concat("site", F.lit("/sitemap.xml")).alias("url"), F.lit("<html>not found</html>").alias("body"))
    fetched = maps.unionByName(plain).unionByName(roots).unionByName(pages)
    return documents.product_urls(documents.expand_sitemaps(documents.find_sitemaps(robots, fetched), fetched))


@query("""SELECT url AS ref, CASE WHEN url LIKE 'https://%' THEN 'custom' END AS id, CASE WHEN url LIKE 'https://%' THEN regexp_replace(regexp_extract(url, '^https://([^/?#:]+)', 1), '^www\\.', '') END AS label FROM pages
    UNION ALL SELECT 'shop' || s_suppkey, 'shop' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'unknown' || s_suppkey, NULL, NULL FROM supplier""".replace("\\\\", "\\"))
def shop_references(spark, sf_dir):
    """Shops by the id of a known one or by an address that may be fetched; others are none."""
    sup = table(spark, sf_dir, "supplier")
    presets = sup.select(F.concat(F.lit("shop"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("label"), F.lit("https://example.com").alias("site"))
    refs = table(spark, sf_dir, "pages").select(F.col("url").alias("ref")).unionByName(presets.select(F.col("id").alias("ref"))).unionByName(sup.select(F.concat(F.lit("unknown"), F.col("s_suppkey").cast("string")).alias("ref")))
    return web.shop_references(refs, presets).select("ref", "id", "label")


# --- lookups


@query(f"""SELECT code AS barcode, CASE WHEN k % 3 = 0 THEN p_brand || ' ' || p_name ELSE lower(p_brand) || ' cream' END AS name,
    CASE WHEN k % 3 = 0 THEN 'openfoodfacts' ELSE 'openbeautyfacts' END AS source, p_brand AS brand FROM {CODE_SQL} JOIN part ON p_partkey = k WHERE k % 3 = 0 OR k % 2 = 0""")
def open_lookup(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumn("code", gtin())
    k = F.col("p_partkey")
    body = lambda name, brands: F.to_json(F.struct(F.lit(1).alias("status"), F.struct(name.alias("product_name"), brands.alias("brands")).alias("product")))
    food = F.when(k % 3 == 0, body(F.concat(F.lit(" "), "p_name"), F.concat("p_brand", F.lit(" , Other")))).when(k % 3 == 1, F.lit('{"status":0}')).otherwise(F.lit("<html>404</html>"))
    beauty = F.when(k % 2 == 0, body(F.concat(F.lower("p_brand"), F.lit(" cream")), F.col("p_brand"))).otherwise(F.lit('{"status":1,"product":{"product_name":" "}}'))
    answer = lambda db, b: parts.select(F.col("code").alias("barcode"), F.lit(db).alias("db"), b.alias("body"))
    return catalog.open_answers(answer("openbeautyfacts", beauty).unionByName(answer("openfoodfacts", food)))


@query(f"""SELECT r AS request_id, count(DISTINCT code) AS n_codes, CASE WHEN count(DISTINCT code) <= 200 THEN string_agg(DISTINCT code, ',' ORDER BY code) END AS codes,
    CASE WHEN count(DISTINCT code) > 200 THEN 'Too many barcodes (max 200 per request).' END AS error
    FROM (SELECT CASE WHEN l_suppkey % 2 = 0 THEN l_suppkey ELSE -(l_suppkey % 5) END AS r, code FROM lineitem JOIN {CODE_SQL} ON k = l_partkey) GROUP BY r""")
def lookup_requests(spark, sf_dir):
    body = F.concat(F.lit("869"), F.lpad(F.col("l_partkey").cast("string"), 9, "0"))
    asked = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_suppkey") % 2 == 0, F.col("l_suppkey")).otherwise(-(F.col("l_suppkey") % 5)).alias("request_id"), F.concat(F.when(F.col("l_linenumber") == 1, " ").otherwise(""), body, barcodes.check_digit(body)).alias("barcode"))
    return catalog.lookup_input(asked).withColumn("codes", F.array_join("codes", ","))


@query(f"SELECT code AS barcode, CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END AS at, CASE WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN p_name END ELSE p_type END AS name FROM {CODE_SQL} JOIN part ON p_partkey = k")
def answer_upsert(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumn("barcode", gtin())
    k = F.col("p_partkey")
    old = parts.select("barcode", F.lit(1).alias("at"), F.col("p_type").alias("name"))
    return catalog.upsert(old, parts.where(k % 3 == 0).select("barcode", F.lit(2).alias("at"), F.when(k % 2 == 0, F.col("p_name")).alias("name")))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'ocr' WHEN o_orderkey % 2 = 0 THEN 'text' ELSE 'ocr' END AS engine, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 5 <> 0 THEN 7 END WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 7 <> 0 THEN 3 END WHEN o_orderkey % 5 = 0 AND o_orderkey % 7 = 0 THEN NULL ELSE CASE WHEN o_orderkey % 5 <> 0 THEN 7 ELSE 0 END + CASE WHEN o_orderkey % 7 <> 0 THEN 3 ELSE 0 END END AS cost FROM orders")
def engine_costs(spark, sf_dir):
    """Scans go to OCR, all else to text first and to OCR too where that finds no rows; costs of what ran are summed."""
    k = F.col("o_orderkey")
    layer = F.when(k % 3 == 0, False).when(k % 3 == 1, True)
    tried = files.engine_choice(layer, F.when(k % 2 == 0, 5).otherwise(0))
    cost = files.engine_cost(layer, F.when(k % 2 == 0, 5).otherwise(0), F.when(k % 7 != 0, 3), F.when(k % 5 != 0, 7))
    return table(spark, sf_dir, "orders").select("o_orderkey", tried.alias("engine"), cost.alias("cost"))
