"""Product catalogs: merging sources by priority, looking codes up, and filling tables from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemill.functions import barcodes, figures
from tablemill.functions.headings import REGISTRY_TERMS, normalize_heading, normalize_heading_text, pattern
from tablemill.functions.text import SPACE, blank, trim
from tablemill.sources.limits import MAX_LOOKUPS

#: A catalog of fewer bytes by the optimizer's estimate is broadcast by Spark's own threshold; no hint forces it here.
EXTRAS = ("price", "brand", "note")


def _folded(entries: DataFrame, by: list[str]) -> DataFrame:
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return entries.groupBy(*by).agg(F.max_by("name", "seq").alias("name"), F.max_by("source", "seq").alias("source"), *map(last, EXTRAS))


def usable(entries: DataFrame) -> DataFrame:
    """entries(barcode, name, source, price, brand, note, priority, ordinal) with digits, bare and seq; useless ones go.

    Names are trimmed.
    """
    kept = entries.withColumn("digits", barcodes.normalize_barcode("barcode")).withColumn("name", trim("name")).where(F.col("digits").isNotNull() & (F.col("name") != ""))
    return kept.withColumn("price", figures.normalize_price("price")).withColumn("bare", barcodes.bare_code("digits")).withColumn("seq", F.struct("priority", "ordinal"))


def build(entries: DataFrame) -> DataFrame:
    """One entry a code: the last source's name and source, and the last price, brand and note that any source has."""
    return _folded(usable(entries), ["bare"])


def lookup(codes: DataFrame, entries: DataFrame) -> DataFrame:
    """codes(digits, ...) with the entry that its printed form finds, else that of an equal code in another form.

    Two left equi-joins: on the exact digits and on the code without leading zeros. A form that every entry of the code
    is stored under (bare, or padded to 13 or 14) finds the merge of all of them.
    """
    known = usable(entries)
    exact, merged = _folded(known, ["digits"]), _folded(known, ["bare"])
    fields = ["name", "source", *EXTRAS]
    exact = exact.select("digits", F.struct(*fields).alias("exact"))
    merged = merged.select("bare", F.struct(*fields).alias("merged"))
    asked = codes.withColumn("bare", barcodes.bare_code("digits"))
    shared = (F.col("digits") == F.col("bare")) | (F.col("digits") == F.lpad("bare", 13, "0")) | (F.col("digits") == F.lpad("bare", 14, "0"))
    joined = asked.join(exact, "digits", "left").join(merged, "bare", "left")
    hit = F.when(shared, F.col("merged")).otherwise(F.coalesce("exact", "merged"))
    return joined.withColumn("hit", hit).select(*codes.columns, "hit")


def cascade(codes: DataFrame, registry: DataFrame, others: list[DataFrame]) -> DataFrame:
    """codes(digits) named by the registry, by exact digits, and what it doesn't name by each further source in turn."""
    left = codes.select("digits").distinct()
    found = None
    for source in [registry, *others]:
        hits = left.join(source.select("digits", "name", "source"), "digits")
        left = left.join(source.select("digits"), "digits", "left_anti")
        found = hits if found is None else found.unionByName(hits)
    return found


def registry_index(rows: DataFrame) -> DataFrame:
    """rows(barcode, name, is_passive, sheet_ord, row_ord): the first row of each code, active sheets first."""
    read = rows.withColumn("digits", barcodes.normalize_barcode("barcode")).where(F.col("digits").isNotNull() & ~blank("name"))
    first = Window.partitionBy("digits").orderBy("is_passive", "sheet_ord", "row_ord")
    return read.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


#: Rows of a registry's sheet in which its headings are looked for.
HEADING_ROWS = 12


def registry_headings(rows: DataFrame) -> DataFrame:
    """(doc_id, sheet_ord, head, barcode_at, name_at, firm_at, atc_at) of sheets whose headings are found.

    rows(doc_id, sheet_ord, row_ord, cells), row_ord from 0 and titles among the rows. A column is the first cell, row by
    row, that names it; the heading row is the first by which both barcode and name have been named, within the first 12.
    Columns that aren't named by then are null. Only those rows of a sheet are looked at, so one small group a sheet.
    """
    top = rows.where(F.col("row_ord") < HEADING_ROWS).select("doc_id", "sheet_ord", "row_ord", F.posexplode("cells").alias("col_ord", "cell"))
    top = top.withColumn("norm", normalize_heading(F.coalesce("cell", F.lit(""))))
    place = F.struct("row_ord", "col_ord")
    first = {k: F.min(F.when(F.col("norm").rlike(pattern(terms)), place)) for k, terms in REGISTRY_TERMS.items()}
    found = top.groupBy("doc_id", "sheet_ord").agg(*(f.alias(k) for k, f in first.items())).where("barcode is not null and name is not null")
    head = F.greatest("barcode.row_ord", "name.row_ord")
    return found.select("doc_id", "sheet_ord", head.alias("head"), *(F.when(F.col(f"{k}.row_ord") <= head, F.col(f"{k}.col_ord")).alias(f"{k}_at") for k in REGISTRY_TERMS))


def registry_scan(rows: DataFrame, sheets: DataFrame) -> DataFrame:
    """A registry's workbook as catalog entries: (doc_id, digits, name, brand, note), the first row of each code.

    sheets(doc_id, sheet_ord, name); those whose name holds "pasif" come last. Sheets without headings, and rows without a
    readable code or a name, give nothing; white space in names is one space; a blank firm or ATC code is null.
    """
    named = rows.join(registry_headings(rows), ["doc_id", "sheet_ord"]).where("row_ord > head")
    cell = lambda k: F.coalesce(F.get("cells", F.col(f"{k}_at")), F.lit(""))
    filled = lambda k: F.when(trim(cell(k)) != "", trim(cell(k)))
    name = trim(F.regexp_replace(cell("name"), f"{SPACE}+", " "))
    order = sheets.select("doc_id", "sheet_ord", F.col("name").rlike("(?i)pasif").alias("is_passive"))
    read = named.select("doc_id", "sheet_ord", "row_ord", cell("barcode").alias("barcode"), name.alias("name"), filled("firm").alias("brand"), filled("atc").alias("note")).join(order, ["doc_id", "sheet_ord"])
    read = read.withColumn("digits", barcodes.normalize_barcode("barcode")).where(F.col("digits").isNotNull() & (F.col("name") != ""))
    return read.groupBy("doc_id", "digits").agg(F.min_by(F.struct("name", "brand", "note"), F.struct("is_passive", "sheet_ord", "row_ord")).alias("e")).select("doc_id", "digits", "e.*")


#: The open databases, the first to know a code winning.
OPEN_DATABASES = ["openfoodfacts", "openbeautyfacts"]


def open_answers(answers: DataFrame) -> DataFrame:
    """answers(barcode, db, body) as catalog entries (barcode, name, source, brand): the first database that knows a code.

    body is the database's JSON reply; one that is none, isn't of status 1 or has no name answers nothing. The brand is
    the first of its brands; it is put before a name that doesn't begin with it.
    """
    reply = F.from_json("body", "struct<status: double, product: struct<product_name: string, brands: string>>")
    rank = F.array_position(F.array(*map(F.lit, OPEN_DATABASES)), F.col("db"))
    read = answers.where(F.col("db").isin(OPEN_DATABASES)).select("barcode", "db", rank.alias("rank"), reply.alias("r"))
    read = read.where("r.status = 1").select("barcode", "db", "rank", trim("r.product.product_name").alias("bare"), trim(F.split("r.product.brands", ",")[0]).alias("b")).where("bare <> ''")
    brand = F.when(F.col("b") != "", F.col("b"))
    name = F.when(brand.isNotNull() & ~F.startswith(F.lower("bare"), F.lower(brand)), F.concat_ws(" ", brand, "bare")).otherwise(F.col("bare"))
    return read.groupBy("barcode").agg(F.min_by(F.struct(name.alias("name"), F.col("db").alias("source"), brand.alias("brand")), "rank").alias("e")).select("barcode", "e.*")


def lookup_input(asked: DataFrame, limit: int = MAX_LOOKUPS) -> DataFrame:
    """asked(request_id, barcode) as one row a request: its distinct readable codes, or an error where they pass the limit."""
    codes = asked.select("request_id", barcodes.normalize_barcode("barcode").alias("digits")).groupBy("request_id", "digits").count()
    n = F.count("digits")
    # More codes than the limit are counted, not collected.
    place = F.row_number().over(Window.partitionBy("request_id").orderBy(F.col("digits").asc_nulls_last()))
    kept = codes.withColumn("kept", F.when(place <= limit, F.col("digits")))
    some = kept.groupBy("request_id").agg(n.alias("n_codes"), F.array_sort(F.collect_list("kept")).alias("codes"))
    over = F.col("n_codes") > limit
    return some.select("request_id", "n_codes", F.when(~over, F.col("codes")).alias("codes"), F.when(over, F.lit(f"Too many barcodes (max {limit} per request).")).alias("error"))


def upsert(known: DataFrame, answers: DataFrame, capacity: int | None = None) -> DataFrame:
    """Both tables' rows(barcode, at, ...), the one with the latest `at` of each barcode, misses included.

    With a capacity only as many barcodes stay as it says: the least recently answered go.
    """
    both = known.unionByName(answers, allowMissingColumns=True)
    rest = [c for c in both.columns if c != "barcode"]
    last = both.groupBy("barcode").agg(F.max_by(F.struct(*rest), "at").alias("e")).select("barcode", "e.*")
    return last if capacity is None else last.orderBy(F.desc("at"), "barcode").limit(capacity)


def fresh(answers: DataFrame, now: Column, minutes: int, refresh: bool = False) -> DataFrame:
    """The rows of answers(at, ...) that are young enough to be used again; none if all are to be fetched anew."""
    return answers.where(F.lit(not refresh) & (F.col("at") > now - F.make_dt_interval(mins=F.lit(minutes))))


def by_turkish_name(entries: DataFrame) -> DataFrame:
    """entries(name, ...) in Turkish alphabetical order."""
    return entries.orderBy(F.collate("name", "tr_CI"), F.collate("name", "tr"), "barcode")


def untried(codes: DataFrame, tried: DataFrame, limit: int = 200) -> DataFrame:
    """The next codes to ask for: not asked yet, at most `limit`, in order."""
    return codes.select("digits").distinct().join(tried.select("digits"), "digits", "left_anti").orderBy("digits").limit(limit)


def distinct_label(label: str, taken: list[str]) -> str:
    """label, or label (2), (3), ... if a heading like it is there."""
    seen = {normalize_heading_text(t) for t in taken}
    n, out = 1, label
    while normalize_heading_text(out) in seen:
        n += 1
        out = f"{label} ({n})"
    return out


def extra_value(hit: Column, name: str, mark: str) -> Column:
    value = hit[name]
    return F.coalesce(figures.format_price(value, mark) if name == "price" else value, F.lit(""))


def fill(rows: DataFrame, barcode_col: int, entries: DataFrame, name_col: int = -1, extras: tuple[str, ...] = (), mark: str = ".", width: int | None = None) -> tuple[DataFrame, DataFrame]:
    """rows(..., cells) of one shape with names filled from the catalog, and the counts of what was found.

    With a name_col only blank names are filled, else a column is added; extras are further columns. Rows are padded to
    `width` first (by default to the longest), so that added cells stand under their own headings. Counts: rows with a
    code, matched, priced, and codes without a match.
    """
    if width is None:
        width = rows.agg(F.max(F.size("cells"))).first()[0] or 0
    coded = rows.withColumn("digits", barcodes.normalize_barcode(F.coalesce(F.get("cells", F.lit(barcode_col)), F.lit(""))))
    found = lookup(coded, entries)
    filled = _filled(F.lit(width), F.lit(name_col), F.array(*(extra_value(F.col("hit"), e, mark) for e in extras)) if extras else F.array().cast("array<string>"))
    counts = found.agg(*_counts())
    return found.withColumn("cells", filled).drop("digits", "hit"), counts


def _filled(width: Column, name_col: Column, more: Column) -> Column:
    """cells padded, the name put into name_col where that is blank, or behind them if name_col is -1, then the extras."""
    padded = F.concat("cells", F.array_repeat(F.lit(""), F.greatest(F.lit(0), width - F.size("cells"))))
    own = F.transform(padded, lambda c, i: F.when((i == name_col) & blank(c) & F.col("hit").isNotNull(), F.col("hit.name")).otherwise(c))
    named = F.when(name_col >= 0, F.array().cast("array<string>")).otherwise(F.array(F.coalesce("hit.name", F.lit(""))))
    return F.concat(own, named, more)


def _counts() -> list[Column]:
    return [
        F.count("digits").alias("barcode_rows"), F.count("hit").alias("matched"), F.count("hit.price").alias("priced"),
        F.count_distinct(F.when(F.col("hit").isNull(), F.col("digits"))).alias("unmatched"),
    ]


def fill_sheets(rows: DataFrame, sheets: DataFrame, entries: DataFrame, barcode_cols: DataFrame, name_cols: DataFrame | None = None, label: str = "Product name", extras: tuple[tuple[str, str], ...] = (), mark: str = ".") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, sheets, counts): every sheet filled from the catalog by its own shape.

    rows(doc_id, sheet_ord, row_ord, cells), sheets(doc_id, sheet_ord, name, columns), barcode_cols(..., barcode_col),
    name_cols(..., name_col) or None to add a column everywhere. A sheet without a barcode column stays as it is, with no
    counts but barcode_col -1. A sheet without a name column gets one under a label that no heading has; extras are
    (field, label) pairs, a column each where some hit of the sheet has a value. Rows are padded to the sheet's width.
    """
    key = ["doc_id", "sheet_ord"]
    widest = rows.groupBy(*key).agg(F.max(F.size("cells")).alias("widest"))
    shape = sheets.join(barcode_cols.select(*key, "barcode_col"), key, "left").join(widest, key, "left")
    if name_cols is None:
        shape = shape.withColumn("name_col", F.lit(-1))
    else:
        shape = shape.join(name_cols.select(*key, "name_col"), key, "left").withColumn("name_col", F.coalesce("name_col", F.lit(-1)))
    shape = shape.withColumn("barcode_col", F.coalesce("barcode_col", F.lit(-1))).withColumn("width", F.greatest(F.size("columns"), F.coalesce("widest", F.lit(0))))
    has = F.col("barcode_col") >= 0
    coded = rows.join(shape.select(*key, "barcode_col", "name_col", "width"), key)
    cell = F.when(has, F.coalesce(F.get("cells", F.col("barcode_col")), F.lit("")))
    found = lookup(coded.withColumn("digits", barcodes.normalize_barcode(cell)), entries)
    values = [extra_value(F.col("hit"), f, mark) for f, _ in extras]
    counts = found.groupBy(*key).agg(*_counts(), *(F.coalesce(F.bool_or(F.col("hit").isNotNull() & (v != "")), F.lit(False)).alias(f"has_{f}") for (f, _), v in zip(extras, values, strict=True)))
    counts = shape.select(*key, "barcode_col").join(counts, key, "left")
    given = counts.select(*key, *(F.coalesce(f"has_{f}", F.lit(False)).alias(f"has_{f}") for f, _ in extras))
    more = F.array().cast("array<string>")
    for (f, _), v in zip(extras, values, strict=True):
        more = F.concat(more, F.when(F.col(f"has_{f}"), F.array(v)).otherwise(F.array().cast("array<string>")))
    joined = found.join(given, key) if extras else found
    cells = F.when(has, _filled(F.col("width"), F.col("name_col"), more)).otherwise(F.col("cells"))
    out = joined.withColumn("cells", cells).select(*rows.columns)

    @F.udf("array<string>")
    def headed(columns, width, add, *wanted):  # one call a sheet
        out_ = [*columns, *[""] * (width - len(columns))]
        for one, yes in zip([label.strip() or "Product name", *(x for _, x in extras)], [add, *wanted], strict=True):
            if yes:
                out_.append(distinct_label(one, out_))
        return out_

    titled = shape.join(given, key) if extras else shape
    named = F.when(has, headed("columns", "width", F.col("name_col") < 0, *(f"has_{f}" for f, _ in extras))).otherwise(F.col("columns"))
    sizes = [F.coalesce(c, F.lit(0)).alias(c) for c in ("barcode_rows", "matched", "priced", "unmatched")]
    return out, titled.withColumn("columns", named).select(*sheets.columns), counts.select(*key, "barcode_col", *sizes)


def match_stats(rows: DataFrame, entries: DataFrame, barcode_cols: DataFrame, by: list[str], primary: DataFrame | None = None) -> DataFrame:
    """by..., rows, matched, priced, unmatched (distinct codes over all the sheets), has_barcode_column.

    Of the sheets on show: all of rows(doc_id, sheet_ord, cells), or the primary one of each document.
    """
    shown = rows.join(barcode_cols.select("doc_id", "sheet_ord", "barcode_col"), ["doc_id", "sheet_ord"])
    if primary is not None:
        shown = shown.join(primary.select("doc_id", F.col("primary").alias("sheet_ord")), ["doc_id", "sheet_ord"])
    cell = F.when(F.col("barcode_col") >= 0, F.coalesce(F.get("cells", F.col("barcode_col")), F.lit("")))
    found = lookup(shown.withColumn("digits", barcodes.normalize_barcode(cell)), entries)
    counts = [c.alias("rows") if k == 0 else c for k, c in enumerate(_counts())]
    return found.groupBy(*by).agg(*counts, F.bool_or(F.col("barcode_col") >= 0).alias("has_barcode_column"))


def batch_totals(docs: DataFrame) -> DataFrame:
    """docs(cost, n_rows, repaired) in one row: summed cost of those that have one, null if none has; rows; repaired codes."""
    return docs.agg(F.sum("cost").alias("cost"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("repaired"), F.lit(0)).alias("repaired"))


def catalog_sizes(entries: DataFrame) -> DataFrame:
    """(source, n): entries of each source before they are merged, so that repeated codes count."""
    return entries.groupBy("source").agg(F.count("*").alias("n"))
