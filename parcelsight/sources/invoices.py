"""Invoice files of many layouts -> one line schema, in one job."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelsight.functions.classify import add_invoice_category
from parcelsight.functions.scalars import (
    blank_to_null, braced_name, bracketed_skus, clean_name, first_word, lookup, norm_awb,
    norm_header, pick, rounded, text, title_case, to_money, unwrap_formula)
from parcelsight.functions.times import (
    add_month_of_name, date_label, invoice_date, month_key, month_label)
from parcelsight.rules.layouts import (
    AWB_HEADERS, CARRIER_BY_FILE_TOKEN, GENERIC_LAYOUT, INVOICE_LAYOUTS, Layout,
    MASTER_NAME_HEADERS, MASTER_SKU_HEADERS, MASTER_WEIGHT_HEADERS)
from parcelsight.session import sql_literal
from parcelsight.sources.cells import (
    cell, file_of, folder_of, list_files, norm_cells, position)

FIELDS = ["amount", "ex_gst", "awb", "awb_2", "order_id", "weight", "zone", "sku", "name", "label",
          "invoice", "invoice_date", "date", "direction", "courier", "tier"]
#: What a registered mapping calls a field -> the field it fills.
CONFIG_FIELDS = {"amount": "amount", "amount_ex_gst": "ex_gst", "awb": "awb", "order_id": "order_id",
                 "weight_kg": "weight", "zone": "zone", "sku": "sku", "sku_name": "name",
                 "invoice_number": "invoice", "invoice_date": "date"}
#: What all registered mappings have in common; the rest are columns of their table.
CONFIGURED = Layout("configured", scan=15, gst="given_or_strip", needs="id+amount",
                    category="label_is_name", invoice="optional")
#: The order layouts are tried in: built-in ones, registered ones, the generic one.
LAYOUTS = [*INVOICE_LAYOUTS, CONFIGURED, GENERIC_LAYOUT]
_CONFIGURED_AT = len(INVOICE_LAYOUTS)


def config_fields(configs: DataFrame) -> DataFrame:
    """(config, sheet, adds, gst_rate, field, header): a row for each mapped field of each carrier.

    ``configs`` holds carrier, fields (a map), gst_mode, gst_rate and, where mappings are bound to
    one sheet, ``sheet``; a mapping without an amount or without an id is left out.
    """
    sheet = F.col("sheet") if "sheet" in configs.columns else F.lit(None).cast("string")
    rows = configs.select(
        F.col("carrier").alias("config"), F.lower(text(sheet)).alias("sheet"),
        F.lower(F.coalesce("gst_mode", F.lit("included"))).isin("add_18", "ex_gst").alias("adds"),
        F.coalesce(F.nullif("gst_rate", F.lit(0.0)), F.lit(18.0)).alias("gst_rate"),
        F.explode("fields").alias("key", "name")).select(
        "config", "sheet", "adds", "gst_rate",
        lookup("key", CONFIG_FIELDS).alias("field"), norm_header(F.col("name")).alias("header")).where(
        F.col("field").isNotNull() & (F.coalesce("header", F.lit("")) != ""))
    usable = rows.groupBy("config").agg(_has_ids(F.col("field")).alias("usable")).where("usable")
    return rows.join(usable.select("config"), "config", "left_semi")


def _has_ids(field: Column) -> Column:
    """Whether the fields of a group hold an amount, and an AWB or an order id."""
    return (F.max(field == "amount")) & (F.max(field.isin("awb", "order_id")))


def configured_headers(cells: DataFrame, configs: DataFrame) -> DataFrame:
    """(path, layout, config, adds, gst_rate, header_row, _<field>): where a registered mapping fits.

    Relational division: the distinct rows at the heads of files meet the mapped headers by name,
    and a mapping fits where its amount and one of its ids are among them. Neither the mappings
    nor the files pass through the driver, and files that share a header are matched once.
    """
    head = cells.where(F.col("row_no") < CONFIGURED.scan).select(
        "path", "row_no", norm_cells(F.col("cells")).alias("names"))
    known = head.select(F.xxhash64("names").alias("id"), "names").distinct()
    named = known.select("id", "names", F.posexplode("names").alias("pos", "header")).where(
        F.coalesce("header", F.lit("")) != "")
    met = named.join(config_fields(configs), "header")
    fits = met.groupBy("id", "names", "config", "sheet", "adds", "gst_rate").agg(
        _has_ids(F.col("field")).alias("fits"),
        *[F.min(F.when(F.col("field") == f, F.col("pos"))).cast("int").alias(f"_{f}") for f in FIELDS]
    ).where("fits").drop("fits")
    at = head.withColumn("id", F.xxhash64("names")).join(fits, ["id", "names"]).where(
        (F.col("sheet") == "") | F.contains(F.lower(file_of(F.col("path"))), F.col("sheet")))
    places = [f"_{f}" for f in FIELDS]
    return at.groupBy("path", "config", "adds", "gst_rate").agg(
        F.min(F.struct("row_no", *places)).alias("h")).select(
        "path", F.lit(_CONFIGURED_AT).alias("layout"), "config", "adds", "gst_rate",
        F.col("h.row_no").alias("header_row"), *[F.col(f"h.{p}").alias(p) for p in places])


def _is_header(layout: Layout, names: Column) -> Column:
    tests = [F.array_contains(names, h) for h in layout.all_of]
    tests += [reduce(or_, [F.array_contains(names, h) for h in group]) for group in layout.any_of]
    return reduce(and_, tests) & (F.col("row_no") < layout.scan)


def _position_sql(names: list[str]) -> str:
    tries = ", ".join(f"nullif(array_position(names, {sql_literal(n)}), 0)" for n in names)
    return f"CAST(coalesce({tries}) - 1 AS INT)"


def header_rows(cells: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """Candidate (file, layout, config) triples with the position of every field and the facts of the file.

    Only the first rows of each file are looked at. What depends on the file alone (month and
    carrier in its name, invoice number) is worked out here, once per file.
    """
    head = cells.where(F.col("row_no") < 15).withColumn("names", norm_cells(F.col("cells")))
    fits = F.array_compact(F.array(*[F.when(_is_header(l, F.col("names")), F.lit(i))
                                     for i, l in enumerate(LAYOUTS) if l is not CONFIGURED]))
    found = head.select("path", "row_no", "names", F.explode(fits).alias("layout"))
    one = found.groupBy("path", "layout").agg(F.min(F.struct("row_no", "names")).alias("h")).select(
        "path", "layout", F.col("h.row_no").alias("header_row"), F.col("h.names").alias("names"))
    positions = []
    for f in FIELDS:
        branches = " ".join(f"WHEN {i} THEN {_position_sql(l.fields[f])}"
                            for i, l in enumerate(LAYOUTS) if f in l.fields)
        positions.append(F.expr(f"CASE layout {branches} END").alias(f"_{f}"))
    one = one.select("path", "layout", F.lit("").alias("config"), F.lit(False).alias("adds"),
                     F.lit(18.0).alias("gst_rate"), "header_row", *positions)
    if configs is not None:
        one = one.unionByName(configured_headers(cells, configs))
    stem = file_of(F.col("path"))
    numbered = F.coalesce(blank_to_null(F.regexp_extract(stem, r"#\s*([A-Za-z0-9][\w-]*)", 1)),
                          blank_to_null(F.regexp_extract(stem, r"([A-Za-z]{2,}\d[\w-]*)", 1)), stem)
    one = add_month_of_name(one.withColumn("_stem", stem), "_stem", "_name_key", "_name_label")
    files = Window.partitionBy("path")  # the candidate layouts of a file
    return one.select(
        "path", *_CHOICE, "adds", "gst_rate", "header_row", *[f"_{f}" for f in FIELDS], "_stem",
        numbered.alias("_numbered"),
        "_name_key", "_name_label", carrier_from_file(stem).alias("_file_carrier"),
        F.count("*").over(files).alias("_choices"))


def carrier_from_file(name: Column) -> Column:
    low = F.lower(name)
    out = None
    for token, label in CARRIER_BY_FILE_TOKEN:
        out = F.when(low.contains(token), F.lit(label)) if out is None else \
            out.when(low.contains(token), F.lit(label))
    return out.otherwise("Unknown carrier")


def file_months(rows: DataFrame) -> DataFrame:
    """Billing month per file: from its folder, else from its name; one row per path."""
    files = rows.select("path").distinct().withColumns(
        {"_folder": folder_of(F.col("path")), "_file": file_of(F.col("path"))})
    named = add_month_of_name(add_month_of_name(files, "_folder", "_fk", "_fl"), "_file", "_nk", "_nl")
    dated = ~F.col("_fk").startswith("zzzz")
    return named.select("path", F.when(dated, F.col("_fk")).otherwise(F.col("_nk")).alias("file_month"),
                        F.when(dated, F.col("_fl")).otherwise(F.col("_nl")).alias("file_label"))


#: What tells the candidates of a file apart.
_CHOICE = ["layout", "config"]
_FILE_FACTS = ["adds", "gst_rate", "_stem", "_numbered", "_name_key", "_name_label", "_file_carrier"]


def _setting(attribute: str) -> Column:
    """A layout's setting; what registered mappings set themselves comes from their columns."""
    built_in = pick(F.col("layout"), [getattr(l, attribute) for l in LAYOUTS])
    own = F.col("layout") == _CONFIGURED_AT
    if attribute == "gst":
        return F.when(own & F.col("adds"), F.lit("add")).otherwise(built_in)
    if attribute == "gst_rate":
        return F.when(own, F.col("gst_rate")).otherwise(built_in)
    if attribute == "carrier":
        return F.when(own, F.col("config")).otherwise(built_in)
    if attribute == "name":
        return F.when(own, F.concat(F.lit("configured:"), "config")).otherwise(built_in)
    return built_in


def _texts(rows: DataFrame, fields: list[str], *keep: str) -> DataFrame:
    """The chosen fields as trimmed text, spreadsheet formulas unwrapped."""
    wrapped = _setting("formulas")
    return rows.select("path", *_CHOICE, *keep, *[
        F.when(wrapped, unwrap_formula(cell(f"_{f}"))).otherwise(text(cell(f"_{f}"))).alias(f)
        for f in fields])


def _is_line() -> Column:
    """Whether a row is a billed line by its layout's rule; banners and totals are not."""
    needs = _setting("needs")
    amount = to_money(F.col("amount")).isNotNull()
    awb = (F.col("awb") != "") | (F.col("awb_2") != "")
    invoice, order = F.col("invoice") != "", F.col("order_id") != ""
    return (
        F.when(needs == "awb", awb)
        .when(needs == "invoice+any", invoice & (amount | awb))
        .when(needs == "awb+amount+invoice", awb & amount & invoice)
        .when(needs == "id+amount", amount & (awb | order))
        .otherwise(awb & amount)
    )


def _line_counts(rows: DataFrame) -> DataFrame:
    """(path, layout, config, m, lines, n): rows and billed lines by the month of their date."""
    marked = _texts(rows, ["amount", "awb", "awb_2", "order_id", "invoice", "date"]).select(
        "path", *_CHOICE, month_key(invoice_date(F.col("date"))).alias("m"), _is_line().alias("line"))
    return marked.groupBy("path", *_CHOICE, "m").agg(
        F.count_if("line").alias("lines"), F.count("*").alias("n"))


def _file_facts(rows: DataFrame) -> DataFrame:
    """Per file: the first layout that yields lines, and the commonest month of its dates.

    Only files that fit several layouts, or carry no month where their layout needs one, take
    part; everything is counted before it is shuffled.
    """
    by_file = _setting("period") == "file"
    asked = rows.where((F.col("_choices") > 1) | (by_file & F.col("_name_key").startswith("zzzz")))
    per_layout = _line_counts(asked).groupBy("path", *_CHOICE).agg(
        F.sum("lines").alias("lines"),
        F.max(F.when(F.col("m") != "", F.struct("n", "m"))).alias("top"))
    return per_layout.where(F.col("lines") > 0).groupBy("path").agg(
        F.min(F.struct(*_CHOICE, "top")).alias("w")).select(
        "path", F.struct(*[F.col(f"w.{c}") for c in _CHOICE]).alias("_winner"),
        F.col("w.top.m").alias("_modal"))


def _bodies(cells: DataFrame, heads: DataFrame) -> DataFrame:
    """Rows below the header of their file. The heads, a row for a file and layout, are broadcast: rows
    are not shuffled by file, so none of a file's size falls to one task."""
    return cells.join(F.broadcast(heads), "path").where(F.coalesce("row_no", F.lit(1 << 40)) > F.col("header_row"))


def parse_lines(cells: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """Invoice lines of every recognised file, with file, layout and carrier.

    ``configs`` are registered column mappings, tried after the built-in layouts by carrier.

    Header positions, one row per file and layout, and the facts of files are broadcast to the data rows.
    """
    rows = _bodies(cells, header_rows(cells, configs))
    own = F.struct(*_CHOICE)
    chosen = rows.join(F.broadcast(_file_facts(rows)), "path", "left").where(F.coalesce("_winner", own) == own)
    lines = _texts(chosen, FIELDS, *_FILE_FACTS, "_modal").where(_is_line())
    return _typed_lines(lines)


def _typed_lines(lines: DataFrame) -> DataFrame:
    """Typed line values, GST split, service month, invoice number and category."""
    setting = _setting
    gst, period, rule = setting("gst"), setting("period"), setting("invoice")
    mult = 1.0 + setting("gst_rate") / 100.0
    bracketed = setting("bracketed")
    typed = lines.withColumns({
        "_amount": to_money(F.col("amount")), "_ex": to_money(F.col("ex_gst")),
        "_weight": to_money(F.col("weight")), "_day": invoice_date(F.col("date")),
        "_billed": invoice_date(F.col("invoice_date")), "_awb": norm_awb(F.col("awb")),
        "name": F.when(bracketed, braced_name(F.col("name")))
        .otherwise(clean_name(F.regexp_replace("name", ",+$", ""))),
        "sku": F.when(bracketed, bracketed_skus(F.col("name"))).otherwise(F.col("sku")),
        "order_id": F.when(bracketed, F.trim(F.regexp_replace(F.regexp_replace(
            "order_id", "^#+", ""), "_.*$", ""))).otherwise(F.col("order_id")),
        "carrier": F.coalesce(
            F.when(setting("carrier_column"), blank_to_null(first_word(F.col("courier")))),
            setting("carrier"), F.col("_file_carrier")),
    })
    undated = F.col("_name_key").startswith("zzzz") & F.col("_modal").isNotNull()
    modal_day = F.to_date(F.concat("_modal", F.lit("-01")))
    by_file = period == "file"
    by_day = (period == "date") | ((period == "swift") & F.lower("carrier").startswith("swift"))
    tier = F.coalesce(blank_to_null(F.trim(F.regexp_replace("tier", r"(?i)^my\s*\w+\s*-\s*", ""))),
                      F.lit("Prime"))
    dated = typed.withColumns({
        "service_month_key": F.when(by_file, F.when(undated, F.col("_modal"))
                                    .otherwise(F.col("_name_key")))
        .when(by_day, month_key(F.col("_day"))).otherwise(""),
        "service_month": F.when(by_file, F.when(undated, month_label(modal_day))
                                .otherwise(F.col("_name_label")))
        .when(by_day, month_label(F.col("_day"))).otherwise(""),
    })
    out = dated.select(
        "path", *_CHOICE, "carrier", F.when(F.col("_awb") != "", F.col("_awb"))
        .otherwise(norm_awb(F.col("awb_2"))).alias("awb"), "order_id", "sku", "name", "label",
        F.when(setting("grams"), F.when(F.col("_weight") != 0, F.col("_weight") / 1000.0))
        .otherwise(F.col("_weight")).alias("weight_kg"), title_case("zone").alias("zone"),
        F.when(gst == "add", rounded(F.col("_amount") * mult, 2))
        .otherwise(F.coalesce("_amount", F.lit(0.0))).alias("amount"),
        F.when(gst == "add", rounded(F.col("_amount"), 2))
        .when(gst == "given", F.coalesce("_ex", F.lit(0.0)))
        .when(gst == "given_or_strip", F.coalesce("_ex", rounded(F.col("_amount") / mult, 2)))
        .when(gst == "strip", rounded(F.col("_amount") / mult, 2)).alias("amount_ex_gst"),
        F.when(rule == "none", F.lit(""))
        .when(rule == "tier", F.trim(F.concat_ws(" ", tier, "service_month")))
        .when(rule == "period", F.trim(F.concat_ws(" ", "carrier", "service_month")))
        .when(rule == "file", F.col("_numbered")).when(rule == "optional", F.col("invoice"))
        .otherwise(F.coalesce(blank_to_null(F.col("invoice")), F.col("_stem"))).alias("invoice_number"),
        F.when(by_day, date_label(F.coalesce("_billed", "_day"))).otherwise("").alias("invoice_date"),
        "service_month", "service_month_key", F.upper("direction").alias("direction"))
    category = setting("category")
    label = F.when(category == "label", F.col("label")) \
        .when(category == "label_is_name", F.col("name")).otherwise("")
    named = add_invoice_category(out, label, F.col("name"), "_category")
    return named.select(
        "path", setting("name").alias("layout"), "carrier", "awb", "order_id", "sku",
        F.col("name").alias("sku_name"), F.col("name").alias("product"),
        F.when(category == "others", F.lit("Others")).otherwise(F.col("_category")).alias("category"),
        "weight_kg", "zone", "amount", "amount_ex_gst", F.lit(1).cast("bigint").alias("shipments"),
        "invoice_number", "invoice_date", "service_month", "service_month_key", "direction")


def master_rows(cells: DataFrame) -> DataFrame:
    """Item-master rows (sku, awb, category, product, vol_kg) of files that look like one."""
    head = cells.where(F.col("row_no") < 6).withColumn("names", norm_cells(F.col("cells")))
    has_sku = reduce(or_, [F.array_contains("names", h) for h in MASTER_SKU_HEADERS])
    has_awb = reduce(or_, [F.array_contains("names", h) for h in AWB_HEADERS])
    fits = (F.array_contains("names", "category") | has_sku) & (has_awb | has_sku)
    heads = head.where(fits).groupBy("path").agg(F.min(F.struct("row_no", "names")).alias("h")).select(
        "path", F.col("h.row_no").alias("header_row"), *[
            position(F.col("h.names"), names).alias(f"_{f}") for f, names in (
                ("awb", AWB_HEADERS), ("category", ["category"]), ("sub", ["sub_category"]),
                ("sku", MASTER_SKU_HEADERS), ("product", MASTER_NAME_HEADERS),
                ("vol_kg", MASTER_WEIGHT_HEADERS))])
    rows = cells.join(heads, "path").where(
        F.coalesce("row_no", F.lit(1 << 40)) > F.col("header_row"))
    product = F.coalesce(blank_to_null(clean_name(cell("_product"))), clean_name(cell("_sub")))
    return rows.select("path", cell("_sku").alias("sku"), cell("_awb").alias("awb"),
                       cell("_category").alias("category"), product.alias("product"),
                       cell("_vol_kg").alias("vol_kg"))


def route_files(cells: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """Kind of every file: the layout that yields lines, else master, else unrecognised."""
    lines = parse_lines(cells, configs).groupBy("path").agg(
        F.min("layout").alias("layout"), F.count("*").alias("lines"))
    master = master_rows(cells).groupBy("path").agg(F.count("*").alias("master_rows"))
    files = cells.select("path").distinct()
    return files.join(lines, "path", "left").join(master, "path", "left").select(
        "path",
        F.when(F.col("layout").isNotNull(), F.lit("invoice"))
        .when(F.col("master_rows").isNotNull(), F.lit("master")).otherwise("unrecognised").alias("kind"),
        F.coalesce("layout", F.lit("")).alias("layout"),
        F.coalesce("lines", "master_rows", F.lit(0)).cast("bigint").alias("rows"))


def month_buckets(cells: DataFrame) -> DataFrame:
    """Months present among the files with their file counts; dated ones newest first."""
    buckets = file_months(cells).groupBy(F.col("file_month").alias("month"),
                                         F.col("file_label").alias("label")).agg(
        F.count("*").alias("files"))
    return sort_months(buckets)


def sort_months(buckets: DataFrame, month: str = "month") -> DataFrame:
    dated = F.col(month).rlike("^20[0-9]{2}-")
    return buckets.orderBy(dated.desc(), F.when(dated, F.col(month)).desc_nulls_last(), month)


def of_month(spark: SparkSession, folder: str, month: str) -> list[str]:
    """The files billed in one month, by their paths; none is opened."""
    listed = list_files(spark, folder).withColumnRenamed("file", "path")
    return [r["path"] for r in file_months(listed).where(F.col("file_month") == month)
            .select("path").orderBy("path").collect()]


def config_errors(configs: DataFrame, sample: DataFrame | None = None) -> DataFrame:
    """(carrier, error): mappings that cannot work, null where nothing is wrong.

    A mapping must name an amount, and an AWB or an order id; and where the cells of a ``sample``
    are given, it must yield lines from them, whatever other layouts do.
    """
    keyed = configs.select("carrier", F.transform(F.map_entries("fields"), lambda e: F.when(
        F.coalesce(norm_header(e["value"]), F.lit("")) != "", e["key"])).alias("keys"))
    keys = F.coalesce("keys", F.array().cast("array<string>"))
    amount, ids = F.array_contains(F.array_compact(keys), "amount"), F.arrays_overlap(
        F.array_compact(keys), F.array(F.lit("awb"), F.lit("order_id")))
    plain = F.when(~amount, F.lit("no amount column")).when(~ids, F.lit("no AWB or order id column"))
    if sample is None:
        return keyed.select("carrier", plain.alias("error"))
    heads = configured_headers(sample, configs)
    yielding = _line_counts(_bodies(sample, heads)).where("lines > 0").select(
        F.col("config").alias("carrier"), F.lit(True).alias("yields")).distinct()
    return keyed.join(yielding, "carrier", "left").select("carrier", F.coalesce(
        plain, F.when(F.col("yields").isNull(), F.lit("no lines on the sample"))).alias("error"))
