"""File-side queries. Their input files are rendered by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelsight.catalog.check_views import VIEWS, big, paise, rnd, rupees, statement
from parcelsight.catalog.registry import Inputs, query
from parcelsight.fixtures import AS_OF
from parcelsight.functions.scalars import cents, rounded, rupees as to_rupees
from parcelsight.operators import shipments as SH
from parcelsight.rules.layouts import SUGGESTED_HEADERS
from parcelsight.rules.shipments import REQUIRED_HEADERS, SHIPMENT_HEADERS
from parcelsight.session import shared_folder
from parcelsight.sources import cells as CE
from parcelsight.sources import invoices as SI
from parcelsight.sources import shipments as SRC

VIEWS["bill"] = """
SELECT split_part(path, '/', 2) AS m, upper(coalesce(nullif(awb, ''), substr(order_id, 2))) AS id,
  amount, amount_ex_gst AS ex, weight_kg, sku, product, zone, order_id, invoice_number
FROM invoice_raw"""


def bill(i: Inputs) -> DataFrame:
    """Billed lines as text, the material every layout is rendered from."""
    raw = i.fx.invoice_raw
    ident = F.upper(F.coalesce(F.nullif("awb", F.lit("")), F.substring("order_id", 2, 99)))
    return raw.select(
        F.split("path", "/")[1].alias("m"), ident.alias("id"),
        F.format_number("amount", 2).alias("amount"), F.format_number("amount_ex_gst", 2).alias("ex"),
        F.col("weight_kg").cast("string").alias("kg"), (F.col("weight_kg") * 1000).cast("string").alias("g"),
        "sku", "product", "zone", "order_id", "invoice_number",
        F.concat(F.split("path", "/")[1], F.lit("-15 10:30:00")).alias("day"))


# Layout -> (file name, header -> column or quoted constant), in shuffled column order.
RENDERED = {
    "shadowfax": ("bill.csv", {
        "Zone": "zone", "AWB_Number": "id", "Client_Name": "'My Shop - Prime Large'",
        "Product_Cat": "''", "Total_Charges (₹)": "amount", "picked_date": "day",
        "product_desc": "product", "client_order_id": "order_id", "Weight (kg)": "kg"}),
    "bluedart_b2c": ("RISK dump.csv", {
        "DINVDATE": "day", "CAWBNO": "id", "NET": "amount", "TOTAL": "ex",
        "CINVOICENBR": "invoice_number", "NCHRGWT": "kg", "Fwd/Reverse": "'fwd'"}),
    "bluedart_b2b": ("bd b2b.csv", {
        "SKUs": "sku", "AWB No.": "id", "Sub_Cat": "product", "NET (incl GST)": "amount",
        "NCHRGWT": "kg", "Zone": "zone"}),
    "skyair": ("bill.csv", {
        "City": "zone", "AWB": "id", "Pickup Date": "day", "Round Weight": "kg",
        "SKU Name": "product", "SKU Code": "sku", "Before Tax": "ex", "Total": "amount"}),
    "swift": ("Swift Invoice #SWT26001442 Details.csv", {
        "Swift Id": "id", "AWB": "''", "Cost": "amount", "Weight (in gms)": "g",
        "Weight": "g", "Billing Date": "day", "Direction": "'forward'", "Order Number": "order_id",
        "Product Description": "concat('[', lower(sku), '] {', product, '} 1')", "Zone": "zone"}),
    "delhivery": ("dlv.csv", {
        "zone": "zone", "waybill_num": "concat('=\"', id, '\"')",
        "total_amount": "amount", "gross_amount": "ex",
        "serial_number": "concat('=\"', invoice_number, '\"')", "pickup_date": "day",
        "charged_weight": "g", "order_id": "order_id", "item_shipped": "concat(product, ',')"}),
    "elasticrun": ("data.csv", {
        "state": "zone", "transaction_id": "id", "client_invoice_number": "invoice_number",
        "client_invoice_date": "day", "work_complete_time": "day", "chargeable_weight": "kg",
        "total_charge": "amount"}),
    "safexpress": ("data.csv", {
        "Waybill Destination": "zone", "Bill Number": "invoice_number", "Waybill Number": "id",
        "Pickup Date": "day", "Charge Weight": "kg", "Total Freight": "ex", "Grand Total": "amount"}),
    "urbanbolt": ("data.csv", {
        "Lane / Zone": "zone", "AWB No": "id", "Shipment Date": "day", "Chg. Weight": "kg",
        "Freight Subtotal": "ex", "Total Amount": "amount"}),
    "generic": ("ekart working.csv", {
        "Zone": "zone", "Invoice Amt (₹)": "amount", "Order ID": "order_id", "SKU Code": "sku",
        "Product Name": "product", "Weight": "kg"}),
    "configured": ("acme.csv", {
        "Lane": "zone", "Charge": "amount", "Docket": "id", "Kilos": "kg", "Bill": "invoice_number",
        "Shipped": "day"}),
}


def rendered(i: Inputs, layout: str, root: str | None = None) -> DataFrame:
    """Cells of one file per billing month: banner, header, lines, a blank and a total row."""
    name, columns = RENDERED[layout]
    base = bill(i)
    path = F.concat(F.lit(f"/in/{root or layout}/"), F.col("m"), F.lit(f"/{name}"))
    body = base.select(path.alias("path"), F.lit(None).cast("bigint").alias("row_no"),
                       F.array(*[F.expr(e) for e in columns.values()]).alias("cells"))
    width = len(columns)

    def fixed(row_no: int, values: list) -> F.Column:
        padded = [F.lit(v).cast("string") for v in (values + [None] * width)[:width]]
        return F.struct(F.lit(row_no).cast("bigint").alias("row_no"), F.array(*padded).alias("cells"))

    frame = base.select("m").distinct().select(path.alias("path"), F.inline(F.array(
        fixed(0, ["Billing statement", "confidential"]), fixed(1, list(columns)),
        fixed(3, [""] * width), fixed(4, ["Total"]))))
    return body.unionByName(frame)


def _month(m: str) -> str:
    return f"strftime(cast({m} || '-01' AS DATE), '%B %Y')"


_MULT = "(1.0e0 + 18.0e0 / 100.0e0)"
_ADDED, _STRIPPED = rnd(f"(amount * {_MULT})", 2), rnd(f"(amount / {_MULT})", 2)
_NAMED = "coalesce(c.category, 'Others')"
_CATEGORY = """LEFT JOIN (SELECT n.product, arg_min(r.category, r.ix) AS category
  FROM (SELECT DISTINCT product FROM bill) n
  JOIN o_inv_rules r ON contains(lower(n.product), r.kw) GROUP BY n.product) c USING (product)"""


def ing(name: str, carrier: str, *, amount="amount", ex="ex", weight="weight_kg", order="''", sku="''",
        product="''", category="'Others'", zone="zone", invoice="invoice_number", month="m", where="true",
        direction="''", awb="id"):
    """Register a layout with the line values its rendering must give back."""
    sql = statement(f"""
SELECT '{carrier}' AS carrier, {awb} AS awb, {order} AS order_id, {sku} AS sku, {product} AS product,
  {category} AS category, {weight} AS weight_kg, {zone} AS zone, {amount} AS amount,
  cast({ex} AS DOUBLE) AS amount_ex_gst, {invoice} AS invoice_number,
  {month} AS service_month_key, {direction} AS direction
FROM bill {_CATEGORY} WHERE {where}""")

    @query(f"ing_{name}", sql)
    def run(i):
        return lines_of(SI.parse_lines(rendered(i, name)))
    return run


def lines_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("carrier", "awb", "order_id", "sku", "product", "category", "weight_kg", "zone",
                         "amount", "amount_ex_gst", "invoice_number", "service_month_key", "direction")


_GRAMS = "(weight_kg * 1000) / 1000.0e0"
_OWN = "CASE WHEN invoice_number <> '' THEN invoice_number ELSE '{}' END"
ing("shadowfax", "Shadowfax", amount=_ADDED, ex="amount", order="order_id", product="product",
    category=_NAMED, invoice=f"'Prime Large ' || {_month('m')}")
ing("bluedart_b2c", "BlueDart", zone="''", where="invoice_number <> ''", direction="'FWD'")
ing("bluedart_b2b", "BlueDart", ex="NULL", sku="sku", product="product", category=_NAMED,
    invoice="''", month="''")
ing("skyair", "SkyAir", sku="sku", product="product", category=_NAMED,
    invoice=f"'SkyAir ' || {_month('m')}")
ing("swift", "Swift", ex=_STRIPPED, weight=_GRAMS, product="product", direction="'FORWARD'",
    order="upper(split_part(substr(order_id, 2), '_', 1))",
    sku="CASE WHEN sku = '' THEN '' ELSE upper(sku) END", invoice="'SWT26001442'")
ing("delhivery", "Delhivery", weight=_GRAMS, order="order_id", product="product",
    invoice=_OWN.format("dlv.csv"))
ing("elasticrun", "ElasticRun", amount=_ADDED, ex="amount", where="invoice_number <> ''")
ing("safexpress", "Safexpress", invoice=_OWN.format("data.csv"))
ing("urbanbolt", "Urban Bolt", invoice=f"'Urban Bolt ' || {_month('m')}")
ing("generic", "Ekart", awb="''", ex="NULL", order="order_id", sku="sku", product="product",
    category=_NAMED, invoice="''", month="''", where="order_id <> ''")


def configs(i: Inputs) -> DataFrame:
    """Carrier mappings named after all suppliers: the first fits its file, others lack an id, every
    seventh is bound to a sheet that isn't there, every eleventh has other headers."""
    fields = F.create_map(*[F.lit(v) for pair in (
        ("amount", "Charge (₹)"), ("awb", "Docket"), ("weight_kg", "Kilos"), ("zone", "Lane"),
        ("invoice_number", "Bill"), ("invoice_date", "Shipped")) for v in pair])
    broken = F.create_map(F.lit("amount"), F.lit("Charge"), F.lit("awb"), F.lit(" (x) "))
    other = F.create_map(F.lit("amount"), F.lit("Fee"), F.lit("order_id"), F.lit("Docket"))
    key = F.col("s_suppkey")
    return i.fx.table("supplier").select(
        F.col("s_name").alias("carrier"), F.when(key % 7 == 0, fields).when(key % 11 == 0, other)
        .otherwise(broken).alias("fields"), F.lit("included").alias("gst_mode"), F.lit(18.0).alias("gst_rate"),
        F.when((key % 7 == 0) & (key > 0), F.lit("Sheet 9")).alias("sheet"))


@query("ing_configured", statement("""
SELECT (SELECT s_name FROM supplier WHERE s_suppkey = 0) AS carrier, id AS awb, '' AS order_id,
  '' AS sku, '' AS product, 'Others' AS category, weight_kg, zone, amount,
  """ + _STRIPPED + """ AS amount_ex_gst, invoice_number, m AS service_month_key, '' AS direction
FROM bill"""))
def ing_configured(i):
    return lines_of(SI.parse_lines(rendered(i, "configured"), configs(i)))


@query("ing_validate_config", statement("""
SELECT s_name AS carrier, CASE WHEN s_suppkey = 0 THEN NULL
  WHEN s_suppkey % 7 = 0 OR s_suppkey % 11 = 0 THEN 'no lines on the sample'
  ELSE 'no AWB or order id column' END AS error
FROM supplier"""))
def ing_validate_config(i):
    return SI.config_errors(configs(i), rendered(i, "configured"))


@query("src_carrier_configs", statement("""
SELECT s_name AS carrier, CASE WHEN s_suppkey % 2 = 0 THEN 'add_18' ELSE 'included' END AS gst_mode,
  CASE WHEN s_suppkey % 2 = 0 THEN 12.0e0 ELSE 18.0e0 END AS gst_rate
FROM supplier"""))
def src_carrier_configs(i):
    local = configs(i)
    even = F.substring("carrier", -1, 1).cast("int") % 2 == 0
    shared = local.where(even).withColumns({"gst_mode": F.lit("add_18"), "gst_rate": F.lit(12.0)})
    return SRC.config_overlay(local, shared).select("carrier", "gst_mode", "gst_rate")


@query("set_sheet_union", statement("""
SELECT carrier, amount FROM (SELECT 'BlueDart' AS carrier, amount FROM bill WHERE invoice_number <> ''
  UNION ALL SELECT 'BlueDart', amount FROM bill WHERE invoice_number <> '') u"""))
def set_sheet_union(i):
    both = rendered(i, "bluedart_b2c", "sheet1").unionByName(rendered(i, "bluedart_b2c", "sheet2"))
    return SI.parse_lines(both).select("carrier", "amount")


@query("fn_carrier_from_name", statement("""
SELECT DISTINCT carrier AS name, CASE carrier WHEN 'Blue Dart' THEN 'BlueDart'
  WHEN 'Elastic Express' THEN 'ElasticRun' WHEN 'Swift' THEN 'Swift' WHEN 'Ekart' THEN 'Ekart'
  WHEN 'Delhivery' THEN 'Delhivery' ELSE 'Unknown carrier' END AS label FROM invoice_raw"""))
def fn_carrier_from_name(i):
    names = i.fx.invoice_raw.select(F.col("carrier").alias("name")).distinct()
    return names.select("name", SI.carrier_from_file(F.concat(F.upper("name"), F.lit(" May.xlsx")))
                        .alias("label"))


@query("fn_billing_month", statement("""
SELECT DISTINCT '/in/urbanbolt/' || m || '/data.csv' AS path, m AS service_month_key FROM bill"""))
def fn_billing_month(i):
    return SI.parse_lines(rendered(i, "urbanbolt")).select("path", "service_month_key").distinct()


@query("inv_file_summary", statement(f"""
SELECT '/in/safexpress/' || m || '/data.csv' AS path, 'Safexpress' AS carrier, count(*) AS lines,
  {rnd(rupees(f"sum({paise('amount')})"))} AS spend, {_month('m')} AS month
FROM bill GROUP BY m"""))
def inv_file_summary(i):
    lines = SI.parse_lines(rendered(i, "safexpress"))
    files = lines.groupBy("path").agg(
        F.min("carrier").alias("carrier"), F.count("*").alias("lines"),
        rounded(to_rupees(F.sum(cents(F.col("amount"))))).alias("spend"))
    months = SI.file_months(files).select("path", F.col("file_label").alias("month"))
    return files.join(months, "path")


def _mixed(i: Inputs) -> DataFrame:
    """Files of several kinds: two layouts, an item master and one nobody recognises."""
    master = i.fx.item_master_raw.select(
        F.lit("/in/ref/items.csv").alias("path"), F.lit(None).cast("bigint").alias("row_no"),
        F.array("sku", "category", "product", "vol_kg").alias("cells"))
    head = i.fx.item_master_raw.limit(1).select(
        F.lit("/in/ref/items.csv").alias("path"), F.lit(0).cast("bigint").alias("row_no"),
        F.array(F.lit("SKU Code"), F.lit("Category"), F.lit("Product Name"), F.lit("Vol. Weight (kg)"))
        .alias("cells"))
    other = i.fx.item_master_raw.select(
        F.lit("/in/ref/notes.csv").alias("path"), F.lit(None).cast("bigint").alias("row_no"),
        F.array("product").alias("cells"))
    return rendered(i, "urbanbolt").unionByName(rendered(i, "delhivery")) \
        .unionByName(master).unionByName(head).unionByName(other)


@query("src_route_kind", statement(f"""
SELECT '/in/urbanbolt/' || m || '/data.csv' AS path, 'invoice' AS kind, 'urbanbolt' AS layout,
  count(*) AS rows FROM bill GROUP BY m
UNION ALL SELECT '/in/delhivery/' || m || '/dlv.csv', 'invoice', 'delhivery', count(*) FROM bill GROUP BY m
UNION ALL SELECT '/in/ref/items.csv', 'master', '', count(*) FROM item_master_raw
UNION ALL SELECT '/in/ref/notes.csv', 'unrecognised', '', 0"""))
def src_route_kind(i):
    return SI.route_files(_mixed(i))


# --- files written to and read back from the shared folder ---------------------------------

_HEADERS = {f: names[-1] for f, names in SHIPMENT_HEADERS.items()}


#: Rows of an export: packed files, and those whose cells hold line breaks, can't be split.
EXPORT_ROWS = 100_000


def _delimited(df: DataFrame, path: str, sep: str, encoding: str = "UTF-8") -> None:
    df.write.option("maxRecordsPerFile", EXPORT_ROWS).csv(
        path, header=True, sep=sep, encoding=encoding, escape='"', compression="gzip")


def shipment_files(i: Inputs) -> str:
    """Shipment exports of several dialects in one folder of the shared one, packed.

    A semicolon export of 200 columns in Latin-1, a tab one whose header and items hold line
    breaks, a comma one with the columns reversed; beside them files that give no rows.
    """
    folder = shared_folder(i.spark, "shipments")
    stamps = ("pickup_ts", "order_ts", "delivery_ts", "ofd1_ts")
    text = i.settled().raw.select(*[
        (F.date_format(f, "yyyy-MM-dd HH:mm:ss") if f in stamps else F.col(f).cast("string")).alias(f)
        for f in SHIPMENT_HEADERS])
    named = lambda rows, fields: rows.select(*[F.col(f).alias(_HEADERS[f]) for f in fields])
    cod, prepaid = text.where(F.col("payment") == "cod"), text.where(F.col("payment") == "PREPAID")
    odd = F.pmod(F.xxhash64("awb"), F.lit(2)) == 1
    filler = [F.lit("é").alias(f"spare {k}") for k in range(200 - len(SHIPMENT_HEADERS))]
    _delimited(named(cod.where(odd), SHIPMENT_HEADERS).select(*filler, "*"), f"{folder}/wide", ";",
               "ISO-8859-1")
    _delimited(named(cod.where(~odd), SHIPMENT_HEADERS).select(
        F.concat(F.lit("held,\n"), F.lit('as "is"; so')).alias("remarks of\nthe; hub"), "*"),
        f"{folder}/breaks", "\t")
    _delimited(named(prepaid, list(reversed(SHIPMENT_HEADERS))), f"{folder}/plain", ",")
    _delimited(named(cod.limit(3), ["awb", "status"]), f"{folder}/lacking", "|")
    i.spark.range(1).coalesce(1).select(F.lit("<html><body>no table</body></html>")).write.csv(
        f"{folder}/page", quote="")
    return folder


@query("src_shipment_csv", statement("""
SELECT awb, carrier, account, payment, pickup_pin, drop_pin, weight, attempts, order_value, status,
  item_name, order_ts, pickup_ts, delivery_ts, o2s_us, p2d_us FROM facts"""))
def src_shipment_csv(i):
    raw = SRC.read_shipment_files(i.spark, shipment_files(i))
    return SH.shipment_facts(raw, AS_OF).select(
        "awb", "carrier", "account", "payment", "pickup_pin", "drop_pin", "weight", "attempts",
        "order_value", "status", "item_name", "order_ts", "pickup_ts", "delivery_ts", "o2s_us", "p2d_us")


@query("src_resolve_columns", statement("""
SELECT awb, trim(carrier) AS carrier, sku, status FROM shipments_raw WHERE trim(carrier) <> ''"""))
def src_resolve_columns(i):
    wanted = {f: SHIPMENT_HEADERS[f] for f in ("awb", "carrier", "sku", "status", "zone")}
    out = CE.read_fields(i.spark, shipment_files(i), wanted, REQUIRED_HEADERS)
    return out.where(F.col("carrier").isNotNull()).select("awb", "carrier", "sku", "status")


@query("src_file_problems", """
SELECT * FROM (VALUES ('lacking', 'missing required column(s): carrier'),
  ('page', 'looks like HTML or XML')) AS t(folder, problem)""")
def src_file_problems(i):
    """Every file that gives no rows, with the reason."""
    found = CE.file_problems(i.spark, shipment_files(i), SHIPMENT_HEADERS, REQUIRED_HEADERS)
    return found.select(CE.folder_of(F.col("file")).alias("folder"), "problem").distinct()


def invoice_files(i: Inputs) -> str:
    """Safexpress bills as one text file set per month folder, of three dialects by turns."""
    folder = shared_folder(i.spark, "invoices")
    name, columns = RENDERED["safexpress"]
    b = bill(i).select(F.col("m").alias("folder"), *[F.expr(e).alias(h) for h, e in columns.items()])
    turn = F.substring("folder", -1, 1).cast("int") % 3
    for k, sep in enumerate((",", "\t", ";")):
        b.where(turn == k).repartition("folder").write.mode("append").partitionBy("folder").csv(
            folder, header=True, sep=sep)
    return folder


@query("src_invoice_files", statement("""
SELECT 'folder=' || m AS folder, count(*) AS lines FROM bill GROUP BY m"""))
def src_invoice_files(i):
    lines = SI.parse_lines(CE.read_cells(i.spark, invoice_files(i)))
    return lines.groupBy(CE.folder_of(F.col("path")).alias("folder")).agg(F.count("*").alias("lines"))


@query("src_month_partition", statement("""
SELECT id AS awb, amount FROM bill WHERE m = (SELECT max(m) FROM bill WHERE m < '2018')"""))
def src_month_partition(i):
    files = SI.of_month(i.spark, invoice_files(i), "2017-12")
    return SI.parse_lines(CE.read_cells(i.spark, files)).select("awb", "amount")


@query("src_month_buckets", statement("""
SELECT m AS month, strftime(cast(m || '-01' AS DATE), '%B %Y') AS label, count(DISTINCT m) AS files
FROM bill GROUP BY m"""))
def src_month_buckets(i):
    return SI.month_buckets(rendered(i, "safexpress"))


_PROFILED = [("Lane", "zone"), ("Charge", "printf('%,.2f', amount)"), ("Docket", "id"),
             ("Kilos", "cast(weight_kg AS VARCHAR)"), ("Bill", "invoice_number"),
             ("Shipped", "m || '-15 10:30:00'")]
_SUGGESTED = {"Lane": "", "Charge": "", "Docket": "", "Kilos": "", "Bill": "", "Shipped": ""}


@query("src_column_profile", statement("""
SELECT '/in/configured/' || m || '/acme.csv' AS path, 1::BIGINT AS header_row, pos::INT AS pos, name,
  count(*) AS filled, string_agg(value, ' | ' ORDER BY nth) FILTER (nth <= 3) AS samples, suggested
FROM (SELECT m, pos, name, suggested, value, row_number() OVER (PARTITION BY m, pos ORDER BY value) AS nth
  FROM (""" + " UNION ALL ".join(
    f"SELECT m, {k} AS pos, '{name}' AS name, '{_SUGGESTED[name]}' AS suggested, {expr} AS value FROM bill"
    for k, (name, expr) in enumerate(_PROFILED)) + """
    UNION ALL SELECT DISTINCT m, 0, 'Lane', '""" + _SUGGESTED["Lane"] + """', 'Total' FROM bill) u
  WHERE value <> '') v
GROUP BY m, pos, name, suggested"""))
def src_column_profile(i):
    cells = rendered(i, "configured")
    # rows after the header come without a number, the total among them
    plain = cells.withColumn("row_no", F.when(F.col("row_no") < 2, F.col("row_no")))
    return CE.column_profile(plain, SUGGESTED_HEADERS)


@query("src_sla_rows", statement("""
SELECT CASE WHEN trim(origin_pin) = '' THEN 'ANY' ELSE origin_pin END AS origin_pin, pincode, tat
FROM sla_overrides_raw"""))
def src_sla_rows(i):
    folder = shared_folder(i.spark, "sla")
    i.fx.sla_overrides_raw.select(
        F.col("tat").alias("SLA (days)"), F.col("pincode").alias("Drop Pincode"),
        F.col("origin_pin").alias("Warehouse Pincode")).write.csv(folder, header=True, sep="\t")
    cells = CE.read_cells(i.spark, folder)
    return SRC.sla_rows(cells).select("origin_pin", "pincode", "tat")


@query("src_sla_lookup", statement("""
SELECT rule, tier, warehouse, drop_pin, tat FROM sla_lanes WHERE tier <> 'city'"""))
def src_sla_lookup(i):
    """Nested lookup documents written as JSON and read back as lane rows."""
    folder = shared_folder(i.spark, "lookup")
    lanes = i.fx.sla_lanes.where(F.col("tier") != "city")
    hub = F.coalesce("warehouse", F.lit("*"))
    pins = lanes.groupBy("rule", "tier", hub.alias("hub"), F.substring("drop_pin", 1, 3).alias("area")) \
        .agg(F.map_from_entries(F.collect_list(F.struct("drop_pin", "tat"))).alias("pins"))
    pins.select("rule", "tier", F.create_map("hub", "pins").alias("lookup")).write.json(folder)
    docs = i.spark.read.schema(
        "rule string, tier string, lookup map<string,map<string,double>>").json(folder)
    return SRC.sla_lookup(docs)
