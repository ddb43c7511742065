"""Invoice-side queries: enrichment joins, spend rollups, reconciliation, disputes."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelsight.catalog.check_views import big, div, norm_order, paise, pct, rnd, rupees, statement
from parcelsight.catalog.registry import query
from parcelsight.operators import invoices as I
from parcelsight.operators import lookups as L
from parcelsight.plans import reports
from parcelsight.session import cut_lineage

#: What the product rollup reads of enriched lines.
PRODUCT_READS = ["awb", "sku", "product", "sku_name", "order_key", "order_value", "amount", "shipments",
                 "weight_kg"]


def enriched_once(i, columns: list[str]):
    """Enriched lines, joined once and written out, for operators that read them several times."""
    return cut_lineage(i.settled().enriched.select(*columns), "enriched")


GRAMS = "sum(cast(floor(coalesce(weight_kg, 0) * 1000 + 0.5e0) AS BIGINT))"
PAISE = f"sum({paise('amount')})"
EX_PAISE = f"sum({paise('coalesce(amount_ex_gst, 0)')})"
SHIPS = big("sum(shipments)")
SPEND1, SPEND2 = rnd(rupees(PAISE)), rnd(rupees(PAISE), 2)
AVG = rnd(div(rupees(PAISE), "sum(shipments)"))
PER_KG = rnd(f"CASE WHEN {GRAMS} > 0 THEN {rupees(PAISE)} / ({GRAMS} / 1000.0e0) END")
WEIGHT = rnd(f"(cast({GRAMS} AS DOUBLE) / 1000.0e0)")
SHARE = rnd(f"coalesce({pct(PAISE, f'sum({PAISE}) OVER ()')}, 0)")
CAT = "CASE WHEN category = '' THEN 'Others' ELSE category END"
SKU = "CASE WHEN sku <> '' THEN sku WHEN product <> '' THEN product ELSE '(unmapped)' END"


# --- enrichment joins ----------------------------------------------------------------------

_LINE = "carrier, awb, order_id, amount"


@query("flt_invoice_carrier", statement(f"SELECT {_LINE} FROM lines WHERE carrier = 'Swift'"))
def flt_invoice_carrier(i):
    return I.one_carrier(i.lines, "Swift").select("carrier", "awb", "order_id", "amount")


@query("join_awb_then_order", statement(f"""
SELECT {_LINE}, by_awb OR by_order AS found, m_sku, m_name FROM matched_lines"""))
def join_awb_then_order(i):
    m = L.match_shipments(i.lines, i.facts)
    return m.select("carrier", "awb", "order_id", "amount", F.col("m_product").isNotNull().alias("found"),
                    F.col("m_product.sku").alias("m_sku"), F.col("m_product.item_name").alias("m_name"))


@query("join_attach_products", statement(f"""
SELECT {_LINE}, subcategory, sku, product, sku_name, category, prod_matched FROM attached"""))
def join_attach_products(i):
    return L.attach_products(L.match_shipments(i.lines, i.facts)).select(
        "carrier", "awb", "order_id", "amount", "subcategory", "sku", "product", "sku_name", "category",
        "prod_matched")


@query("join_attach_values", statement(f"SELECT {_LINE}, order_value, order_key FROM attached"))
def join_attach_values(i):
    return L.attach_values(L.match_shipments(i.lines, i.facts)).select(
        "carrier", "awb", "order_id", "amount", "order_value", "order_key")


@query("join_attach_lanes", statement(f"SELECT {_LINE}, pickup_pin, drop_pin FROM attached"))
def join_attach_lanes(i):
    return L.attach_lanes(L.match_shipments(i.lines, i.facts)).select(
        "carrier", "awb", "order_id", "amount", "pickup_pin", "drop_pin")


@query("join_master_enrich", statement(f"SELECT {_LINE}, category, product, sku FROM mastered"))
def join_master_enrich(i):
    return L.enrich_from_master(i.lines, i.master).select(
        "carrier", "awb", "order_id", "amount", "category", "product", "sku")


@query("src_item_master", statement("""
SELECT sku, awb, category, product, sku_key, vol_kg FROM master"""))
def src_item_master(i):
    return i.master.select("sku", "awb", "category", "product", "sku_key", "vol_kg")


_SESSION = "SELECT sku_key, 'Chairs' AS category, product, vol_kg * 2 AS vol_kg FROM master " \
           "WHERE length(sku) % 2 = 0"


def _session_master(i):
    return i.master.where(F.length("sku") % 2 == 0).withColumns(
        {"category": F.lit("Chairs"), "vol_kg": F.col("vol_kg") * 2})


@query("join_master_overlay", statement(f"""
SELECT d.sku_key, CASE WHEN s.sku_key IS NOT NULL THEN s.category ELSE d.category END AS category,
  CASE WHEN s.sku_key IS NOT NULL THEN s.product ELSE d.product END AS product,
  CASE WHEN s.sku_key IS NOT NULL THEN s.vol_kg ELSE d.vol_kg END AS vol_kg
FROM master d LEFT JOIN ({_SESSION}) s USING (sku_key)"""))
def join_master_overlay(i):
    return L.master_overlay(i.master, _session_master(i))


@query("set_master_merge", statement(f"""
SELECT sku_key, arg_max(category, seq) AS category, arg_max(product, seq) AS product,
  arg_max(vol_kg, CASE WHEN vol_kg IS NULL THEN -1 ELSE seq END) AS vol_kg
FROM (SELECT 1 AS seq, sku_key, category, product, vol_kg FROM master
      UNION ALL SELECT 2, * FROM ({_SESSION}) s) u GROUP BY sku_key"""))
def set_master_merge(i):
    fields = ["sku_key", "category", "product", "vol_kg"]
    files = i.master.select(F.lit(1).alias("seq"), *fields).unionByName(
        _session_master(i).select(F.lit(2).alias("seq"), *fields))
    return L.master_merge(files)


@query("join_sku_weights", statement("""
SELECT DISTINCT sku AS sku_text, expected * 1000 AS grams, skus_missing FROM checks_in"""))
def join_sku_weights(i):
    w = L.sku_weights(i.enriched, i.master)
    return w.where(F.col("expected_g").isNotNull()).select(
        "sku_text", F.col("expected_g").cast("double").alias("grams"), "skus_missing")


@query("join_enrich_window", statement("""
SELECT s.awb FROM ships s, (SELECT cast(min(service_month_key) || '-01' AS DATE) - 90 AS lo,
  last_day(cast(max(service_month_key) || '-01' AS DATE)) + 15 AS hi FROM lines
  WHERE carrier = 'Ekart' AND service_month_key BETWEEN '1997-03' AND '1997-05') w
WHERE coalesce(s.order_date, s.pickup_date) BETWEEN w.lo AND w.hi"""))
def join_enrich_window(i):
    billed = i.lines.where((F.col("carrier") == "Ekart")
                           & F.col("service_month_key").between("1997-03", "1997-05"))
    return L.in_enrichment_window(i.facts, billed).select("awb")


@query("set_append_lines", statement("""
SELECT carrier, awb, amount, CASE WHEN carrier = 'Swift' THEN 'late' END AS batch FROM lines
UNION ALL SELECT carrier, awb, amount, 'late' FROM lines WHERE carrier = 'Ekart'""").replace(
    "CASE WHEN carrier = 'Swift' THEN 'late' END", "cast(NULL AS VARCHAR)"))
def set_append_lines(i):
    lines = i.lines.select("carrier", "awb", "amount")
    more = lines.where(F.col("carrier") == "Ekart").withColumn("batch", F.lit("late"))
    return lines.unionByName(more, allowMissingColumns=True)


# --- scalars -------------------------------------------------------------------------------

@query("fn_weight_slab", statement("""
SELECT DISTINCT weight_kg, coalesce((SELECT min(s) FROM o_slabs WHERE weight_kg <= s + 1e-9),
  ceil(weight_kg - 1e-9)) AS slab FROM lines"""))
def fn_weight_slab(i):
    return i.lines.select("weight_kg").distinct().withColumn("slab", I.weight_slab(F.col("weight_kg")))


@query("fn_slab_index", statement("""
SELECT DISTINCT weight_kg, cast(CASE WHEN weight_kg > 10 THEN 6 + ceil(weight_kg - 1e-9) - 10
  ELSE (SELECT min(i) FROM o_slabs WHERE weight_kg <= s + 1e-9) END AS INTEGER) AS ix FROM lines"""))
def fn_slab_index(i):
    kg = i.lines.select("weight_kg").distinct()
    return kg.withColumn("ix", I.slab_index(I.weight_slab(F.col("weight_kg"))))


@query("fn_gst", statement(f"""
SELECT amount, {rnd('(amount * (1.0e0 + 18.0e0 / 100.0e0))', 2)} AS with_gst,
  {rnd('(amount / (1.0e0 + 18.0e0 / 100.0e0))', 2)} AS ex_gst FROM lines"""))
def fn_gst(i):
    return i.lines.select("amount", I.add_gst(F.col("amount")).alias("with_gst"),
                          I.strip_gst(F.col("amount")).alias("ex_gst"))


@query("ing_period_tag", statement(f"SELECT {_LINE}, month, month_label FROM lines"))
def ing_period_tag(i):
    return i.lines.select("carrier", "awb", "order_id", "amount", "month", "month_label")


# --- spend ---------------------------------------------------------------------------------

query("inv_spend_carrier", statement(f"""
SELECT carrier, {SPEND1} AS spend, {SHIPS} AS shipments, {AVG} AS avg_cost, {PER_KG} AS avg_per_kg,
  {WEIGHT} AS weight, {SHARE} AS share FROM lines GROUP BY carrier"""))(
    lambda i: I.spend_by_carrier(i.lines))
query("inv_spend_category", statement(f"""
SELECT {CAT} AS category, {SPEND1} AS spend, {SHIPS} AS shipments, {AVG} AS avg_cost,
  {PER_KG} AS avg_per_kg, {SHARE} AS share, count(DISTINCT {SKU}) AS sku_count
FROM enriched e GROUP BY 1"""))(lambda i: I.spend_by_category(i.enriched))
query("inv_matrix", statement(f"""
SELECT {CAT} AS category, carrier, {SPEND1} AS spend, {SHIPS} AS shipments, {AVG} AS avg_cost
FROM enriched e GROUP BY 1, 2"""))(lambda i: I.category_carrier_matrix(i.enriched))
query("win_top_in_group", statement(f"""
SELECT category, rank, item, {SPEND1} AS spend, {SHIPS} AS shipments, {AVG} AS avg_cost
FROM (SELECT category, item, amount, shipments, dense_rank() OVER (PARTITION BY category
        ORDER BY total DESC, item) AS rank
      FROM (SELECT {CAT} AS category, {SKU} AS item, amount, shipments,
              sum({paise('amount')}) OVER (PARTITION BY {CAT}, {SKU}) AS total FROM enriched e) x) y
WHERE rank <= 8 GROUP BY category, rank, item"""))(lambda i: I.top_skus_by_category(i.enriched))
_BY_SKU = f"""
SELECT {SKU} AS item, coalesce(min(nullif(product, '')), {SKU}) AS name, min(category) AS category,
  {SPEND1} AS spend, {SHIPS} AS shipments, {AVG} AS avg_cost FROM enriched e GROUP BY {SKU}"""
query("inv_spend_sku", statement(_BY_SKU))(lambda i: I.spend_by_sku(i.enriched, top=None))
query("inv_months", statement(f"""
SELECT *, {rnd('((spend - lag(spend) OVER w) / nullif(lag(spend) OVER w, 0) * 100.0e0)')} AS spend_delta,
  {rnd('((avg_cost - lag(avg_cost) OVER w) / nullif(lag(avg_cost) OVER w, 0) * 100.0e0)')} AS avg_delta
FROM (SELECT month, month_label, {SPEND1} AS spend, {SHIPS} AS shipments, {AVG} AS avg_cost
      FROM lines GROUP BY month, month_label) m WINDOW w AS (ORDER BY month)"""))(
    lambda i: I.months(i.lines))
query("win_month_delta", statement(f"""
SELECT month, {rnd('((spend - lag(spend) OVER w) / nullif(lag(spend) OVER w, 0) * 100.0e0)')} AS spend_delta
FROM (SELECT month, {SPEND1} AS spend FROM lines WHERE carrier = 'Swift' GROUP BY month) m
WINDOW w AS (ORDER BY month)"""))(
    lambda i: I.months(I.one_carrier(i.lines, "Swift")).select("month", "spend_delta"))
query("inv_month_parts", statement(f"""
SELECT month, 'carrier' AS part, carrier AS name, {SPEND1} AS spend FROM enriched GROUP BY month, carrier
UNION ALL SELECT month, 'category', {CAT}, {SPEND1} FROM enriched GROUP BY month, {CAT}"""))(
    lambda i: I.month_parts(i.enriched))
query("sort_months", statement("""
SELECT month, count(*) AS lines FROM lines GROUP BY month ORDER BY month DESC"""))(
    lambda i: _sorted_months(i))


def _sorted_months(i):
    from parcelsight.sources.invoices import sort_months
    return sort_months(i.lines.groupBy("month").agg(F.count("*").alias("lines")))


_ADJ = "CASE WHEN length(invoice_number) % 2 = 0 THEN 5.0e0 ELSE 0.0e0 END"


def _recon(adjusted: bool) -> str:
    adj = "CASE WHEN carrier = 'Swift' THEN 5.25e0 ELSE 0.0e0 END" if adjusted else "0.0e0"
    tds = rnd(f"({rupees(EX_PAISE)} * 2.0e0 / 100.0e0)", 2)
    return f"""
SELECT carrier, invoice_number, coalesce(min(nullif(invoice_date, '')), '') AS invoice_date,
  strftime(cast(min(service_month_key) || '-01' AS DATE), '%B %Y') AS service_month, {SHIPS} AS shipments,
  {rupees(PAISE)} AS amount_with_gst, {rupees(EX_PAISE)} AS amount_ex_gst, {tds} AS tds,
  {adj} AS billing_dispute, 0.0e0 AS weight_dispute, 0.0e0 AS billing_cn, 0.0e0 AS weight_cn,
  0.0e0 AS lost_cn, {rnd(f'({rupees(PAISE)} - ({tds} + {adj}))', 2)} AS payable
FROM lines WHERE invoice_number <> '' GROUP BY carrier, invoice_number"""


query("inv_reconciliation", statement(_recon(False)))(lambda i: I.reconciliation(i.lines))


@query("inv_payable", statement(_recon(True)))
def inv_payable(i):
    zero = [F.lit(0.0).alias(k) for k in ("weight_dispute", "billing_cn", "weight_cn", "lost_cn")]
    entered = i.lines.where((F.col("carrier") == "Swift") & (F.col("invoice_number") != "")).select(
        "carrier", "invoice_number").distinct().select(
        "carrier", "invoice_number", F.lit(5.25).alias("billing_dispute"), *zero)
    return I.reconciliation(i.lines, entered)


query("inv_reconciliation_totals", statement(f"""
SELECT count(*) AS invoice_count, {big('sum(shipments)')} AS total_shipments,
  {', '.join(f"{rupees(f'sum({paise(c)})')} AS {a}" for c, a in (
      ('amount_with_gst', 'total_amount'), ('amount_ex_gst', 'total_amount_ex_gst'),
      ('tds', 'total_tds'), ('payable', 'total_payable')))}
FROM ({_recon(False)}) r"""))(lambda i: I.reconciliation_totals(I.reconciliation(i.lines)))

_CTDS = rnd(f"({rupees(PAISE)} * 2.0e0 / 100.0e0)", 2)
_COMPARE = f"""
SELECT carrier, count(DISTINCT nullif(invoice_number, '')) AS invoices, {SHIPS} AS shipments,
  {rupees(PAISE)} AS amount_with_gst, {rupees(EX_PAISE)} AS amount_ex_gst,
  {rnd(div(rupees(PAISE), 'sum(shipments)'), 2)} AS per_parcel, {WEIGHT} AS weight,
  {_CTDS} AS tds_with_gst, {rnd(f'({rupees(PAISE)} - {_CTDS})', 2)} AS payable
FROM lines GROUP BY carrier"""
query("inv_carrier_comparison", statement(_COMPARE))(lambda i: I.carrier_comparison(i.lines))
_MONEY = ["amount_with_gst", "amount_ex_gst", "tds_with_gst", "payable"]
query("inv_carrier_totals", statement(f"""
SELECT {big('sum(invoices)')} AS invoices, {big('sum(shipments)')} AS shipments,
  {', '.join(f"{rupees(f'sum({paise(c)})')} AS {c}" for c in _MONEY)},
  {rnd(div(rupees(f"sum({paise('amount_with_gst')})"), 'sum(shipments)'), 2)} AS per_parcel
FROM ({_COMPARE}) c"""))(lambda i: I.carrier_totals(I.carrier_comparison(i.lines)))
_CM = f"""{rupees(PAISE)} AS amount_with_gst, {SHIPS} AS shipments, {WEIGHT} AS weight,
  {rnd(div(rupees(PAISE), 'sum(shipments)'), 2)} AS per_parcel,
  {rnd(f'CASE WHEN {GRAMS} > 0 THEN {rupees(PAISE)} / ({GRAMS} / 1000.0e0) END', 2)} AS per_kg"""
query("inv_carrier_month", statement(f"""
SELECT carrier, service_month_key AS month, {_CM} FROM lines GROUP BY 1, 2
UNION ALL SELECT '(all)', service_month_key, {_CM} FROM lines GROUP BY 2"""))(
    lambda i: I.carrier_month(i.lines))
query("inv_cost_summary", statement(f"""
SELECT {SPEND1} AS spend, {SHIPS} AS shipments, {AVG} AS avg_cost, {WEIGHT} AS weight,
  {PER_KG} AS avg_per_kg, count(DISTINCT carrier) AS carriers, count(DISTINCT {CAT}) AS categories,
  count(DISTINCT {SKU}) AS skus FROM enriched"""))(lambda i: I.cost_summary(i.settled().enriched))

_SUB = "CASE WHEN subcategory <> '' THEN subcategory WHEN prod_matched THEN 'Other' ELSE 'Unmatched' END"
query("inv_subcategory", statement(f"""
SELECT {_SUB} AS subcategory, {SPEND2} AS spend, {SHIPS} AS shipments, {WEIGHT} AS weight,
  {SHARE} AS share FROM enriched e GROUP BY {_SUB}"""))(lambda i: I.spend_by_subcategory(i.enriched))

_ITEM = "CASE WHEN trim(sku) <> '' THEN upper(trim(sku)) ELSE '(no SKU / unmatched)' END"
_PRODUCT = f"""
SELECT item, coalesce(min(name), item) AS name, {SPEND2} AS spend, {SHIPS} AS shipments,
  {WEIGHT} AS weight, {rupees(f"nullif(sum({paise('once')}), 0)")} AS sell_value, {SHARE} AS share
FROM (SELECT *, CASE WHEN order_key = '' OR row_number() OVER (PARTITION BY order_key, order_value
        ORDER BY awb, {_ITEM}) = 1 THEN coalesce(order_value, 0) ELSE 0 END AS once,
        {_ITEM} AS item, coalesce(nullif(trim(product), ''), nullif(trim(sku_name), '')) AS name
      FROM enriched) e GROUP BY item"""
query("inv_product", statement(_PRODUCT))(lambda i: I.spend_by_product(enriched_once(i, PRODUCT_READS), top=None))
query("topk_products", statement(f"""
SELECT item, name, spend, shipments FROM ({_BY_SKU}) s ORDER BY spend DESC, item LIMIT 500""").replace(
    "ORDER BY spend DESC, item LIMIT", "ORDER BY exact DESC, item LIMIT").replace(
    "SELECT " + "CASE WHEN sku <> ''", f"SELECT {PAISE} AS exact, CASE WHEN sku <> ''", 1))(
    lambda i: I.spend_by_sku(i.enriched, top=500).select("item", "name", "spend", "shipments"))

_MULTI = f"""
SELECT e.awb, e.invoice_number, e.carrier, e.order_id, t.product_count, t.skus, t.names,
  {rnd('weight_kg', 2)} AS weight, {rnd('amount', 2)} AS amount
FROM enriched e JOIN (
  SELECT sku_text, count(DISTINCT token) AS product_count,
    string_agg(token, ', ' ORDER BY pos) AS skus,
    string_agg(coalesce(m.product, token), ', ' ORDER BY pos) AS names
  FROM (SELECT *, instr(upper(sku_text) || ',', token || ',') AS pos FROM sku_tokens) k
  LEFT JOIN m_sku m ON m.sku_key = k.token GROUP BY sku_text HAVING count(*) > 1) t
ON t.sku_text = e.sku"""


def _several(i):
    return I.multi_sku_lines(i.settled().sku_lines, i.master)


query("inv_multi_sku", statement(_MULTI))(lambda i: _several(i))
query("inv_multi_sku_summary", statement(f"""
SELECT count(*) AS multi_awbs, {rupees(f"sum({paise('amount')})")} AS spend,
  {rnd(div('sum(product_count)', 'count(*)'), 2)} AS avg_products, max(product_count) AS max_products
FROM ({_MULTI}) m"""))(lambda i: I.multi_sku_summary(_several(i)))
query("topk_multi_sku", statement(f"""
SELECT * FROM ({_MULTI}) m ORDER BY product_count DESC, amount DESC, awb, order_id LIMIT 1000"""))(
    lambda i: I.top_multi_sku(_several(i)))

_DSUB = "CASE WHEN trim(subcategory) <> '' THEN trim(subcategory) ELSE 'Unmatched' END"
_DISPUTE = f"""
SELECT awb, invoice_number, carrier, sku, {_DSUB} AS subcategory,
  CASE WHEN product <> '' THEN product ELSE sku END AS name, {rnd('weight_kg', 2)} AS charged_kg,
  {rnd('es', 2)} AS expected_kg, {rnd('excess', 2)} AS excess_kg,
  {rnd('overcharge', 2)} AS est_overcharge, skus_missing FROM checks WHERE flagged"""
query("inv_weight_dispute", statement(_DISPUTE))(
    lambda i: I.weight_disputes(_flagged(i)))


def _over(c: str, scale: int, digits: int) -> str:
    whole = f"sum(CASE WHEN flagged THEN cast(floor({c} * {scale} + 0.5e0) AS BIGINT) END)"
    return rnd(f"(cast(coalesce({whole}, 0) AS DOUBLE) / {scale}.0e0)", digits)


def _rollup(key: str, where: str = "") -> str:
    head, group = (f"{key}, ", f"GROUP BY {key.split(' AS ')[0]}") if key else ("", "")
    return f"""
SELECT {head}count(*) AS checked, {big('count_if(flagged)')} AS flagged,
  {_over('weight_kg', 1000, 1)} AS charged_kg, {_over('es', 1000, 1)} AS expected_kg,
  {_over('excess', 1000, 1)} AS excess_kg, {_over('overcharge', 1000000, 2)} AS est_overcharge
FROM checks {where} {group}"""


_INV = "CASE WHEN invoice_number <> '' THEN invoice_number ELSE '(no invoice)' END AS invoice_number"
_DITEM = "CASE WHEN sku <> '' THEN upper(sku) ELSE '(no SKU)' END AS item"


def _checks(i):
    return I.weight_checks(i.settled().sku_lines, i.master)


def _flagged(i):
    return I.flagged_checks(i.settled().sku_lines, i.master, i.settled().facts)


query("inv_dispute_invoice", statement(_rollup(_INV)))(lambda i: I.dispute_rollup(_checks(i), "invoice"))
query("inv_dispute_subcategory", statement(_rollup(f"{_DSUB} AS subcategory", "WHERE flagged")))(
    lambda i: I.dispute_rollup(_flagged(i), "subcategory"))
query("inv_dispute_product", statement(_rollup(_DITEM, "WHERE flagged")))(
    lambda i: I.dispute_rollup(_checks(i), "product"))
query("inv_dispute_rollups", statement(_rollup("")))(lambda i: I.dispute_rollup(_checks(i), "all"))
query("topk_dispute_products", statement(
    f"SELECT * FROM ({_rollup(_DITEM, 'WHERE flagged')}) d ORDER BY est_overcharge DESC, item LIMIT 200"))(
    lambda i: I.top_dispute_products(_checks(i)))
query("topk_dispute_lines", statement(f"""
SELECT * FROM ({_DISPUTE}) d ORDER BY name, excess_kg DESC, awb, carrier, invoice_number,
  est_overcharge DESC, sku LIMIT 10000"""))(lambda i: I.top_disputes(I.weight_disputes(_flagged(i))))

_CELLS = f"""
SELECT pickup_pin, drop_pin, carrier, {SHIPS} AS shipments, {AVG} AS avg_cost, {SPEND1} AS spend
FROM enriched WHERE pickup_pin <> '' AND drop_pin <> '' GROUP BY 1, 2, 3"""
_LANES = f"""
SELECT *, {rnd('((max_avg - min_avg) / nullif(max_avg, 0) * 100.0e0)')} AS save_pct FROM (
  SELECT pickup_pin AS pickup, drop_pin AS drop, concat(pickup_pin, ' → ', drop_pin) AS lane,
    {SHIPS} AS shipments, count(*) AS carrier_count,
    first(carrier ORDER BY avg_cost, carrier) AS cheapest,
    first(carrier ORDER BY avg_cost DESC, carrier DESC) AS priciest,
    min(avg_cost) AS min_avg, max(avg_cost) AS max_avg
  FROM ({_CELLS}) c GROUP BY pickup_pin, drop_pin HAVING count(*) >= 2) l"""
query("inv_lane_cells", statement(_CELLS))(lambda i: I.lane_cells(i.enriched))
query("inv_lane_comparison", statement(_LANES))(lambda i: I.lane_comparison(i.enriched))
query("topk_lanes", statement(
    f"SELECT * FROM ({_LANES}) t ORDER BY shipments DESC, pickup, drop LIMIT 400"))(
    lambda i: I.top_lanes(I.lane_comparison(i.enriched)))

query("sink_invoice_lines", statement(f"""
SELECT awb AS "AWB", invoice_number AS "Invoice Number", service_month_key AS "Service Month",
  carrier AS "Carrier", direction AS "Direction", sku AS "SKU", subcategory AS "Sub-category",
  category AS "Category", CASE WHEN product <> '' THEN product ELSE sku_name END AS "Item Name",
  weight_kg AS "Charged Wt (kg)", {rnd('amount', 2)} AS "Amount with GST",
  {rnd('amount_ex_gst', 2)} AS "Amount ex GST",
  CASE WHEN prod_matched THEN 'yes' ELSE 'no' END AS "Matched" FROM attached"""))(
    lambda i: reports.invoice_export(L.attach_shipments(i.lines, i.facts)))
