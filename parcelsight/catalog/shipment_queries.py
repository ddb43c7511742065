"""Shipment-side queries: scalars, filters, SLA, joins, KPIs, revenue, report parts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from parcelsight.catalog.check_views import (
    VIEWS, big, div, kpi, mean_hours, norm_order, paise, pct, rnd, rupees, scored, statement)
from parcelsight.catalog.registry import query
from parcelsight.fixtures import AS_OF
from parcelsight.functions import classify as C
from parcelsight.functions import scalars as N
from parcelsight.functions import times as T
from parcelsight.operators import common, filters as FL
from parcelsight.operators import kpi as K
from parcelsight.operators import lookups as L
from parcelsight.operators import orders as O
from parcelsight.operators import revenue as R
from parcelsight.operators import sla
from parcelsight.operators.filters import Filters
from parcelsight.plans import reports
from parcelsight.rules import shipments as S
from parcelsight.rules.sla import SLA_RULES
from parcelsight.sources import shipments as SRC
from parcelsight.sources.windows import Window, window_date

DAY = date.fromisoformat(AS_OF[:10])


def simple(name: str, source: str, columns: str, where: str = "", rename: dict | None = None):
    """A projection of ready columns checked against the same columns of a check view."""
    view = {"facts": "facts", "ships": "ships", "classified": "classified"}[source]
    clause = f" WHERE {where}" if where else ""

    @query(name, statement(f"SELECT {columns} FROM {view}{clause}"))
    def run(i):
        return getattr(i, source)
    return run


def project(name: str, source: str, *columns: str):
    """Register a column projection of the records."""
    @query(name, statement(f"SELECT {', '.join(columns)} FROM {source}"))
    def run(i):
        return getattr(i, source).select(*columns)
    return run


# --- scalars and row classification -------------------------------------------------------

@query("fn_parse_ts", statement("""
SELECT awb, order_ts AS iso, date_trunc('minute', pickup_ts) AS us, order_ts AS short_us,
  order_ts AS serial FROM facts WHERE pickup_ts IS NOT NULL AND order_ts IS NOT NULL"""))
def fn_parse_ts(i):
    f = i.facts.where(F.col("pickup_ts").isNotNull() & F.col("order_ts").isNotNull())
    day = F.date_diff(F.col("order_ts").cast("date"), F.lit(date(1899, 12, 30)))
    texts = f.select("awb", F.date_format("order_ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"),
                     F.date_format("pickup_ts", "M/d/yyyy H:mm").alias("us"),
                     F.date_format("order_ts", "M/d/yy").alias("short_us"),
                     day.cast("double").alias("serial"))
    kinds = {c.name: c.dataType for c in texts.schema.fields}
    return texts.select("awb", *[T.to_ts(F.col(c), kinds[c]).alias(c)
                                 for c in ("iso", "us", "short_us", "serial")])


@query("fn_hours_between", statement("""
SELECT awb, o2s_us / 3.6e9 AS o2s, p2o_us / 3.6e9 AS p2o, p2d_us / 3.6e9 AS p2d FROM facts"""))
def fn_hours_between(i):
    return i.facts.select("awb", "o2s", "p2o", "p2d")


project("fn_day_diffs", "facts", "awb", "transit_days", "age_days", "ofd1_days", "edd_days")
project("fn_norm_pincode", "facts", "awb", "pickup_pin", "drop_pin")


@query("fn_to_float", statement("""
SELECT awb, weight AS plain, CAST(NULL AS DOUBLE) AS unit, order_value AS spaced FROM facts"""))
def fn_to_float(i):
    f = i.facts
    return f.select("awb", N.to_number(F.col("weight").cast("string")).alias("plain"),
                    N.to_number(F.concat(F.col("weight").cast("string"), F.lit(" g"))).alias("unit"),
                    N.to_number(F.concat(F.lit(" "), F.col("order_value").cast("string"), F.lit(" ")))
                    .alias("spaced"))


@query("fn_money", statement(f"SELECT awb, {paise('order_value')} AS paise FROM facts"))
def fn_money(i):
    shown = F.concat(F.lit("₹ "), F.format_number("order_value", 2))
    return i.facts.select("awb", N.cents(N.to_money(shown)).alias("paise"))


project("fn_city_for_pin", "ships", "awb", "city")
project("fn_warehouse_label", "ships", "awb", "warehouse")
project("fn_tier", "ships", "awb", "drop_pin", "tier")
project("fn_geo_zone", "ships", "awb", "geo_zone")
project("fn_clean_city", "ships", "awb", "drop_city")
project("fn_lane", "ships", "awb", "lane")


@query("fn_weight_bucket", statement("""
SELECT awb, CASE WHEN weight <= 500 THEN '0-500g' WHEN weight <= 1000 THEN '500g-1kg'
  WHEN weight <= 5000 THEN '1-5kg' ELSE '5kg+' END AS bucket FROM facts"""))
def fn_weight_bucket(i):
    return i.facts.select("awb", C.weight_bucket(F.col("weight")).alias("bucket"))


project("fn_weight_class", "facts", "awb", "weight_class")
project("fn_pickup_slot", "facts", "awb", "pickup_slot")
project("fn_outcome", "facts", "awb", "status", "outcome")


@query("fn_presumed_lost", statement("""
SELECT awb, order_date FROM facts WHERE outcome = 'Cancelled'
  AND lower(status) NOT IN ('cancelled', 'notserviceable', 'lost', 'damaged', 'nostatusexist')"""))
def fn_presumed_lost(i):
    f = i.facts
    by_status = C.status_outcome(F.col("status"))
    return f.where((F.col("outcome") == "Cancelled") & (by_status == "FWD Pendency")) \
        .select("awb", "order_date")


project("fn_pendency_state", "facts", "awb", "pendency_state")
project("fn_product_category", "facts", "awb", "category", "subcategory")


@query("fn_canonical_category", statement("""
SELECT m.sku, coalesce(g.grp, m.category) AS display FROM master m
LEFT JOIN o_group g ON g.fine = m.category"""))
def fn_canonical_category(i):
    return i.master.select("sku", C.display_category("category").alias("display"))


@query("fn_invoice_category", statement("""
SELECT n.item_name, coalesce(arg_min(r.category, r.ix), 'Others') AS category
FROM (SELECT DISTINCT item_name FROM facts) n
LEFT JOIN o_inv_rules r ON contains(lower(n.item_name), r.kw) GROUP BY n.item_name"""))
def fn_invoice_category(i):
    names = i.facts.select("item_name").distinct()
    return C.add_invoice_category(names, F.lit(""), F.col("item_name"), "category")


@query("fn_norm_awb", statement("SELECT awb, awb AS norm FROM facts"))
def fn_norm_awb(i):
    return i.facts.select("awb", N.norm_awb(F.concat(F.lit(" "), F.lower("awb"), F.lit(".0 ")))
                          .alias("norm"))


@query("fn_norm_order", statement(f"""
SELECT order_code, {norm_order('order_code')} AS plain, {norm_order('order_code')} AS routed
FROM oms_orders"""))
def fn_norm_order(i):
    code = F.col("order_code")
    return i.fx.oms_orders.select("order_code", N.norm_order(code).alias("plain"),
                                  N.norm_order(F.concat(code, F.lit("_Route_9"))).alias("routed"))


@query("fn_clean_text", statement("""
SELECT awb, CASE WHEN order_id = '' THEN '' ELSE order_id END AS unwrapped, item_name AS name,
  split_part(carrier, ' ', 1) AS courier FROM facts"""))
def fn_clean_text(i):
    wrapped = F.concat(F.lit('="'), F.col("order_id"), F.lit('"'))
    name = F.when(F.col("item_name") == "", F.lit("#N/A")).otherwise(F.col("item_name"))
    return i.facts.select("awb", N.unwrap_formula(wrapped).alias("unwrapped"),
                          N.clean_name(name).alias("name"),
                          N.first_word(F.upper("carrier")).alias("courier"))


@query("fn_norm_header", statement("""
SELECT DISTINCT account, lower(account) || ' amt' AS header FROM facts"""))
def fn_norm_header(i):
    shown = F.concat(F.col("account"), F.lit(" (incl\nGST)  Amt (₹)"))
    return i.facts.select("account").distinct().select("account", N.norm_header(shown).alias("header"))


@query("fn_invoice_period", statement("""
SELECT awb, strftime(pickup_ts, '%d %b %Y') AS label, strftime(pickup_ts, '%B %Y') AS month,
  strftime(pickup_ts, '%Y-%m') AS key, strftime(pickup_ts, '%Y-%m') AS key_dmy,
  strftime(pickup_ts, '%Y-%m') AS key_mon
FROM facts WHERE pickup_ts IS NOT NULL"""))
def fn_invoice_period(i):
    f = i.facts.where(F.col("pickup_ts").isNotNull())
    iso = T.invoice_date(F.concat(F.date_format("pickup_ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+05:30")))
    dmy = T.invoice_date(F.date_format("pickup_ts", "dd-MM-yyyy"))
    mon = T.invoice_date(F.upper(F.date_format("pickup_ts", "dd MMM yyyy")))
    return f.select("awb", T.date_label(iso).alias("label"), T.month_label(iso).alias("month"),
                    T.month_key(iso).alias("key"), T.month_key(dmy).alias("key_dmy"),
                    T.month_key(mon).alias("key_mon"))


@query("fn_month_from_name", statement("""
SELECT DISTINCT strftime(pickup_ts, '%Y-%m') AS iso, strftime(pickup_ts, '%Y-%m') AS month_first,
  strftime(pickup_ts, '%Y-%m') AS named, strftime(pickup_ts, '0000-%m') AS bare,
  strftime(pickup_ts, '%B %Y') AS label FROM facts WHERE year(pickup_ts) >= 2000"""))
def fn_month_from_name(i):
    ts = F.col("pickup_ts")
    names = i.facts.where(F.year(ts) >= 2000).select(
        F.date_format(ts, "'bill_'yyyy-MM'.csv'").alias("a"),
        F.date_format(ts, "'ER 'MM.yyyy'.xlsx'").alias("b"),
        F.concat(F.lit("Prime-"), F.date_format(ts, "MMM''yy"), F.lit(".xlsb")).alias("c"),
        F.concat(F.lit("Summary "), F.date_format(ts, "MMMM")).alias("d")).distinct()
    for c in "abcd":
        names = T.add_month_of_name(names, c, f"{c}_key", f"{c}_label")
    return names.select(F.col("a_key").alias("iso"), F.col("b_key").alias("month_first"),
                        F.col("c_key").alias("named"), F.col("d_key").alias("bare"),
                        F.col("c_label").alias("label")).distinct()


@query("fn_split_skus", statement("""
SELECT DISTINCT sku AS sku_text, replace(sku, ', ', ',') AS tokens,
  cast(len(string_split(sku, ',')) AS BIGINT) AS n FROM invoice_raw WHERE sku LIKE '%,%'"""))
def fn_split_skus(i):
    skus = N.split_skus(F.col("sku"))
    return i.fx.invoice_raw.where(F.col("sku").contains(",")).select(
        F.col("sku").alias("sku_text"), F.array_join(skus, ",").alias("tokens"),
        F.size(skus).cast("bigint").alias("n")).distinct()


@query("fn_extract_bracketed", statement("""
SELECT DISTINCT sku, sku || ', X1' AS skus, item_name AS name FROM facts"""))
def fn_extract_bracketed(i):
    text = F.concat(F.lit("["), F.lower("sku"), F.lit("] {"), F.col("item_name"), F.lit("} 1 [x1 ]"))
    return i.facts.select("sku", "item_name", text.alias("t")).distinct().select(
        "sku", N.bracketed_skus(F.col("t")).alias("skus"), N.braced_name(F.col("t")).alias("name"))


@query("fn_reverse_label", statement("""
SELECT DISTINCT carrier, CASE WHEN carrier = 'Delhivery Reverse' THEN 'Delhivery [B2B]'
  ELSE carrier || ' [B2B]' END AS label FROM facts"""))
def fn_reverse_label(i):
    return i.facts.select("carrier").distinct().select(
        "carrier", C.reverse_label(F.concat("carrier", F.lit(" RVP  [B2B]"))).alias("label"))


@query("fn_inr_format", statement(f"""
SELECT order_id, CASE WHEN v >= 1e7 THEN format('₹{{:.2f}}Cr', {rnd('v / 1e7', 2)})
  WHEN v >= 1e5 THEN format('₹{{:.2f}}L', {rnd('v / 1e5', 2)})
  ELSE format('₹{{:,}}', cast({rnd('v', 0)} AS BIGINT)) END AS shown
FROM (SELECT order_id, max(order_value) * CASE WHEN length(order_id) % 3 = 0 THEN 100 ELSE 1 END AS v
      FROM facts WHERE order_id <> '' GROUP BY order_id) t"""))
def fn_inr_format(i):
    scale = F.when(F.length("order_id") % 3 == 0, F.lit(100)).otherwise(1)
    v = i.facts.where(F.col("order_id") != "").groupBy("order_id").agg(
        F.max("order_value").alias("v")).withColumn("v", F.col("v") * scale)
    return v.select("order_id", N.inr(F.col("v")).alias("shown"))


@query("fn_build_shipment", statement("""
SELECT awb, carrier, account, payment, pickup_pin, city, drop_pin, drop_city, tier, lane,
  weight_class, pickup_slot, outcome, pendency_state, category, subcategory, picked, delivered,
  transit_days, edd_days, order_date, pickup_date, window_date FROM ships"""))
def fn_build_shipment(i):
    return i.ships.select(
        "awb", "carrier", "account", "payment", "pickup_pin", "city", "drop_pin", "drop_city", "tier",
        "lane", "weight_class", "pickup_slot", "outcome", "pendency_state", "category", "subcategory",
        "picked", "delivered", "transit_days", "edd_days", "order_date", "pickup_date", "window_date")


# --- table sources and windows -------------------------------------------------------------

_SAME_NAMES = {f: f for f in S.SHIPMENT_TABLE_COLUMNS}
_SCAN = "awb, carrier, order_ts, pickup_ts, window_ts"
_DAY = "cast(coalesce(order_ts, pickup_ts) AS DATE)"


def _scan(i, window, **kw):
    return SRC.scan_shipments(i.raw, window, _SAME_NAMES, **kw) \
        .select("awb", "carrier", "order_ts", "pickup_ts", "window_ts")


@query("src_shipment_table", statement(f"SELECT {_SCAN} FROM shipments_raw"))
def src_shipment_table(i):
    return _scan(i, Window())


@query("src_oms_orders", statement("""
SELECT order_code, channel, order_ts FROM oms_orders
WHERE channel IN ('SHOPIFY_IN', 'AMAZON_API_NEW', 'custom', 'B2B')"""))
def src_oms_orders(i):
    return SRC.scan_orders(i.fx.oms_orders)


@query("win_date", statement(f"SELECT awb, {_DAY} AS window_day FROM shipments_raw"))
def win_date(i):
    kinds = {f.name: f.dataType for f in i.raw.schema.fields}
    return i.raw.select("awb", window_date(F.col("order_ts"), F.col("pickup_ts"), kinds["order_ts"],
                                           kinds["pickup_ts"]).alias("window_day"))


@query("win_lookback", statement(f"""
SELECT {_SCAN} FROM shipments_raw WHERE {_DAY} >= DATE '{DAY}' - 366"""))
def win_lookback(i):
    return _scan(i, Window.lookback(9999, DAY), partition=None)


@query("win_range", statement(f"""
SELECT {_SCAN} FROM shipments_raw WHERE {_DAY} BETWEEN DATE '1997-01-01' AND DATE '1998-06-30'"""))
def win_range(i):
    return _scan(i, Window.between("1997-01-01", "1998-06-30"), partition=None)


@query("win_partition_prune", statement(f"""
SELECT {_SCAN} FROM shipments_raw WHERE {_DAY} >= DATE '2001-01-01'
  AND cast(window_ts AS DATE) >= DATE '2000-12-29'"""))
def win_partition_prune(i):
    return _scan(i, Window.between("2001-01-01", None))


@query("win_row_cap", statement(f"""
SELECT {_SCAN} FROM shipments_raw ORDER BY awb LIMIT 100"""))
def win_row_cap(i):
    return _scan(i, Window(), limit=100)


# --- filters -------------------------------------------------------------------------------

def filter_query(name: str, source: str, filters: Filters, where: str):
    @query(name, statement(f"SELECT awb, carrier, account FROM {source} WHERE {where}"))
    def run(i):
        return FL.filter_shipments(getattr(i, source), filters).select("awb", "carrier", "account")


filter_query("flt_delivery_type", "facts", Filters(delivery_type=["RVP", "REVERSE PICKUP"]),
             "delivery_type IN ('RVP', 'REVERSE PICKUP')")
filter_query("flt_zone", "facts", Filters(zone="North"), "zone = 'North'")
filter_query("flt_payment", "facts", Filters(payment="COD"), "payment = 'COD'")
filter_query("flt_channel", "facts", Filters(channel=["CUSTOM", "B2B"]), "channel IN ('CUSTOM', 'B2B')")
filter_query("flt_account", "facts", Filters(account=["Swift_NDD", "all"]), "account = 'Swift_NDD'")
filter_query("flt_warehouse", "facts", Filters(warehouse=["412106", "600052"]),
             "pickup_pin IN ('412106', '600052')")
filter_query("flt_weight_class", "facts", Filters(weight="Heavy"), "weight_class = 'Heavy'")
filter_query("flt_pickup_slot", "facts", Filters(slot="12–1pm"), "hour(pickup_ts) = 12")
filter_query("flt_tier", "ships", Filters(tier="Tier 2"), "tier = 'Tier 2'")
filter_query("flt_reverse_carrier", "facts", Filters(reverse_carrier=["Ekart", "Delhivery Reverse"]),
             "carrier IN ('Ekart', 'Delhivery Reverse') AND is_reverse")
filter_query("flt_order_date", "facts", Filters(date_from="1996-03-01", date_to="1996-12-31"),
             "order_date >= DATE '1996-03-01' AND order_date <= DATE '1996-12-31'")
filter_query("flt_combined", "ships",
             Filters(delivery_type="FORWARD", zone=["North", "South"], payment="COD", tier="Tier 1",
                     weight=["Light", "Medium"], channel="all", date_from="1995-06-01"),
             "delivery_type = 'FORWARD' AND zone IN ('North', 'South') AND payment = 'COD' AND "
             "tier = 'Tier 1' AND weight_class IN ('Light', 'Medium') AND "
             "order_date >= DATE '1995-06-01'")


@query("flt_tat_status", statement("""
SELECT awb, tat_status FROM classified WHERE tat_status IN ('Out of TAT', 'No rule')"""))
def flt_tat_status(i):
    return FL.tat_status_in(i.classified, ["Out of TAT", "No rule"]).select("awb", "tat_status")


@query("flt_d2c_channel", statement("""
SELECT awb, channel FROM facts WHERE channel <> 'MARKETPLACE'"""))
def flt_d2c_channel(i):
    return i.facts.where(FL.is_d2c_channel(F.col("channel"))).select("awb", "channel")


@query("flt_carrier_prefix", statement("""
SELECT awb, carrier FROM facts WHERE EXISTS (
  SELECT 1 FROM (SELECT DISTINCT regexp_replace(split_part(lower(carrier), ' ', 1), '[^a-z0-9]', '', 'g')
    AS p FROM invoice_raw WHERE carrier IN ('Delhivery', 'Blue Dart')) x
  WHERE starts_with(lower(facts.carrier), x.p))"""))
def flt_carrier_prefix(i):
    billed = i.fx.invoice_raw.where(F.col("carrier").isin("Delhivery", "Blue Dart"))
    return FL.carrier_prefix_in(i.facts, billed).select("awb", "carrier")


@query("flt_is_reverse", statement("SELECT awb FROM facts WHERE is_reverse"))
def flt_is_reverse(i):
    return i.facts.where("is_reverse").select("awb")


@query("flt_is_ndd", statement("SELECT awb, account FROM facts WHERE is_ndd"))
def flt_is_ndd(i):
    return i.facts.where("is_ndd").select("awb", "account")


# --- SLA -----------------------------------------------------------------------------------

@query("sla_match_rule", statement("""
SELECT s.awb, r.rule FROM ships s JOIN o_matched m ON m.carrier = s.carrier
  AND m.account = s.account JOIN o_sla r ON r.ix = m.rule_ix"""))
def sla_match_rule(i):
    return sla.add_rule(i.facts).where(F.col("rule").isNotNull()).select("awb", "rule")


project("sla_warehouse_for_pin", "ships", "awb", "hub")


@query("sla_lane_lookup", statement("SELECT awb, rule, tat_primary FROM sla_in WHERE rule IS NOT NULL"))
def sla_lane_lookup(i):
    df = sla.add_lane_tat(sla.add_rule(i.ships), i.fx.sla_lanes)
    return df.where(F.col("rule").isNotNull()).select("awb", "rule", "tat_primary")


@query("sla_default_matrix", statement("SELECT awb, tat_default FROM sla_in WHERE rule = 'GoSwift'"))
def sla_default_matrix(i):
    df = sla.add_lane_tat(sla.add_rule(i.ships), i.fx.sla_lanes)
    return df.where(F.col("rule") == "GoSwift").select("awb", "tat_default")


@query("sla_payment_split", statement("""
SELECT s.awb, l.tat + CASE WHEN s.payment = 'COD' AND s.hub <> 'MAA' THEN 10 ELSE 0 END AS tat_payment
FROM sla_in s LEFT JOIN sla_lanes l ON l.tier = 'primary' AND l.rule = 'GoSwift'
  AND l.warehouse = s.hub AND l.drop_pin = s.drop_pin WHERE s.rule = 'GoSwift'"""))
def sla_payment_split(i):
    primary = i.fx.sla_lanes.where((F.col("tier") == "primary") & (F.col("rule") == "GoSwift"))
    prepaid = primary.withColumn("payment", F.lit("PREPAID"))
    cod = primary.where(F.col("warehouse") != "MAA").withColumns(
        {"payment": F.lit("COD"), "tat": F.col("tat") + 10})
    swift = sla.add_rule(i.ships).where(F.col("rule") == "GoSwift")
    return sla.add_payment_tat(swift, prepaid.unionByName(cod)).select("awb", "tat_payment")


@query("sla_default_tat", statement("""
SELECT awb, rule, coalesce(tat_primary, tat_default, default_tat) AS tat FROM sla_in
WHERE default_tat IS NOT NULL"""))
def sla_default_tat(i):
    defaults = [None if r.default_tat is None else float(r.default_tat) for r in SLA_RULES]
    df = sla.add_lane_tat(sla.add_rule(i.ships), i.fx.sla_lanes) \
        .withColumn("_d", N.pick(F.col("rule_ix"), defaults))
    return df.where(F.col("_d").isNotNull()).select(
        "awb", "rule", F.coalesce("tat_primary", "tat_default", "_d").alias("tat"))


@query("sla_city_lookup", statement("SELECT awb, tat_city FROM sla_in WHERE rule = 'GoSwift'"))
def sla_city_lookup(i):
    df = sla.add_city_tat(sla.add_rule(i.ships), i.fx.sla_lanes)
    return df.where(F.col("rule") == "GoSwift").select("awb", "tat_city")


@query("sla_override", statement("""
SELECT awb, rule, overridden, tat_override FROM sla_in WHERE rule IS NOT NULL"""))
def sla_override(i):
    df = sla.add_override_tat(sla.add_rule(i.ships), i.overrides)
    return df.where(F.col("rule").isNotNull()).select("awb", "rule", "overridden", "tat_override")


@query("sla_override_rows", statement("SELECT carrier_rule, origin_pin, pincode, tat FROM o_override"))
def sla_override_rows(i):
    return sla.override_lookup(i.overrides)


@query("sla_override_meta", statement("""
SELECT ix, rule AS name, unit, count(o.carrier_rule) > 0 AS has_override,
  count(o.carrier_rule) AS rule_count
FROM o_sla LEFT JOIN overrides o ON o.carrier_rule = rule GROUP BY ix, rule, unit"""))
def sla_override_meta(i):
    return sla.override_meta(i.overrides)


_NO_OVERRIDE = "overridden = false"


def _scored_rows(i, keep):
    return i.classified.where(keep).select("awb", "promised_tat", "tat_status", "tat_margin")


def sla_branch(name: str, measures: str, keep):
    @query(name, statement(f"""
SELECT awb, promised_tat, tat_status, tat_margin FROM classified WHERE {measures}"""))
    def run(i):
        return _scored_rows(i, keep())


def _rule_is(*names):
    return F.col("rule").isin(*names) & ~F.col("is_reverse")


sla_branch("sla_edd", "measure = 'edd'", lambda: F.col("edd_days").isNotNull() & ~F.col("overridden")
           & _rule_is("Skye Air", "Shiprocket", "Bluedart", "GoSwift"))
sla_branch("sla_delivery_basis", "starts_with(measure, 'delivery')",
           lambda: _rule_is("Delhivery NDD", "Swift NDD", "Elastic Run", "Shadowfax Large", "Shadowfax")
           | (_rule_is("Shiprocket") & F.col("edd_days").isNull()))
sla_branch("sla_ofd1_basis", "starts_with(measure, 'ofd1')",
           lambda: _rule_is("Bluedart", "GoSwift", "Skye Air")
           & (F.col("edd_days").isNull() | F.col("overridden")))
sla_branch("sla_reverse", "is_reverse", lambda: F.col("is_reverse"))


@query("sla_offset", statement("""
SELECT awb, coalesce(tat_primary, default_tat) AS before, promised_tat FROM classified
WHERE rule = 'Shadowfax' AND NOT is_reverse"""))
def sla_offset(i):
    df = sla.add_lane_tat(sla.add_rule(i.ships), i.fx.sla_lanes)
    out = sla.score_sla(df.withColumns({
        "overridden": F.lit(False), "tat_override": F.lit(None).cast("double"),
        "tat_city": F.lit(None).cast("double")}))
    return out.where(_rule_is("Shadowfax")).select(
        "awb", F.coalesce("tat_primary", F.lit(3.0)).alias("before"), "promised_tat")


@query("sla_classify", statement("""
SELECT awb, promised_tat, tat_status, tat_margin FROM classified"""))
def sla_classify(i):
    return i.classified.select("awb", "promised_tat", "tat_status", "tat_margin")


_CLEARED = statement("SELECT awb, promised_tat, tat_status, tat_margin FROM classified").replace(
    "AND tat IS NOT NULL)", "AND tat IS NOT NULL AND carrier_rule <> 'GoSwift')")


@query("sla_reclassify", _CLEARED)
def sla_reclassify(i):
    kept = sla.upsert_overrides(i.overrides, "GoSwift", i.fx.sla_overrides_raw.where("false"))
    return sla.classify_sla(i.ships, i.fx.sla_lanes, kept).select(
        "awb", "promised_tat", "tat_status", "tat_margin")


# --- orders and shipment joins -------------------------------------------------------------

_ORDERS_PER_DAY = f"""
SELECT p.day AS date, count(DISTINCT p.oid) AS n,
  {rnd(rupees('coalesce(sum(v.paise), 0)'), 2)} AS revenue
FROM (SELECT DISTINCT oid, day FROM d2c) p LEFT JOIN (
  SELECT order_id AS oid, max({paise('order_value')}) AS paise FROM facts WHERE order_id <> ''
  GROUP BY order_id) v USING (oid) GROUP BY p.day"""


@query("join_orders_value", statement(_ORDERS_PER_DAY))
def join_orders_value(i):
    return O.orders_per_day(i.fx.oms_orders, i.facts)


@query("agg_orders_per_day", statement(_ORDERS_PER_DAY.replace(
    "FROM d2c)", "FROM d2c WHERE day BETWEEN DATE '1997-01-01' AND DATE '1997-12-31')").replace(
    "order_id <> ''", "order_id <> '' AND order_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'")))
def agg_orders_per_day(i):
    return O.orders_per_day(i.fx.oms_orders, i.facts, Window.between("1997-01-01", "1997-12-31"))


@query("agg_order_received", statement("""
SELECT oid, min(order_ts) AS received_ts FROM d2c GROUP BY oid"""))
def agg_order_received(i):
    return O.order_times(i.fx.oms_orders)


@query("join_o2s", statement(f"""
SELECT f.awb, CASE WHEN f.pickup_ts >= r.ts AND cast(r.ts AS DATE) <= DATE '{DAY}' - 4 THEN
  floor(date_diff('microsecond', r.ts, f.pickup_ts) / 3.6e9 * 100 + 0.5e0) / 100.0e0 END AS o2s
FROM facts f LEFT JOIN (SELECT oid, min(order_ts) AS ts FROM d2c GROUP BY oid) r
  ON r.oid = f.order_id AND f.order_id <> ''"""))
def join_o2s(i):
    return O.recompute_o2s(i.facts, O.order_times(i.fx.oms_orders), AS_OF).select("awb", "o2s")


@query("join_idset_pushdown", statement(f"""
SELECT awb, order_id FROM ships WHERE awb IN (SELECT awb FROM invoice_raw WHERE amount > 100)
  OR (order_id <> '' AND order_id IN (SELECT {norm_order('order_id')} FROM invoice_raw
      WHERE amount > 100))"""))
def join_idset_pushdown(i):
    lines = i.fx.invoice_raw.where(F.col("amount") > 100)
    return L.billed_shipments(i.facts, lines).select("awb", "order_id")


@query("join_product_maps", statement("""
SELECT 'awb' AS map, awb AS key, sku, item_name AS name, order_value AS value, order_id AS oid FROM (SELECT DISTINCT awb, sku, item_name, order_value, order_id FROM ships) d
UNION ALL SELECT 'order', oid, sku, item_name, order_value, '' FROM by_order"""))
def join_product_maps(i):
    a = L.awb_dim(i.facts).select(
        F.lit("awb").alias("map"), F.col("awb_key").alias("key"), F.col("awb_product.sku").alias("sku"),
        F.col("awb_product.item_name").alias("name"), F.col("awb_value").alias("value"),
        F.coalesce("awb_order", F.lit("")).alias("oid"))
    o = L.order_dim(i.facts).select(
        F.lit("order").alias("map"), F.col("ord_key").alias("key"), F.col("ord_product.sku").alias("sku"),
        F.col("ord_product.item_name").alias("name"), F.col("ord_value").alias("value"),
        F.lit("").alias("oid"))
    return a.unionByName(o)


@query("join_master_category", statement("""
SELECT s.awb, coalesce(CASE WHEN m.category <> 'Others' THEN m.category END, s.category) AS category,
  CASE WHEN m.category <> 'Others' THEN m.product ELSE s.subcategory END AS subcategory
FROM facts s LEFT JOIN m_sku m ON m.sku_key = s.sku"""))
def join_master_category(i):
    return L.category_from_master(i.facts, i.master).select("awb", "category", "subcategory")


# --- KPI blocks ----------------------------------------------------------------------------

_KPI_COLS = ["n", "picked", "delivered", "first_attempt", "rto", "o2s", "p2o", "p2d", "success_rate",
             "first_attempt_rate", "rto_pct"]


@query("agg_kpi_block", statement(f"""
SELECT account, {', '.join(_KPI_COLS)}, avg_attempts FROM ({kpi('facts', ['account'])}) b"""))
def agg_kpi_block(i):
    return K.kpi_block(i.facts, ["account"]).select("account", *_KPI_COLS, "avg_attempts")


_BY_CARRIER = scored(kpi("facts", ["carrier"]), 0, "carrier")
_BY_WAREHOUSE = scored(kpi("ships", ["pickup_pin"], {"warehouse": "warehouse", "city": "city"}), 20,
                       "pickup_pin", ", warehouse, city")
_BY_DEST = scored(kpi("ships", ["drop_city"]), 20, "drop_city")
_BY_LANE = scored(kpi("ships", ["lane"]), 15, "lane")
_BY_ACCOUNT = scored(kpi("ships", ["pickup_pin", "account"], {"warehouse": "warehouse",
                     "city": "city"}), 10, "pickup_pin, account", ", warehouse, city", "pickup_pin")
_WITH_SHARE = f"""SELECT *, {big('sum(n) OVER (PARTITION BY pickup_pin)')} AS wh_total,
  {rnd(pct('n', 'sum(n) OVER (PARTITION BY pickup_pin)'))} AS wh_share FROM ({_BY_ACCOUNT}) a"""

query("agg_carrier", statement(_BY_CARRIER))(lambda i: K.by_carrier(i.facts))
query("agg_warehouse", statement(_BY_WAREHOUSE))(lambda i: K.by_warehouse(i.ships))
query("agg_destination", statement(_BY_DEST))(lambda i: K.by_destination(i.ships))
query("agg_lane", statement(_BY_LANE))(lambda i: K.by_lane(i.ships))
query("agg_warehouse_account", statement(_WITH_SHARE))(lambda i: K.by_warehouse_account(i.ships))
query("sort_score_nulls_last", statement(
    f"SELECT account, score, n FROM ({scored(kpi('facts', ['account']), 2000, 'account')}) s "
    "ORDER BY score DESC NULLS LAST, n DESC, account"))(
    lambda i: K.ranked(K._scored(i.facts, ["account"], 2000), "account").select("account", "score", "n"))
query("topk_warehouses", statement(
    f"SELECT * FROM ({_BY_WAREHOUSE}) w ORDER BY n DESC, pickup_pin LIMIT 10"))(
    lambda i: K.by_warehouse(i.ships).orderBy(F.desc("n"), "pickup_pin").limit(S.TOP_WAREHOUSES))

_SUBS = ", ".join(f"sub_{m}" for m in S.SCORE_WEIGHTS)
query("score_minmax", statement(f"SELECT drop_city, {_SUBS} FROM ({_BY_DEST}) d"))(
    lambda i: K.by_destination(i.ships).select("drop_city", *[f"sub_{m}" for m in S.SCORE_WEIGHTS]))
query("score_composite", statement(f"SELECT account, score FROM ({scored(kpi('facts', ['account']), 0, 'account')}) s"))(
    lambda i: K._scored(i.facts, ["account"], 0).select("account", "score"))
query("score_in_partition", statement(f"SELECT pickup_pin, account, score FROM ({_BY_ACCOUNT}) s"))(
    lambda i: K.by_warehouse_account(i.ships).select("pickup_pin", "account", "score"))
query("win_share", statement(f"SELECT pickup_pin, account, wh_total, wh_share FROM ({_WITH_SHARE}) s"))(
    lambda i: K.by_warehouse_account(i.ships).select("pickup_pin", "account", "wh_total", "wh_share"))
query("bottomk_weak", statement(
    f"SELECT drop_city, n, success_rate FROM ({_BY_DEST}) d WHERE n >= 20 AND success_rate IS NOT NULL "
    "ORDER BY success_rate, drop_city LIMIT 4"))(
    lambda i: reports.weakest(K.by_destination(i.ships), "success_rate", 4, 20, "drop_city")
    .select("drop_city", "n", "success_rate"))

_OUT = ", ".join(f"{big(f'count_if(outcome = {chr(39)}{o}{chr(39)})')} AS {K._slug(o)}, "
                 + rnd(pct(f"count_if(outcome = '{o}')", "count(*)")) + f" AS {K._slug(o)}_pct"
                 for o in S.OUTCOMES)
_STATUS = f"SELECT account, count(*) AS n, {_OUT} FROM facts WHERE account <> '' GROUP BY account"
_PENDENCY = f"""
SELECT account, pendency_state, n, {big('sum(n) OVER (PARTITION BY account)')} AS account_n,
  {rnd(pct('n', 'sum(n) OVER (PARTITION BY account)'))} AS pct
FROM (SELECT account, pendency_state, count(*) AS n FROM facts WHERE outcome = 'FWD Pendency'
      GROUP BY ALL) t"""
query("agg_status_matrix", statement(_STATUS))(lambda i: K.status_matrix(i.facts))
query("agg_pendency_matrix", statement(_PENDENCY))(lambda i: K.pendency_matrix(i.facts))


def _tat(key: str | None) -> str:
    st = "tat_status"
    head = f"{key}, " if key else ""
    return f"""
SELECT {head}count(*) AS n, {big('count_if(delivered)')} AS delivered,
  {big(f"count_if({st} = 'In TAT')")} AS in_tat, {big(f"count_if({st} = 'Out of TAT')")} AS out_tat,
  {big(f"count_if({st} = 'No rule')")} AS no_rule, {big(f"count_if({st} = 'Pending')")} AS pending,
  {big(f"count_if({st} = 'Out of TAT' AND delivered)")} AS out_delivered,
  {big(f"count_if({st} = 'Out of TAT' AND NOT delivered)")} AS out_pending,
  {rnd(div('sum(cast(floor(tat_margin * 3600) AS BIGINT))', 'count(tat_margin) * 3600'))} AS avg_margin,
  {big(f"count_if({st} IN ('In TAT', 'Out of TAT'))")} AS evaluable,
  {rnd(pct(f"count_if({st} = 'In TAT')", f"count_if({st} IN ('In TAT', 'Out of TAT'))"))} AS in_tat_pct,
  {rnd(pct(f"count_if({st} = 'Out of TAT')", f"count_if({st} IN ('In TAT', 'Out of TAT'))"))} AS out_tat_pct,
  {rnd(pct(f"count_if({st} <> 'No rule')", 'count(*)'))} AS coverage_pct
FROM classified {f'GROUP BY {key}' if key else ''}"""


query("agg_tat_matrix", statement(_tat("account")))(lambda i: K.tat_matrix(i.classified))
query("agg_tat_warehouse", statement(_tat("pickup_pin")))(lambda i: K.tat_matrix(i.classified, "pickup_pin"))
query("agg_tat_summary", statement(_tat(None)))(lambda i: K.tat_summary(i.classified))


#: The groupings of the single pass: name, statement, first key, second key.
_SINGLE_PASS = [
    ("carrier", _BY_CARRIER, "carrier", None), ("warehouse", _BY_WAREHOUSE, "pickup_pin", None),
    ("destination", _BY_DEST, "drop_city", None), ("lane", _BY_LANE, "lane", None),
    ("warehouse_account", _WITH_SHARE, "pickup_pin", "account"), ("status", _STATUS, "account", None),
    ("pendency", _PENDENCY, "account", "pendency_state"), ("tat", _tat(None), None, None),
    ("sla", "SELECT tat_status, count(*) AS n FROM classified GROUP BY tat_status", "tat_status", None)]
#: What they read of classified shipments.
_SINGLE_PASS_READS = ["carrier", "account", "pickup_pin", "warehouse", "city", "drop_city", "lane", "o2s_us",
                      "p2o_us", "p2d_us", "picked", "delivered", "attempts", "outcome", "pendency_state",
                      "tat_status", "tat_margin"]


def _long_part(dimension: str, sql: str, grp: str | None, part: str | None) -> str:
    keys = ", ".join(k for k in (grp, part) if k)
    return (f"SELECT '{dimension}' AS dimension, {grp or 'cast(NULL AS VARCHAR)'} AS grp, "
            f"{part or 'cast(NULL AS VARCHAR)'} AS part, "
            f"{f'* EXCLUDE ({keys})' if keys else '*'} FROM ({sql}) x_{dimension}")


@query("agg_single_pass", statement(" UNION ALL BY NAME ".join(_long_part(*p) for p in _SINGLE_PASS)))
def agg_single_pass(i):
    """Every grouping of the report with all its measures over one input, of whose columns those they
    read are written out once. A measure that a grouping doesn't have is null in its rows."""
    from parcelsight.session import cut_lineage
    rows = cut_lineage(i.classified.select(*_SINGLE_PASS_READS), "classified")
    found = {
        "carrier": K.by_carrier(rows), "warehouse": K.by_warehouse(rows),
        "destination": K.by_destination(rows), "lane": K.by_lane(rows),
        "warehouse_account": K.by_warehouse_account(rows), "status": K.status_matrix(rows),
        "pendency": K.pendency_matrix(rows), "tat": K.tat_summary(rows),
        "sla": rows.groupBy("tat_status").agg(F.count("*").alias("n"))}
    parts = []
    for dimension, _, grp, part in _SINGLE_PASS:
        df = found[dimension]
        grp, part = [(F.col(k) if k else F.lit(None).cast("string"), k) for k in (grp, part)]
        parts.append(df.select(
            F.lit(dimension).alias("dimension"), grp[0].alias("grp"), part[0].alias("part"),
            *[c for c in df.columns if c not in (grp[1], part[1])]))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


# --- revenue -------------------------------------------------------------------------------

@query("agg_revenue_dedup", statement(f"""
SELECT outcome, count(*) AS n, {big('sum(rev_paise)')} AS paise FROM rev GROUP BY outcome"""))
def agg_revenue_dedup(i):
    f = i.facts
    value = R.order_units(f, "outcome").groupBy("outcome").agg(F.sum("paise").alias("paise"))
    return f.groupBy("outcome").agg(F.count("*").alias("n")).join(value, "outcome")


@query("win_first_seen", statement("""
SELECT order_id, order_value AS value, arg_min(outcome, awb) AS outcome FROM facts
WHERE order_id <> '' GROUP BY order_id, order_value
UNION ALL SELECT '', order_value, outcome FROM facts WHERE order_id = ''"""))
def win_first_seen(i):
    return R.order_units(i.facts, "outcome").drop("paise")


@query("agg_distinct_orders", statement("""
SELECT count(DISTINCT nullif(order_id, '')) + count_if(order_id = '') AS order_units FROM facts"""
                                        .replace("SELECT count", "SELECT cast(count").replace(
                                            "'') AS order_units", "'') AS BIGINT) AS order_units")))
def agg_distinct_orders(i):
    return R.order_count(R.order_units(i.facts))


def _value(cond: str = "true") -> str:
    return f"coalesce(sum(CASE WHEN {cond} THEN rev_paise END), 0)"


_SUMMARY = f"""
SELECT count(*) AS total,
  cast(count(DISTINCT nullif(order_id, '')) + count_if(order_id = '') AS BIGINT) AS order_units,
  {big('count_if(picked)')} AS picked, {big('count_if(delivered)')} AS delivered,
  {big("count_if(outcome = 'RTO')")} AS rto,
  {rnd(pct('count_if(delivered)', 'count_if(picked)'))} AS success_rate,
  {rnd(pct("count_if(outcome = 'RTO')", 'count(*)'))} AS rto_pct,
  {rnd(mean_hours('p2o_us'))} AS avg_p2o, {rnd(mean_hours('p2d_us'))} AS avg_p2d,
  {rnd('(median(o2s_us) / 3.6e9)')} AS avg_o2s, count(DISTINCT carrier) AS carriers,
  count(DISTINCT pickup_pin) AS warehouses, {big('count_if(is_ndd)')} AS ndd_orders,
  {big("count_if(outcome = 'FWD Pendency')")} AS pending_orders,
  {big("count_if(outcome = 'Cancelled')")} AS cancelled_orders,
  {rnd(pct('count_if(is_ndd)', 'count(*)'))} AS ndd_pct,
  {rnd(rupees(_value()))} AS revenue, {rnd(rupees(_value('delivered')))} AS delivered_value,
  {rnd(rupees(_value("outcome = 'RTO'")))} AS rto_value,
  {rnd(rupees(_value("outcome = 'FWD Pendency'")))} AS pending_value,
  {rnd(rupees(_value("outcome = 'Cancelled'")))} AS cancelled_value,
  {rnd(pct(_value("outcome = 'RTO'"), _value()))} AS rto_value_pct,
  {rnd(pct(_value("outcome = 'FWD Pendency'"), _value()))} AS pending_value_pct,
  {rnd(pct(_value("outcome = 'Cancelled'"), _value()))} AS cancelled_value_pct,
  {rnd('(' + rupees(_value()) + " / (count(DISTINCT nullif(order_id, '')) + count_if(order_id = '')))")} AS aov,
  {big("count_if(tat_status = 'In TAT')")} AS tat_in, {big("count_if(tat_status = 'Out of TAT')")} AS tat_out,
  {rnd(pct("count_if(tat_status = 'In TAT')", "count_if(tat_status IN ('In TAT', 'Out of TAT'))"))} AS tat_in_pct,
  {rnd(pct("count_if(tat_status = 'Out of TAT')", "count_if(tat_status IN ('In TAT', 'Out of TAT'))"))} AS tat_out_pct,
  {big("count_if(tat_status = 'Pending')")} AS tat_pending,
  {rnd(pct("count_if(tat_status = 'Pending')", 'count(*)'))} AS tat_pending_pct,
  {big("count_if(tat_status = 'Out of TAT' AND delivered)")} AS tat_out_delivered,
  {big("count_if(tat_status = 'Out of TAT' AND NOT delivered)")} AS tat_out_pending
FROM rev"""
query("agg_summary", statement(_SUMMARY))(lambda i: R.summary(i.classified))

query("agg_tier", statement(f"""
SELECT t.tier, count(r.awb) AS n, {rnd(rupees('coalesce(sum(r.rev_paise), 0)'))} AS revenue
FROM (VALUES ('Tier 1'), ('Tier 2'), ('Tier 3'), ('Unknown')) AS t(tier)
LEFT JOIN rev r ON r.tier = t.tier GROUP BY t.tier"""))(lambda i: R.tier_mix(i.ships))

_TOTALS = "(SELECT count(*) AS tn, sum(rev_paise) AS tp FROM rev)"
_PAYMENT = f"""
SELECT payment, count(*) AS n, {rnd(pct('count(*)', 'any_value(tn)'))} AS n_pct,
  {rnd(rupees('sum(rev_paise)'))} AS revenue, {rnd(pct('sum(rev_paise)', 'any_value(tp)'))} AS revenue_pct,
  {rnd(div(rupees('sum(rev_paise)'), 'count(*)'))} AS aov, {big('count_if(delivered)')} AS delivered,
  {rnd(pct('count_if(delivered)', 'count_if(picked)'))} AS success_rate,
  {big("count_if(outcome = 'RTO')")} AS rto, {rnd(pct("count_if(outcome = 'RTO')", 'count(*)'))} AS rto_pct,
  {rnd(rupees(f"coalesce(sum(CASE WHEN outcome = 'FWD Pendency' THEN {paise('cod_value')} END), 0)"))} AS cod_exposure
FROM rev CROSS JOIN {_TOTALS} t GROUP BY payment"""
query("agg_payment_perf", statement(_PAYMENT))(lambda i: R.payment_performance(i.facts))

query("agg_geo_zone", statement(f"""
SELECT z.zone, z.label, count(r.awb) AS n, {rnd(pct('count(r.awb)', 'any_value(tn)'))} AS share_pct,
  {rnd(rupees('coalesce(sum(rev_paise), 0)'))} AS revenue,
  {rnd(pct('coalesce(sum(rev_paise), 0)', 'any_value(tp)'))} AS revenue_pct,
  {rnd(pct("count_if(outcome = 'RTO')", 'count(r.awb)'))} AS rto_pct,
  {rnd(div(rupees('coalesce(sum(rev_paise), 0)'), 'count(r.awb)'))} AS aov,
  {rnd(pct('count_if(delivered)', 'count_if(picked)'))} AS success_rate
FROM (VALUES ('A', 'Intra City'), ('B', 'Tier 1 City'), ('C', 'Rest of Cities'),
  ('E', 'North East & J&K')) AS z(zone, label) LEFT JOIN rev r ON r.geo_zone = z.zone
CROSS JOIN {_TOTALS} t GROUP BY z.zone, z.label"""))(lambda i: R.zone_breakdown(i.ships))

_DAILY = f"""
SELECT coalesce(order_date, pickup_date, window_date) AS date, count(*) AS n,
  {big('count_if(delivered)')} AS delivered, {rnd(rupees('sum(rev_paise)'))} AS revenue
FROM rev GROUP BY 1"""
query("agg_daily", statement(_DAILY))(lambda i: R.daily_series(i.facts))

_TREE = f"""
SELECT 'category' AS level, display_group AS category, '' AS item, count(*) AS n,
  {rnd(rupees('sum(rev_paise)'))} AS revenue, {rnd(pct('sum(rev_paise)', 'any_value(tp)'))} AS revenue_pct,
  {rnd(pct("count_if(outcome = 'RTO')", 'count(*)'))} AS rto_pct,
  {rnd(div(rupees('sum(rev_paise)'), 'count(*)'))} AS aov,
  {rnd(pct('count_if(delivered)', 'count_if(picked)'))} AS success_rate
FROM rev CROSS JOIN {_TOTALS} t GROUP BY display_group
UNION ALL SELECT 'subcategory', display_group, subcategory, count(*), {rnd(rupees('sum(rev_paise)'))},
  NULL, {rnd(pct("count_if(outcome = 'RTO')", 'count(*)'))}, NULL, NULL FROM rev GROUP BY 2, 3
UNION ALL SELECT 'account', display_group, account, count(*), NULL, NULL, NULL, NULL, NULL
FROM rev GROUP BY 2, 3"""
query("agg_product_tree", statement(_TREE))(lambda i: R.product_tree(i.facts))

_OPTIONS = """
SELECT 'zone' AS dimension, zone AS value, zone AS label, count(*) AS n FROM ships WHERE zone <> ''
GROUP BY 2
UNION ALL SELECT 'channel', channel, channel, count(*) FROM ships GROUP BY 2
UNION ALL SELECT 'account', account, account, count(*) FROM ships GROUP BY 2
UNION ALL SELECT 'reverse_carrier', carrier, carrier, count(*) FROM ships WHERE is_reverse GROUP BY 2
UNION ALL SELECT 'warehouse', pickup_pin, warehouse, count(*) FROM ships GROUP BY 2, 3
UNION ALL SELECT u.d, cast(u.v AS VARCHAR), cast(u.v AS VARCHAR), NULL FROM (
  SELECT 'pickup_date_min' AS d, min(pickup_date) AS v FROM ships UNION ALL
  SELECT 'pickup_date_max', max(pickup_date) FROM ships UNION ALL
  SELECT 'order_date_min', min(order_date) FROM ships UNION ALL
  SELECT 'order_date_max', max(order_date) FROM ships) u"""
query("agg_filter_options", statement(_OPTIONS))(lambda i: R.filter_options(i.ships))
query("topk_options", statement("""
SELECT pickup_pin AS value, warehouse AS label, count(*) AS n FROM ships GROUP BY 1, 2
ORDER BY n DESC, value LIMIT 10"""))(
    lambda i: R.filter_options(i.ships).where(F.col("dimension") == "warehouse")
    .select("value", "label", "n").orderBy(F.desc("n"), "value").limit(S.TOP_WAREHOUSES))


# --- report parts --------------------------------------------------------------------------

def _comp(x: str, worst: float, best: float) -> str:
    return rnd(f"(least(greatest(({x} - {worst}e0) / ({best - worst}e0), 0.0e0), 1.0e0) * 100.0e0)")


_HEALTH_SUBS = {
    "delivery": (0.30, _comp("success_rate", 70.0, 95.0)),
    "rto": (0.25, _comp("rto_pct", 30.0, 5.0)),
    "on_time": (0.20, _comp("tat_in_pct", 60.0, 95.0)),
    "revenue": (0.15, _comp("(delivered_value / revenue * 100.0e0)", 55.0, 90.0)),
    "cod": (0.10, _comp("cod_rto", 30.0, 5.0)),
}
_HEALTH = f"""
SELECT *, CASE WHEN overall >= 85 THEN 'A' WHEN overall >= 75 THEN 'B' WHEN overall >= 62 THEN 'C'
    WHEN overall >= 48 THEN 'D' ELSE 'F' END AS grade,
  CASE WHEN overall >= 85 THEN 'excellent' WHEN overall >= 75 THEN 'healthy'
    WHEN overall >= 62 THEN 'mixed — watch the weak spots' WHEN overall >= 48 THEN 'under strain'
    ELSE 'critical — needs intervention' END AS verdict
FROM (SELECT {rnd('((0.0e0 + ' + ' + '.join(f'{k} * {w}e0' for k, (w, _) in _HEALTH_SUBS.items())
                  + ') / (0.0e0 + ' + ' + '.join(f'{w}e0' for w, _ in _HEALTH_SUBS.values()) + '))')} AS overall,
    * FROM (SELECT {', '.join(f'{sql} AS {k}' for k, (_, sql) in _HEALTH_SUBS.items())}
      FROM ({_SUMMARY}) s CROSS JOIN (SELECT rto_pct AS cod_rto FROM ({_PAYMENT}) p
        WHERE payment = 'COD') c) v) w"""


@query("agg_health_score", statement(_HEALTH))
def agg_health_score(i):
    rows = i.classified
    return reports.health_score(R.summary(rows), R.payment_performance(rows))


def _best(name, source, item, value, order, limit, label="NULL"):
    return f"""SELECT '{name}' AS slice, cast({item} AS VARCHAR) AS item, n, {value} AS value,
  {label} AS label FROM (SELECT * FROM ({source}) q ORDER BY {order}, {item} LIMIT {limit}) z"""


def _inr_sql(v: str) -> str:
    return (f"CASE WHEN {v} >= 1e7 THEN format('₹{{:.2f}}Cr', {rnd(v + ' / 1e7', 2)}) "
            f"WHEN {v} >= 1e5 THEN format('₹{{:.2f}}L', {rnd(v + ' / 1e5', 2)}) "
            f"ELSE format('₹{{:,}}', cast({rnd(v, 0)} AS BIGINT)) END")


_DIGEST = " UNION ALL ".join([
    _best("top_carriers", f"SELECT * FROM ({_BY_CARRIER}) c WHERE score IS NOT NULL", "carrier", "score", "score DESC", 6),
    _best("weakest_carriers", f"SELECT * FROM ({_BY_CARRIER}) c WHERE score IS NOT NULL", "carrier", "score", "score", 3),
    _best("weakest_warehouses", f"SELECT * FROM (SELECT * FROM ({_BY_WAREHOUSE}) w ORDER BY n DESC, pickup_pin LIMIT 10) v WHERE n >= 20 AND success_rate IS NOT NULL", "warehouse", "success_rate", "success_rate", 3),
    _best("weakest_destinations", f"SELECT * FROM ({_BY_DEST}) d WHERE n >= 20 AND success_rate IS NOT NULL", "drop_city", "success_rate", "success_rate", 4),
    _best("top_destinations", _BY_DEST, "drop_city", "success_rate", "n DESC", 5),
    _best("top_lanes", _BY_LANE, "lane", "rto_pct", "n DESC", 5),
    _best("top_categories", f"SELECT * FROM ({_TREE}) t WHERE level = 'category'", "category", "revenue", "revenue DESC", 6, _inr_sql("revenue")),
    _best("riskiest_categories", f"SELECT * FROM ({_TREE}) t WHERE level = 'category' AND n >= 20 AND rto_pct IS NOT NULL", "category", "rto_pct", "rto_pct DESC", 4),
    _best("best_products", f"SELECT * FROM ({_TREE}) t WHERE level = 'subcategory'", "item", "revenue", "revenue DESC", 5, _inr_sql("revenue")),
    _best("busiest_day", _DAILY, "date", "revenue", "n DESC", 1, _inr_sql("revenue")),
    _best("lightest_day", _DAILY, "date", "revenue", "n", 1, _inr_sql("revenue")),
])


@query("agg_digest", statement(_DIGEST))
def agg_digest(i):
    from parcelsight.session import cut_lineage
    return reports.digest(reports.shipment_report(
        cut_lineage(i.classified.select(*reports.DIGEST_READS), "digest"),
        only=["carriers", "warehouses", "destinations", "lanes", "products", "daily"]))


_EXPORT_SQL = ", ".join(
    ("o2s_us / 3.6e9" if c == "o2s" else c) + f' AS "{h}"'
    for c, h in S.SHIPMENT_EXPORT.items())
query("sink_shipments", statement(f"SELECT {_EXPORT_SQL} FROM classified WHERE payment = 'COD'"))(
    lambda i: reports.shipment_export(FL.filter_shipments(i.classified, Filters(payment="COD"))))

_PUBLIC = [c for c in ("total", "picked", "delivered", "rto", "success_rate", "rto_pct", "avg_p2o",
                       "avg_p2d", "avg_o2s", "carriers", "warehouses", "ndd_orders", "pending_orders",
                       "cancelled_orders", "ndd_pct", "tat_in", "tat_out", "tat_in_pct",
                       "tat_out_pct", "tat_pending", "tat_pending_pct", "tat_out_delivered",
                       "tat_out_pending")]
query("sink_public_view", statement(f"SELECT {', '.join(_PUBLIC)} FROM ({_SUMMARY}) s"))(
    lambda i: reports.public_report(
        reports.shipment_report(i.classified, only=["summary", "payment"]))["summary"])


@query("sink_daily_override", statement(_ORDERS_PER_DAY))
def sink_daily_override(i):
    daily = O.orders_per_day(i.fx.oms_orders, i.facts)
    return reports.shipment_report(i.classified, daily_orders=daily, only=["daily"])["daily"]


@query("sink_report")
def sink_report(i):
    """Every section written to its own directory, then counted."""
    from parcelsight.session import cut_lineage, shared_folder
    report = reports.shipment_report(
        cut_lineage(i.classified.select(*reports.REPORT_READS), "rows"))
    folder = shared_folder(i.spark, "report")
    reports.write_report(report, folder)
    out = None
    for name in report:
        part = i.spark.read.parquet(f"{folder}/{name}").agg(F.count("*").alias("rows")) \
            .select(F.lit(name).alias("section"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


@query("sink_overrides", statement("SELECT carrier_rule, origin_pin, pincode, tat, seq FROM overrides"))
def sink_overrides(i):
    from parcelsight.session import shared_folder
    folder = shared_folder(i.spark, "overrides")
    clean = i.overrides
    reports.write_overrides(clean, folder)
    back = i.spark.read.schema(clean.schema).parquet(folder)
    return back.select(*clean.columns)
