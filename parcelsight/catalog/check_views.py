"""DuckDB statements for the same inputs and records, written independently of the operators.

`statement(body)` prepends the views a body uses, directly or not, as WITH clauses.
"""

from __future__ import annotations

import re

from parcelsight.fixtures import AS_OF, fixture_sql
from parcelsight.rules import geo as G
from parcelsight.rules import products as P
from parcelsight.rules import shipments as S
from parcelsight.rules.sla import REVERSE_TAT_DAYS, SLA_RULES

NOW = f"TIMESTAMP '{AS_OF}'"


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(lit(x) for x in v) + "]::VARCHAR[]"
    if isinstance(v, float):
        return f"{v!r}::DOUBLE"
    if isinstance(v, int):
        return str(v)
    return "'" + str(v).replace("'", "''") + "'"


def values(rows, names: str) -> str:
    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({names})"


def rnd(x: str, digits: int = 1) -> str:
    scale = f"{10 ** digits}.0e0"
    return f"(sign({x}) * floor(abs({x}) * {scale} + 0.5e0) / {scale})"


def pct(a: str, b: str) -> str:
    return f"(cast({a} AS DOUBLE) / nullif(cast({b} AS DOUBLE), 0) * 100.0e0)"


def div(a: str, b: str) -> str:
    return f"(cast({a} AS DOUBLE) / nullif(cast({b} AS DOUBLE), 0))"


def paise(x: str) -> str:
    return f"cast(floor(abs({x}) * 100 + 0.5e0) * sign({x}) AS BIGINT)"


def rupees(x: str) -> str:
    return f"(cast({x} AS DOUBLE) / 100.0e0)"


def big(x: str) -> str:
    return f"cast({x} AS BIGINT)"


def title(x: str) -> str:
    return (f"array_to_string(list_transform(string_split(lower({x}), ' '), "
            "lambda w: upper(w[1]) || w[2:]), ' ')")


def gap(a: str, b: str) -> str:
    d = f"date_diff('microsecond', {a}, {b})"
    return f"CASE WHEN {d} >= 0 THEN {d} END"


def days(a: str, b: str) -> str:
    d = f"date_diff('day', cast({a} AS DATE), cast({b} AS DATE))"
    return f"cast(CASE WHEN {d} >= 0 THEN {d} END AS INTEGER)"


def mean_hours(us: str) -> str:
    return (f"((cast(sum({us} // 1000000) AS DOUBLE) + cast(sum({us} % 1000000) AS DOUBLE) / 1e6)"
            f" / cast(nullif(count({us}), 0) AS DOUBLE) / 3600.0e0)")


def norm_order(x: str) -> str:
    return f"upper(trim(regexp_replace(regexp_replace(trim({x}), '^#', ''), '_.*$', '')))"


def kpi(source: str, keys: list[str], carry: dict | None = None) -> str:
    """Unrounded KPI block."""
    select = "".join(f"{k}, " for k in keys)
    where = " AND ".join(f"coalesce({k}, '') <> ''" for k in keys) or "true"
    extra = "".join(f", min({src}) AS {out}" for out, src in (carry or {}).items())
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""
SELECT {select}count(*) AS n, {big('count_if(picked)')} AS picked,
  {big('count_if(delivered)')} AS delivered,
  {big('count_if(delivered AND attempts = 1)')} AS first_attempt,
  {big("count_if(outcome = 'RTO')")} AS rto, median(o2s_us) / 3.6e9 AS o2s,
  {mean_hours('p2o_us')} AS p2o, {mean_hours('p2d_us')} AS p2d,
  {div('sum(attempts)', 'count(attempts)')} AS avg_attempts{extra},
  {pct('count_if(delivered)', 'count_if(picked)')} AS success_rate,
  {pct('count_if(delivered AND attempts = 1)', 'count_if(delivered)')} AS first_attempt_rate,
  {pct("count_if(outcome = 'RTO')", 'count(*)')} AS rto_pct
FROM {source} WHERE {where} {group}"""


def scored(block: str, min_n: int, keys: str, carry: str = "", partition: str = "") -> str:
    """Scores and display rounding over a KPI block given as a FROM item."""
    over = f"OVER (PARTITION BY {partition})" if partition else "OVER ()"
    subs, parts, weights = [], [], []
    for m, (w, lower) in S.SCORE_WEIGHTS.items():
        v = f"CASE WHEN n >= {min_n} THEN {m} END"
        up = f"(({m} - min({v}) {over}) / (max({v}) {over} - min({v}) {over}))"
        scaled = f"(1.0e0 - {up}) * 100.0e0" if lower else f"{up} * 100.0e0"
        subs.append(f"""CASE WHEN n >= {min_n} AND {m} IS NOT NULL AND count({v}) {over} >= 2 THEN
          CASE WHEN max({v}) {over} = min({v}) {over} THEN 100.0e0 ELSE {scaled} END END AS s_{m}""")
        parts.append(f"coalesce(s_{m} * {w}e0, 0.0e0)")
        weights.append(f"CASE WHEN s_{m} IS NOT NULL THEN {w}e0 ELSE 0.0e0 END")
    total, weight = "0.0e0 + " + " + ".join(parts), "0.0e0 + " + " + ".join(weights)
    rounded_subs = ", ".join(f"{rnd('s_' + m)} AS sub_{m}" for m in S.SCORE_WEIGHTS)
    one = ", ".join(f"{rnd(m)} AS {m}" for m in
                    ("o2s", "p2o", "p2d", "success_rate", "first_attempt_rate", "rto_pct"))
    score = f"CASE WHEN ({weight}) > 0 THEN ({total}) / ({weight}) END"
    return f"""
SELECT {keys}, n, picked, delivered, first_attempt, rto, {one},
  {rnd('avg_attempts', 2)} AS avg_attempts{carry}, {rounded_subs}, {rnd(score)} AS score
FROM (SELECT *, {', '.join(subs)} FROM ({block}) b) s"""


def _circles():
    return list(G.CIRCLE_BY_PIN2.items())


def _sla_rows():
    return [(i, r.name, list(r.carrier), list(r.account), list(r.exclude), r.unit, r.drop_only,
             None if r.default_tat is None else float(r.default_tat), r.basis, r.ignore_edd,
             r.grace_hours, float(r.offset_days)) for i, r in enumerate(SLA_RULES)]


def _digits(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '[^0-9]', '', 'g')"


VIEWS: dict[str, str] = {}
VIEWS.update(fixture_sql("duckdb"))
VIEWS.update({
    "o_city": values(G.CITY_BY_PIN3.items(), "p, city"),
    "o_circle": values(_circles(), "p, circle"),
    "o_tier1": values([(p,) for p in G.TIER1_PIN3], "p"),
    "o_tier2": values([(p,) for p in G.TIER2_PIN3], "p"),
    "o_hub": values(G.HUB_BY_PIN.items(), "pin, hub"),
    "o_hub3": values(G.HUB_BY_PIN3.items(), "p, hub"),
    "o_alias": values(G.PICKUP_CITY_ALIAS.items(), "city, alias"),
    "o_group": values(P.DISPLAY_GROUP.items(), "fine, grp"),
    "o_states": values([(s,) for s in S.PENDENCY_STATES], "state"),
    "o_rules": values([(i, c, s, k) for i, (c, s, ks) in enumerate(P.PRODUCT_RULES) for k in ks],
                      "ix, category, subcategory, kw"),
    "o_inv_rules": values([(i, c, k) for i, (c, ks) in enumerate(P.INVOICE_RULES) for k in ks],
                          "ix, category, kw"),
    "o_explicit": values(P.EXPLICIT_CATEGORY.items(), "label, category"),
    "o_sla": values(_sla_rows(), "ix, rule, car, acc, exc, unit, drop_only, default_tat, basis, "
                    "ignore_edd, grace, offs"),
    "o_products": """
SELECT n.item_name, CASE WHEN n.item_name = '' THEN 'Unknown'
    ELSE coalesce(arg_min(r.category, r.ix), 'Accessories & Others') END AS category,
  CASE WHEN n.item_name = '' THEN 'Unknown' ELSE coalesce(arg_min(r.subcategory, r.ix), 'Other') END
    AS subcategory
FROM (SELECT DISTINCT item_names AS item_name FROM shipments_raw) n
LEFT JOIN o_rules r ON contains(lower(n.item_name), r.kw) GROUP BY n.item_name""",
    "facts": f"""
SELECT trim(carrier) AS carrier, account, delivery_type, zone, channel, upper(payment) AS payment,
  cast(cast(cast(pickup_pin AS DOUBLE) AS BIGINT) AS VARCHAR) AS pickup_pin, drop_pin,
  {title("regexp_replace(trim(drop_city), ' +', ' ', 'g')")} AS raw_city,
  cast(weight AS DOUBLE) AS weight, cast(attempts AS DOUBLE) AS attempts, order_value, cod_value,
  status, sku, awb, order_id, item_name, p.category, p.subcategory,
  pickup_ts, order_ts, window_ts, ofd1_ts, delivery_ts, edd_ts,
  {gap('order_ts', 'pickup_ts')} AS o2s_us, {gap('pickup_ts', 'ofd1_ts')} AS p2o_us,
  {gap('pickup_ts', 'delivery_ts')} AS p2d_us, {gap('pickup_ts', NOW)} AS age_us,
  {days('pickup_ts', 'delivery_ts')} AS transit_days, {days('pickup_ts', NOW)} AS age_days,
  {days('pickup_ts', 'ofd1_ts')} AS ofd1_days, {days('pickup_ts', 'edd_ts')} AS edd_days,
  cast(pickup_ts AS DATE) AS pickup_date, cast(order_ts AS DATE) AS order_date,
  cast(window_ts AS DATE) AS window_date, pickup_ts IS NOT NULL AS picked,
  lower(status) = 'delivered' AS delivered,
  CASE WHEN lower(status) = 'delivered' THEN 'Delivered'
    WHEN regexp_matches(lower(status), '^rto[- ]') THEN 'RTO'
    WHEN lower(status) IN ('cancelled', 'notserviceable', 'lost', 'damaged', 'nostatusexist')
      THEN 'Cancelled'
    WHEN pickup_ts IS NULL AND date_diff('day', cast(order_ts AS DATE), DATE '{AS_OF[:10]}') >= 30
      THEN 'Cancelled'
    ELSE 'FWD Pendency' END AS outcome,
  coalesce((SELECT state FROM o_states WHERE lower(state) = lower(status)), 'Other')
    AS pendency_state,
  CASE WHEN weight <= 3000 THEN 'Light' WHEN weight <= 10000 THEN 'Medium' ELSE 'Heavy' END
    AS weight_class,
  CASE WHEN pickup_ts IS NULL THEN 'Unknown' WHEN hour(pickup_ts) < 12 THEN 'Before 12pm'
    WHEN hour(pickup_ts) >= 17 THEN 'After 5pm'
    ELSE concat(cast((hour(pickup_ts) + 11) % 12 + 1 AS VARCHAR), '–',
                cast(hour(pickup_ts) - 11 AS VARCHAR), 'pm') END AS pickup_slot,
  regexp_matches(lower(delivery_type || '|' || carrier), 'revers|rvp') AS is_reverse,
  lower(account) = 'test' OR
    regexp_matches(lower(account), 'ndd|skye|urbanbolt|urbane|elasticrun|shadofax|shadowfax')
    AS is_ndd
FROM (SELECT *, item_names AS item_name FROM shipments_raw WHERE trim(carrier) <> '') f
JOIN o_products p USING (item_name)""",
    "ships": f"""
SELECT *, CASE WHEN city <> '' AND drop_city <> '' THEN concat(city, ' → ', drop_city) ELSE '' END
  AS lane, CASE WHEN city <> '' THEN concat(city, ' · ', pickup_pin) ELSE pickup_pin END AS warehouse
FROM (
  SELECT f.*,
    coalesce(pc.city, pk.circle, 'PIN ' || left(pickup_pin, 3) || 'xx') AS city,
    CASE WHEN raw_city <> '' THEN raw_city
      ELSE coalesce(dc.city, dk.circle, 'PIN ' || left(drop_pin, 3) || 'xx') END AS drop_city,
    CASE WHEN t1.p IS NOT NULL THEN 'Tier 1' WHEN t2.p IS NOT NULL THEN 'Tier 2' ELSE 'Tier 3' END
      AS tier,
    CASE WHEN left(pickup_pin, 3) = left(drop_pin, 3)
        OR split_part(pc.city, ' (', 1) = split_part(dc.city, ' (', 1) THEN 'A'
      WHEN left(drop_pin, 2) IN ('18', '19', '78', '79') OR left(drop_pin, 3) = '737' THEN 'E'
      WHEN t1.p IS NOT NULL THEN 'B' ELSE 'C' END AS geo_zone,
    coalesce(h.hub, h3.hub, '') AS hub
  FROM facts f
  LEFT JOIN o_city pc ON pc.p = left(pickup_pin, 3) LEFT JOIN o_circle pk ON pk.p = left(pickup_pin, 2)
  LEFT JOIN o_city dc ON dc.p = left(drop_pin, 3) LEFT JOIN o_circle dk ON dk.p = left(drop_pin, 2)
  LEFT JOIN o_tier1 t1 ON t1.p = left(drop_pin, 3) LEFT JOIN o_tier2 t2 ON t2.p = left(drop_pin, 3)
  LEFT JOIN o_hub h ON h.pin = pickup_pin LEFT JOIN o_hub3 h3 ON h3.p = left(pickup_pin, 3)
) g""",
    "o_matched": """
SELECT carrier, account, min(ix) AS rule_ix FROM (SELECT DISTINCT carrier, account FROM ships) p
JOIN o_sla s ON (len(s.car) = 0 OR len(list_filter(s.car, lambda t: contains(lower(p.carrier), t))) > 0)
  AND (len(s.acc) = 0 OR len(list_filter(s.acc, lambda t: contains(lower(p.account), t))) > 0)
  AND len(list_filter(s.exc, lambda t: contains(lower(p.carrier), t)
                                    OR contains(lower(p.account), t))) = 0
GROUP BY carrier, account""",
    "overrides": f"""
SELECT carrier_rule, origin_pin, pincode, tat, seq FROM (
  SELECT carrier_rule, seq, {_digits('pincode')} AS pincode, try_cast(tat AS DOUBLE) AS tat,
    CASE WHEN upper(trim(origin_pin)) IN ('', 'ANY') THEN 'ANY'
      WHEN length({_digits('origin_pin')}) = 6 THEN {_digits('origin_pin')} END AS origin_pin
  FROM sla_overrides_raw) x
WHERE origin_pin IS NOT NULL AND length(pincode) = 6 AND tat IS NOT NULL""",
    "o_override": """
SELECT carrier_rule, origin_pin, pincode, tat FROM overrides
QUALIFY row_number() OVER (PARTITION BY carrier_rule, origin_pin, pincode ORDER BY seq DESC) = 1""",
    "sla_in": f"""
SELECT s.*, m.rule_ix, r.rule, r.unit, r.basis, r.ignore_edd, r.grace, r.offs, r.default_tat,
  lp.tat AS tat_primary, ld.tat AS tat_default, lc.tat AS tat_city,
  r.rule IN (SELECT carrier_rule FROM overrides) AS overridden,
  coalesce(oe.tat, oa.tat) AS tat_override
FROM ships s
LEFT JOIN o_matched m ON m.carrier = s.carrier AND m.account = s.account
LEFT JOIN o_sla r ON r.ix = m.rule_ix
LEFT JOIN sla_lanes lp ON lp.tier = 'primary' AND lp.rule = r.rule AND lp.drop_pin = s.drop_pin
  AND CASE WHEN r.drop_only THEN lp.warehouse IS NULL ELSE lp.warehouse = s.hub END
LEFT JOIN sla_lanes ld ON ld.tier = 'default' AND ld.rule = r.rule AND ld.drop_pin = s.drop_pin
  AND ld.warehouse = s.hub
LEFT JOIN o_alias al ON al.city = upper(s.city)
LEFT JOIN sla_lanes lc ON lc.tier = 'city' AND lc.rule = r.rule
  AND lc.pickup_city = coalesce(al.alias, upper(s.city)) AND lc.drop_city = upper(s.drop_city)
LEFT JOIN o_override oe ON oe.carrier_rule = r.rule AND oe.origin_pin = s.pickup_pin
  AND oe.pincode = s.drop_pin
LEFT JOIN o_override oa ON oa.carrier_rule = r.rule AND oa.origin_pin = 'ANY'
  AND oa.pincode = s.drop_pin""",
    "sla_promise": f"""
SELECT *, age_us / 3.6e9 AS age_hours, p2o_us / 3.6e9 AS p2o, p2d_us / 3.6e9 AS p2d,
  CASE WHEN is_reverse THEN 'reverse' WHEN rule_ix IS NULL THEN 'none'
    WHEN edd_days IS NOT NULL AND NOT overridden AND NOT ignore_edd THEN 'edd'
    WHEN basis = 'delivery' THEN 'delivery_' || unit ELSE 'ofd1_' || unit END AS measure,
  CASE WHEN overridden THEN tat_override
    ELSE coalesce(tat_primary, tat_default, default_tat, tat_city) + offs END AS lane_tat
FROM sla_in""",
    "sla_values": f"""
SELECT *,
  CASE measure WHEN 'reverse' THEN {REVERSE_TAT_DAYS}.0e0 WHEN 'edd' THEN cast(edd_days AS DOUBLE)
    WHEN 'none' THEN NULL ELSE lane_tat END AS promised_tat,
  CASE measure
    WHEN 'reverse' THEN CASE WHEN delivered THEN transit_days END
    WHEN 'edd' THEN CASE WHEN delivered AND transit_days IS NOT NULL THEN transit_days
                         WHEN outcome = 'RTO' THEN ofd1_days END
    WHEN 'delivery_days' THEN CASE WHEN delivered AND transit_days IS NOT NULL THEN transit_days
                                   WHEN outcome = 'RTO' THEN ofd1_days END
    WHEN 'delivery_hours' THEN CASE WHEN delivered AND p2d IS NOT NULL THEN p2d
                                    WHEN outcome = 'RTO' THEN p2o END
    WHEN 'ofd1_days' THEN ofd1_days WHEN 'ofd1_hours' THEN p2o END AS actual,
  CASE WHEN measure = 'reverse' THEN CASE WHEN NOT delivered THEN age_days END
    WHEN outcome = 'FWD Pendency' THEN
      CASE WHEN ends_with(measure, '_hours') THEN age_hours ELSE age_days END END AS waiting
FROM sla_promise""",
    "classified": """
SELECT *,
  CASE WHEN promised_tat IS NULL THEN 'No rule'
    WHEN actual IS NOT NULL THEN CASE WHEN actual <= promised_tat
      OR (starts_with(measure, 'ofd1') AND grace IS NOT NULL AND p2o <= grace) THEN 'In TAT'
      ELSE 'Out of TAT' END
    WHEN waiting > promised_tat THEN 'Out of TAT' ELSE 'Pending' END AS tat_status,
  CASE WHEN actual IS NOT NULL THEN promised_tat - actual
    WHEN waiting > promised_tat THEN promised_tat - waiting END AS tat_margin
FROM sla_values""",
    "rev": f"""
SELECT *, {paise("CASE WHEN order_id = '' OR row_number() OVER (PARTITION BY order_id, order_value ORDER BY awb) = 1 THEN coalesce(order_value, 0) ELSE 0 END")}
  AS rev_paise, coalesce(g.grp, category) AS display_group
FROM classified LEFT JOIN o_group g ON g.fine = category""",
    "d2c": f"""
SELECT {norm_order('order_code')} AS oid, cast(order_ts AS DATE) AS day, order_ts FROM oms_orders
WHERE upper(channel) LIKE '%SHOPIFY%' OR upper(channel) IN ('AMAZON_API_NEW', 'CUSTOM', 'B2B')""",
    "lines": """
SELECT * EXCLUDE (path),
  strftime(cast(month || '-01' AS DATE), '%B %Y') AS month_label
FROM (SELECT *, CASE WHEN carrier = 'Swift' THEN service_month_key
        ELSE split_part(path, '/', 2) END AS month FROM invoice_raw) r""",
    "master": f"""
SELECT m.sku, m.awb, m.product, upper(m.sku) AS sku_key,
  CASE WHEN vol_kg > 0 THEN vol_kg END AS vol_kg,
  CASE WHEN m.label = 'Combo' THEN CASE WHEN regexp_matches(lower(m.product), 'flat f(ee|oo)t')
      THEN 'Orthotics' ELSE 'Bundles' END
    ELSE coalesce(max(e.category), arg_min(r.category, r.ix), arg_min(q.category, q.ix), 'Others')
    END AS category
FROM (SELECT sku, awb, category AS label, CASE WHEN product = '#N/A' THEN '' ELSE product END
        AS product, cast(vol_kg AS DOUBLE) AS vol_kg FROM item_master_raw) m
LEFT JOIN o_explicit e ON e.label = lower(trim(split_part(m.label, '|', 1)))
LEFT JOIN o_inv_rules r ON contains(lower(m.product), r.kw)
LEFT JOIN o_inv_rules q ON contains(lower(m.label), q.kw)
GROUP BY m.sku, m.awb, m.product, m.vol_kg, m.label""",
    "m_sku": """
SELECT sku_key, category, CASE WHEN product <> '' THEN product ELSE sku END AS product FROM master
WHERE product <> '' OR category <> 'Others'""",
    "mastered": """
SELECT l.* EXCLUDE (category, product), coalesce(CASE WHEN s.category <> 'Others'
    THEN s.category END, l.category) AS category,
  CASE WHEN l.product = '' THEN coalesce(s.product, '') ELSE l.product END AS product
FROM (
  SELECT b.* EXCLUDE (category, product, sku),
    coalesce(CASE WHEN a.category <> 'Others' THEN a.category END, b.category) AS category,
    CASE WHEN b.product = '' AND a.awb IS NOT NULL
      THEN CASE WHEN a.product <> '' THEN a.product ELSE a.sku END ELSE b.product END AS product,
    CASE WHEN b.sku = '' THEN coalesce(a.sku, '') ELSE b.sku END AS sku
  FROM lines b LEFT JOIN (SELECT * FROM master WHERE awb <> '') a ON a.awb = b.awb AND b.awb <> '') l
LEFT JOIN m_sku s ON s.sku_key = upper(l.sku) AND l.category IN ('Others', 'Unknown', '')""",
    "by_order": """
SELECT order_id AS oid, arg_min(category, awb) AS category, arg_min(subcategory, awb) AS subcategory,
  arg_min(sku, awb) AS sku, arg_min(item_name, awb) AS item_name,
  arg_min(order_value, awb) AS order_value, arg_min(pickup_pin, awb) AS pickup_pin,
  arg_min(drop_pin, awb) AS drop_pin
FROM ships WHERE order_id <> '' GROUP BY order_id""",
    "matched": f"""
SELECT l.*, a.awb IS NOT NULL AS by_awb, o.oid IS NOT NULL AS by_order,
  {norm_order('l.order_id')} AS line_oid, coalesce(a.order_id, '') AS awb_order,
  CASE WHEN a.awb IS NOT NULL THEN a.category ELSE o.category END AS m_category,
  CASE WHEN a.awb IS NOT NULL THEN a.subcategory ELSE o.subcategory END AS m_subcategory,
  CASE WHEN a.awb IS NOT NULL THEN a.sku ELSE o.sku END AS m_sku,
  CASE WHEN a.awb IS NOT NULL THEN a.item_name ELSE o.item_name END AS m_name,
  CASE WHEN a.awb IS NOT NULL THEN a.order_value ELSE o.order_value END AS m_value,
  CASE WHEN a.awb IS NOT NULL THEN a.pickup_pin ELSE o.pickup_pin END AS m_pickup,
  CASE WHEN a.awb IS NOT NULL THEN a.drop_pin ELSE o.drop_pin END AS m_drop
FROM SOURCE l LEFT JOIN ships a ON a.awb = l.awb AND l.awb <> ''
LEFT JOIN by_order o ON o.oid = {norm_order('l.order_id')}""",
})
VIEWS["matched_lines"] = VIEWS["matched"].replace("FROM SOURCE l", "FROM lines l")
VIEWS["matched"] = VIEWS["matched"].replace("FROM SOURCE l", "FROM mastered l")
_ENRICHED = """
SELECT * EXCLUDE (category, sku, product, sku_name), by_awb OR by_order AS prod_matched,
  coalesce(m_subcategory, '') AS subcategory,
  CASE WHEN sku = '' THEN coalesce(m_sku, '') ELSE sku END AS sku,
  CASE WHEN product = '' THEN coalesce(m_name, '') ELSE product END AS product,
  CASE WHEN sku_name = '' AND product = '' THEN coalesce(m_name, '') ELSE sku_name END AS sku_name,
  CASE WHEN (by_awb OR by_order) AND m_category NOT IN ('Others', 'Unknown', '') THEN m_category
    ELSE category END AS category,
  m_value AS order_value, CASE WHEN line_oid <> '' THEN line_oid ELSE awb_order END AS order_key,
  coalesce(m_pickup, '') AS pickup_pin, coalesce(m_drop, '') AS drop_pin
FROM """
VIEWS["enriched"] = _ENRICHED + "matched"
VIEWS["attached"] = _ENRICHED + "matched_lines"
VIEWS.update({
    "sku_tokens": """
SELECT sku AS sku_text, unnest(list_transform(string_split_regex(sku, '[,/|]'),
    lambda t: upper(trim(t)))) AS token FROM (SELECT DISTINCT sku FROM enriched WHERE sku <> '') d""",
    "checks_in": """
SELECT e.*, w.grams / 1000.0e0 AS expected, w.skus_missing FROM enriched e JOIN (
  SELECT sku_text, sum(cast(floor(m.vol_kg * 1000 + 0.5e0) AS BIGINT)) AS grams,
    count(*) - count(m.vol_kg) AS skus_missing
  FROM sku_tokens t LEFT JOIN master m ON m.sku_key = t.token AND m.vol_kg IS NOT NULL
  GROUP BY sku_text) w ON w.sku_text = e.sku
WHERE w.grams IS NOT NULL AND e.weight_kg > 0""",
    "o_slabs": "SELECT i, s FROM (VALUES (0, 0.5e0), (1, 1.0e0), (2, 2.0e0), (3, 3.0e0), "
               "(4, 5.0e0), (5, 7.0e0), (6, 10.0e0)) AS t(i, s)",
    "checks": f"""
SELECT *, ci - ei >= 2 AS flagged, {rnd('weight_kg - es', 3)} AS excess,
  {rnd('weight_kg - es', 3)} * (amount / weight_kg) AS overcharge
FROM (
  SELECT *, CASE WHEN cs > 10 THEN 6 + cast(cs AS INTEGER) - 10
      ELSE (SELECT i FROM o_slabs WHERE s = cs) END AS ci,
    CASE WHEN es > 10 THEN 6 + cast(es AS INTEGER) - 10
      ELSE (SELECT i FROM o_slabs WHERE s = es) END AS ei
  FROM (
    SELECT *, coalesce((SELECT min(s) FROM o_slabs WHERE weight_kg <= s + 1e-9),
        ceil(weight_kg - 1e-9)) AS cs,
      coalesce((SELECT min(s) FROM o_slabs WHERE expected <= s + 1e-9), ceil(expected - 1e-9)) AS es
    FROM checks_in) x) y""",
})


def _uses(sql: str) -> list[str]:
    return [name for name in VIEWS if re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql)]


def statement(body: str) -> str:
    """A self-contained statement for DuckDB."""
    needed, queue = set(), _uses(body)
    while queue:
        name = queue.pop()
        if name not in needed:
            needed.add(name)
            queue += _uses(VIEWS[name])
    ctes = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in VIEWS if name in needed)
    return f"WITH {ctes}\n{body.strip()}" if ctes else body.strip()
