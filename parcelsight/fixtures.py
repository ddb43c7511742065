"""Logistics tables derived from the given star-schema tables.

The statements use only syntax that Spark SQL and DuckDB share, except for adding hours;
`fixture_sql` spells that for either engine, so the check tool sees the same input.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from parcelsight.session import prepare

AS_OF = "2001-08-15 00:00:00"


def _plus_hours(engine: str, ts: str, hours: str) -> str:
    if engine == "spark":
        return f"timestampadd(HOUR, cast({hours} as int), {ts})"
    return f"({ts} + to_hours(cast({hours} as bigint)))"


def _pick(engine: str, index: str, *values: str) -> str:
    """Constant list element at a zero-based index."""
    items = ", ".join(f"'{v}'" for v in values)
    if engine == "spark":
        return f"element_at(array({items}), cast({index} AS int) + 1)"
    return f"list_extract(list_value({items}), cast({index} AS bigint) + 1)"


_KIND = "substr(p_name, instr(p_name, ' ') + 1)"


def _phrase() -> str:
    return f"""concat(substr(p_name, 1, instr(p_name, ' ')), CASE {_KIND}
    WHEN 'anvil' THEN 'Pregnancy Pillow' WHEN 'bolt' THEN 'Arch Insole'
    WHEN 'gear' THEN 'Office Chair' WHEN 'gizmo' THEN 'Wheelchair'
    WHEN 'plate' THEN 'Barefoot Sock Shoe' WHEN 'ring' THEN 'Neck Pillow Combo'
    WHEN 'rod' THEN 'Knee Brace' ELSE 'Card Wallet' END)"""


def _part_names(engine: str) -> str:
    return f"""
SELECT p_partkey, p_size, {_KIND} AS kind,
  {_phrase()} AS phrase
FROM part"""


#: Order lines with what shipments are derived from: keys and plain columns, narrower than the derived text.
#: Customers meet orders before lines do, and the widest rows, those of orders, are met last.
_SHIPMENTS_JOINED = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag, l_linestatus,
  p_name, s_suppkey, s_nationkey, o_custkey, o_totalprice, o_orderdate, payment
FROM lineitem
JOIN supplier ON l_suppkey = s_suppkey
JOIN part ON l_partkey = p_partkey
JOIN (SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, payment
  FROM orders
  JOIN (SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'cod'
      ELSE 'PREPAID' END AS payment FROM customer) c ON o_custkey = c_custkey) o ON l_orderkey = o_orderkey"""


def _shipment_source(engine: str) -> str:
    """The joined tables with the attributes that each gives."""
    def pick(index, *values):
        return _pick(engine, index, *values)

    drop_pin = _drop_pin(engine, "o_custkey")
    town = f"""{pick('o_custkey % 12', 'PUNE', ' mumbai ', 'NEW  DELHI', 'bengaluru', 'JAIPUR', 'Guwahati',
            'SRINAGAR', 'gangtok', 'KOCHI', 'MUZAFFARPUR', 'CHENNAI', '')}"""
    channel = pick('o_custkey % 5', 'SHOPIFY_IN', 'AMAZON_API_NEW', 'CUSTOM', 'B2B', 'MARKETPLACE')
    pickup_pin = f"""{pick('s_nationkey % 7', '412106', '421302', '122001', '712223', '501401', '562114',
            '600052')}"""
    partner = f"""{pick('s_suppkey % 9', 'Blue Dart', 'Delhivery', 'Swift', 'Elastic Express', 'Skye',
            'Shadowfax', 'Shiprocket', 'Ekart', 'Delhivery Reverse')}"""
    if engine == "spark":
        return f"""(SELECT *, {drop_pin} AS drop_pin, {town} AS town, {channel} AS channel,
    {_phrase()} AS phrase, {pickup_pin} AS pickup_pin, {partner} AS partner
  FROM shipments_joined) j"""
    return f"""lineitem
  JOIN (SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate,
      {drop_pin} AS drop_pin,
      {town} AS town,
      {channel}
        AS channel
    FROM orders) o ON l_orderkey = o_orderkey
  JOIN (SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'cod'
      ELSE 'PREPAID' END AS payment FROM customer) c ON o_custkey = c_custkey
  JOIN ({_part_names(engine)}) p ON l_partkey = p_partkey
  JOIN (SELECT s_suppkey,
      {pickup_pin} AS pickup_pin,
      {partner} AS partner
    FROM supplier) s ON l_suppkey = s_suppkey"""


def _shipments(engine: str) -> str:
    """One row per order line; attributes are derived from the rows of `_shipment_source`."""
    def plus(ts, h):
        return _plus_hours(engine, ts, h)

    def pick(index, *values):
        return _pick(engine, index, *values)

    return f"""
SELECT *,
  CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN NULL
       ELSE {plus('pickup_ts', '12 + (l_partkey * 7) % 96')} END AS ofd1_ts,
  CASE WHEN l_returnflag = 'A' OR (l_returnflag = 'N' AND l_linestatus = 'F')
       THEN {plus('pickup_ts', '20 + (l_partkey * 7) % 96 + (l_linenumber * 5) % 48')}
       END AS delivery_ts,
  CASE WHEN l_suppkey % 9 <> 4
       THEN {plus('pickup_ts', '24 * (1 + l_suppkey % 5)')} END AS edd_ts
FROM (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice,
    l_returnflag, l_linestatus,
    CASE WHEN l_partkey % 97 = 0 THEN ' ' ELSE partner END AS carrier,
    concat(partner, CASE WHEN l_suppkey % 9 = 3 THEN '_ElasticRun'
      ELSE {pick('l_partkey % 3', '_NDD', '_STD', '_Large')} END) AS account,
    concat(cast(l_orderkey AS string), '-', cast(l_linenumber AS string), '-',
           cast(l_partkey AS string), '-', cast(l_suppkey AS string), '-',
           cast(cast(l_quantity AS int) AS string)) AS awb,
    CASE WHEN l_partkey % 41 = 0 THEN '' ELSE cast(l_orderkey AS string) END AS order_id,
    l_quantity * 250 AS weight, payment,
    CASE WHEN l_linenumber % 4 = 0 THEN concat(pickup_pin, '.0') ELSE pickup_pin END AS pickup_pin,
    drop_pin,
    CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE town END AS drop_city,
    {pick('l_linenumber % 4', 'North', 'South', 'West', '')} AS zone, channel,
    CASE WHEN l_suppkey % 9 = 8 AND l_linenumber % 2 = 0 THEN 'REVERSE PICKUP'
      WHEN l_suppkey % 9 = 7 AND l_linenumber = 7 THEN 'RVP' ELSE 'FORWARD' END AS delivery_type,
    CASE WHEN l_returnflag = 'R' THEN 'RTO-Delivered'
      WHEN l_returnflag = 'A' OR l_linestatus = 'F' THEN 'Delivered'
      ELSE {pick('l_partkey % 6', 'InTransit', 'OutForDelivery', 'Lost', 'RTO', 'pickuppending',
                 'Cancelled')} END AS status,
    1 + l_linenumber % 3 AS attempts,
    CASE WHEN l_linenumber = 6 THEN o_totalprice + 100 ELSE o_totalprice END AS order_value,
    CASE WHEN payment = 'cod' THEN o_totalprice END AS cod_value,
    concat('SKU-', cast(l_partkey AS string)) AS sku,
    CASE WHEN l_partkey % 53 = 0 THEN '' ELSE phrase END AS item_names,
    o_orderdate AS window_ts,
    CASE WHEN l_suppkey % 9 <> 8 THEN o_orderdate END AS order_ts,
    CASE WHEN l_linenumber = 7 AND l_returnflag = 'N' THEN NULL
         ELSE {plus('o_orderdate', '(l_partkey % 72) + 4')} END AS pickup_ts
  FROM {_shipment_source(engine)}
) base"""


def _oms(engine: str) -> str:
    return f"""
SELECT concat('#', cast(o_orderkey AS string)) AS order_code,
  {_pick(engine, 'o_custkey % 5', 'SHOPIFY_IN', 'AMAZON_API_NEW', 'custom', 'B2B', 'MARKETPLACE')}
    AS channel,
  {_plus_hours(engine, 'o_orderdate', 'o_orderkey % 20')} AS order_ts
FROM orders"""


_INVOICE_LINES = """
SELECT carrier,
  CASE WHEN l_suppkey % 9 = 2 THEN '' ELSE awb END AS awb,
  CASE WHEN l_suppkey % 9 = 0 THEN ''
       ELSE concat('#', cast(l_orderkey AS string), '_R', cast(l_partkey % 7 AS string)) END
    AS order_id,
  CASE WHEN l_partkey % 11 = 0 THEN ''
       WHEN l_partkey % 10 = 0 THEN concat(sku, ', SKU-', cast(l_partkey - 1 AS string))
       ELSE sku END AS sku,
  CASE WHEN l_partkey % 4 = 1 THEN '' ELSE item_names END AS product,
  CASE WHEN l_partkey % 4 = 1 THEN '' ELSE item_names END AS sku_name,
  'Others' AS category,
  weight / 1000 * (CASE WHEN l_partkey % 4 = 0 THEN 2.5e0 ELSE 1.0e0 END) AS weight_kg,
  CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN 'North' ELSE 'West' END AS zone,
  floor(l_extendedprice * 0.236e0 + 0.5e0) / 100.0e0 AS amount,
  floor(l_extendedprice * 0.2e0 + 0.5e0) / 100.0e0 AS amount_ex_gst,
  cast(1 AS bigint) AS shipments,
  CASE WHEN l_partkey % 89 = 0 THEN '' ELSE concat(upper(substr(carrier, 1, 3)), '-',
    cast(year(coalesce(pickup_ts, order_ts)) AS string), '-',
    lpad(cast(month(coalesce(pickup_ts, order_ts)) AS string), 2, '0')) END AS invoice_number,
  CASE WHEN l_partkey % 5 = 0 THEN '' ELSE
    concat(cast(year(coalesce(pickup_ts, order_ts)) AS string), '-',
    lpad(cast(month(coalesce(pickup_ts, order_ts)) AS string), 2, '0'), '-28') END AS invoice_date,
  concat(cast(year(coalesce(pickup_ts, order_ts)) AS string), '-',
    lpad(cast(month(coalesce(pickup_ts, order_ts)) AS string), 2, '0')) AS service_month_key,
  'FORWARD' AS direction,
  concat(carrier, '/', cast(year(coalesce(pickup_ts, order_ts)) + 20 AS string), '-',
    lpad(cast(month(coalesce(pickup_ts, order_ts)) AS string), 2, '0'), '/bill.csv') AS path
FROM shipments_raw
WHERE l_suppkey % 9 <> 8 AND trim(carrier) <> ''"""

def _item_master(engine: str) -> str:
    return f"""
SELECT concat('sku-', cast(p_partkey AS string)) AS sku,
  CASE WHEN p_partkey % 3 = 0 THEN concat('0-1-', cast(p_partkey AS string), '-7') ELSE '' END AS awb,
  CASE kind WHEN 'anvil' THEN 'Maternity' WHEN 'bolt' THEN 'Insoles'
    WHEN 'gear' THEN 'Chairs | Desks' WHEN 'gizmo' THEN 'Mobility' WHEN 'plate' THEN 'Barefoot'
    WHEN 'ring' THEN 'Combo' WHEN 'rod' THEN 'Orthotics' ELSE 'Unlisted' END AS category,
  CASE WHEN p_partkey % 17 = 0 THEN '#N/A'
    WHEN kind = 'ring' AND p_partkey % 2 = 0 THEN 'Flat Feet Combo' ELSE phrase END AS product,
  CASE WHEN p_partkey % 19 = 0 THEN '0' ELSE cast(p_size / 10.0e0 AS string) END AS vol_kg
FROM ({_part_names(engine)}) p WHERE p_partkey % 13 <> 0"""


def _drop_pin(engine: str, customer: str) -> str:
    """A customer's pincode."""
    area = _pick(engine, f"{customer} % 12", "411", "400", "110", "560", "302", "781", "190", "737",
                 "682", "842", "600", "999")
    return f"concat({area}, lpad(cast({customer} % 50 AS string), 3, '0'))"


# Lanes for every rule, hub and pincode of a customer; every fifth is left out.
_SLA_LANES = """
SELECT r.rule, 'primary' AS tier, CASE WHEN r.drop_only = 1 THEN NULL ELSE r.hub END AS warehouse,
  cast(NULL AS string) AS payment, p.drop_pin, cast(NULL AS string) AS pickup_city,
  cast(NULL AS string) AS drop_city,
  cast(CASE WHEN r.idx IN (1, 9) THEN 24 * (1 + (cast(p.drop_pin AS int) + r.idx) % 6)
       WHEN r.idx = 8 THEN (cast(p.drop_pin AS int) + r.wi) % 4
       ELSE 1 + (cast(p.drop_pin AS int) + r.idx + r.wi) % 4 END AS double) AS tat
FROM (SELECT * FROM (VALUES
  (1, 'Bluedart', 1), (2, 'Delhivery NDD', 0), (3, 'Swift NDD', 0), (4, 'GoSwift', 0),
  (5, 'Elastic Run', 1), (6, 'Skye Air', 1), (7, 'Shadowfax Large', 0), (8, 'Shadowfax', 0),
  (9, 'Shiprocket', 1)) AS a(idx, rule, drop_only)
  JOIN (VALUES (0, 'CAH'), (1, 'BOM'), (2, 'GGN'), (3, 'HOG'), (4, 'HYD'), (5, 'BLR'), (6, 'MAA'))
    AS b(wi, hub) ON a.drop_only = 0 OR b.wi = 0) r
JOIN (SELECT DISTINCT <<pin>> AS drop_pin FROM customer) p
  ON (cast(p.drop_pin AS int) + r.idx + r.wi) % 5 <> 0
UNION ALL
SELECT 'GoSwift', 'default', h.hub, cast(NULL AS string), p.drop_pin, cast(NULL AS string),
  cast(NULL AS string), cast(5 AS double)
FROM (VALUES (0, 'CAH'), (1, 'BOM'), (2, 'GGN'), (3, 'HOG'), (4, 'HYD'), (5, 'BLR')) AS h(wi, hub)
JOIN (SELECT DISTINCT <<pin>> AS drop_pin FROM customer) p
  ON (cast(p.drop_pin AS int) + 4 + h.wi) % 5 = 0 AND cast(p.drop_pin AS int) % 2 = 0
UNION ALL
SELECT 'GoSwift', 'city', cast(NULL AS string), cast(NULL AS string), cast(NULL AS string),
  c.a, c.b, cast(c.t AS double)
FROM (VALUES ('BANGALORE', 'CHENNAI', 3), ('DELHI', 'JAIPUR', 2), ('KOLKATA', 'PUNE', 4),
  ('CHENNAI', 'KOCHI', 2), ('MUMBAI', 'NEW DELHI', 3)) AS c(a, b, t)"""

# Overrides for two rules, with rows that must be dropped and later duplicates that win.
_SLA_OVERRIDES = """
SELECT o.rule AS carrier_rule, o.origin AS origin_pin,
  CASE WHEN p.k % 23 = 0 THEN substr(p.drop_pin, 1, 5) ELSE p.drop_pin END AS pincode,
  CASE WHEN p.k % 29 = 0 THEN 'soon' ELSE cast(o.base + p.k % 3 AS string) END AS tat,
  o.seq * 1000000 + p.k AS seq
FROM (VALUES ('Bluedart', '412106', 48, 1), ('Bluedart', '', 72, 2), ('Bluedart', '412106', 24, 3),
  ('GoSwift', 'any', 2, 1), ('GoSwift', '12200', 1, 2)) AS o(rule, origin, base, seq)
JOIN (SELECT drop_pin, cast(drop_pin AS int) % 1000 AS k
      FROM (SELECT DISTINCT <<pin>> AS drop_pin FROM customer) d) p
  ON p.k % 2 = 0"""


def fixture_sql(engine: str) -> dict[str, str]:
    """Name -> statement; later statements read earlier names."""
    pin = _drop_pin(engine, "c_custkey")
    joined = {"shipments_joined": _SHIPMENTS_JOINED} if engine == "spark" else {}
    return joined | {
        "shipments_raw": _shipments(engine),
        "oms_orders": _oms(engine),
        "invoice_raw": _INVOICE_LINES,
        "item_master_raw": _item_master(engine),
        "sla_lanes": _SLA_LANES.replace("<<pin>>", pin),
        "sla_overrides_raw": _SLA_OVERRIDES.replace("<<pin>>", pin),
    }


class Fixtures:
    """The derived tables of one data folder, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = prepare(spark), folder
        self._sql = fixture_sql("spark")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _run(self, name: str, *tables: str, **derived: DataFrame) -> DataFrame:
        frames = {t: self.table(t) for t in tables} | derived
        statement = self._sql[name]
        for key in frames:
            statement = re.sub(rf"\b(FROM|JOIN) {key}\b", rf"\1 {{{key}}}", statement)
        return self.spark.sql(statement, **frames)

    @cached_property
    def shipments_joined(self) -> DataFrame:
        return self._run("shipments_joined", "lineitem", "orders", "customer", "part", "supplier")

    @cached_property
    def shipments_raw(self) -> DataFrame:
        return self._run("shipments_raw", shipments_joined=self.shipments_joined)

    @cached_property
    def oms_orders(self) -> DataFrame:
        return self._run("oms_orders", "orders")

    @cached_property
    def invoice_raw(self) -> DataFrame:
        return self._run("invoice_raw", shipments_raw=self.shipments_raw)

    @cached_property
    def item_master_raw(self) -> DataFrame:
        return self._run("item_master_raw", "part")

    @cached_property
    def sla_lanes(self) -> DataFrame:
        return self._run("sla_lanes", "customer")

    @cached_property
    def sla_overrides_raw(self) -> DataFrame:
        return self._run("sla_overrides_raw", "customer")
