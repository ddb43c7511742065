"""Raw logical fields -> typed shipment records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelsight.functions import classify as C
from parcelsight.functions import geo
from parcelsight.functions import scalars as N
from parcelsight.functions import times as T
from parcelsight.rules.shipments import SHIPMENT_TABLE_COLUMNS

RAW_FIELDS = list(SHIPMENT_TABLE_COLUMNS)


def _raw(df: DataFrame, field: str) -> Column:
    return F.col(field) if field in df.columns else F.lit(None).cast("string")


def shipment_facts(raw: DataFrame, as_of) -> DataFrame:
    """Everything about a shipment that needs no lookup table.

    ``raw`` holds the logical fields, text or typed, in any subset; rows without a carrier
    are dropped. ``as_of`` is the clock reading ages are measured against.
    """
    kinds = {f.name: f.dataType for f in raw.schema.fields}
    now = F.lit(as_of).cast("timestamp_ntz")
    typed = raw.where(N.text(_raw(raw, "carrier")) != "").select(
        *[N.text(_raw(raw, f)).alias(f) for f in
          ("carrier", "account", "delivery_type", "zone", "channel", "status", "sku", "awb",
           "order_id")],
        N.text(_raw(raw, "item_names")).alias("item_name"),
        F.upper(N.text(_raw(raw, "payment"))).alias("payment"),
        N.norm_pincode(_raw(raw, "pickup_pin")).alias("pickup_pin"),
        N.norm_pincode(_raw(raw, "drop_pin")).alias("drop_pin"),
        N.clean_city(_raw(raw, "drop_city")).alias("drop_city"),
        *[N.to_number(_raw(raw, f), kinds.get(f)).alias(f) for f in
          ("weight", "attempts", "order_value", "cod_value")],
        *[(T.to_ts(F.col(f), kinds[f]) if f in kinds else F.lit(None).cast("timestamp_ntz"))
          .alias(f) for f in
          ("pickup_ts", "order_ts", "window_ts", "ofd1_ts", "delivery_ts", "edd_ts")],
    )
    timed = typed.withColumns({
        "o2s_us": T.micros_between(F.col("order_ts"), F.col("pickup_ts")),
        "p2o_us": T.micros_between(F.col("pickup_ts"), F.col("ofd1_ts")),
        "p2d_us": T.micros_between(F.col("pickup_ts"), F.col("delivery_ts")),
        "age_us": T.micros_between(F.col("pickup_ts"), now),
        "item_low": F.lower("item_name"),
        "account_low": F.lower("account"),
        "outcome": C.settled_outcome(C.status_outcome(F.col("status")), F.col("pickup_ts"),
                                     F.col("order_ts"), now),
    })
    return timed.withColumn("product_rule", C.product_rule("item_low")).withColumns({
        "o2s": T.hours(F.col("o2s_us")),
        "p2o": T.hours(F.col("p2o_us")),
        "p2d": T.hours(F.col("p2d_us")),
        "age_hours": T.hours(F.col("age_us")),
        "transit_days": T.days_between(F.col("pickup_ts"), F.col("delivery_ts")),
        "age_days": T.days_between(F.col("pickup_ts"), now),
        "ofd1_days": T.days_between(F.col("pickup_ts"), F.col("ofd1_ts")),
        "edd_days": T.days_between(F.col("pickup_ts"), F.col("edd_ts")),
        "pickup_date": F.col("pickup_ts").cast("date"),
        "order_date": F.col("order_ts").cast("date"),
        "window_date": F.col("window_ts").cast("date"),
        "picked": F.col("pickup_ts").isNotNull(),
        "delivered": F.lower(F.col("status")) == "delivered",
        "pendency_state": C.pendency_state(F.col("status")),
        "weight_class": C.weight_class(F.col("weight")),
        "pickup_slot": C.pickup_slot(F.col("pickup_ts")),
        "category": C.product_category(F.col("product_rule")),
        "subcategory": C.product_subcategory(F.col("product_rule")),
        "is_reverse": C.is_reverse(F.col("delivery_type"), F.col("carrier")),
        "is_ndd": C.is_ndd("account_low"),
    }).drop("product_rule", "item_low", "account_low", "age_us")


def add_geography(facts: DataFrame) -> DataFrame:
    """City, warehouse, lane, tier, delivery zone and hub from the two pincodes.

    Two lookups in a broadcast table of 1100 rows; nothing is shuffled.
    """
    both = geo.join_prefix(geo.join_prefix(facts, F.col("pickup_pin"), "src"),
                           F.col("drop_pin"), "dst")
    city = geo.city_name("src")
    region = F.coalesce(F.col("dst_city"), F.col("drop_pin"))
    located = both.withColumns({
        "city": city,
        "drop_city": F.when(F.col("drop_city") != "", F.col("drop_city")).otherwise(region),
        "warehouse": geo.warehouse_label(F.col("pickup_pin"), city),
        "tier": geo.tier_name("dst"),
        "geo_zone": geo.delivery_zone("src", "dst"),
        "hub": geo.hub_code("src"),
    })
    lane = F.when((F.col("city") != "") & (F.col("drop_city") != ""),
                  F.concat_ws(" → ", F.col("city"), F.col("drop_city"))).otherwise("")
    scratch = [c for c in located.columns if c.startswith(("src_", "dst_"))]
    return located.withColumn("lane", lane).drop(*scratch)


def build_shipments(raw: DataFrame, as_of) -> DataFrame:
    """The whole raw-to-record projection, without the SLA columns."""
    return add_geography(shipment_facts(raw, as_of))
