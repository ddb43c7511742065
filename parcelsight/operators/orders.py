"""Orders placed (OMS): orders per day and order-to-pickup time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelsight.functions.scalars import cents, norm_order, rounded, rupees
from parcelsight.functions.times import hours, micros_between
from parcelsight.operators.common import spread_blank
from parcelsight.operators.filters import is_d2c_channel
from parcelsight.rules.shipments import O2S_MATURE_DAYS
from parcelsight.sources.windows import Window


def d2c_orders(oms: DataFrame, window: Window | None = None) -> DataFrame:
    """Orders of the self-shipped channels in the window, with canonical ids."""
    day = F.col("order_ts").cast("date")
    kept = oms.where(F.col("order_code").isNotNull() & is_d2c_channel(F.col("channel")))
    if window:
        kept = kept.where(window.predicate(day))
    return kept.select(norm_order(F.col("order_code")).alias("oid"), day.alias("day"), "order_ts")


def orders_per_day(oms: DataFrame, shipments: DataFrame, window: Window | None = None) -> DataFrame:
    """Orders placed per day, with the declared value of those that shipped.

    Every order counts. Values are reduced to one per order before the join; an order on two
    days adds its value on both.
    """
    placed = d2c_orders(oms, window).select("oid", "day").distinct()
    shipped = shipments.where(F.col("order_id") != "")
    if window:
        shipped = shipped.where(window.predicate(F.col("order_date")))
    value = shipped.groupBy(norm_order(F.col("order_id")).alias("oid")).agg(
        F.max(cents(F.col("order_value"))).alias("paise"))
    return placed.join(value, "oid", "left").groupBy(F.col("day").alias("date")).agg(
        F.count("*").alias("n"), F.coalesce(F.sum("paise"), F.lit(0).cast("bigint")).alias("paise")) \
        .select("date", "n", rounded(rupees(F.col("paise")), 2).alias("revenue"))


def order_times(oms: DataFrame, window: Window | None = None) -> DataFrame:
    """First order-received time per order."""
    return d2c_orders(oms, window).groupBy("oid").agg(F.min("order_ts").alias("received_ts"))


def recompute_o2s(shipments: DataFrame, times: DataFrame, as_of,
                  mature_days: int = O2S_MATURE_DAYS) -> DataFrame:
    """Order-to-pickup time on the order-received clock.

    Null without a match or pickup, for a negative gap, or for orders too young to have
    shipped reliably. Hours keep two decimals, so medians see few distinct values.
    """
    cutoff = F.date_sub(F.lit(as_of).cast("date"), mature_days)
    keyed = shipments.withColumn(
        "_oid", spread_blank(norm_order(F.col("order_id")), F.col("awb")))
    joined = keyed.join(times, F.col("_oid") == F.col("oid"), "left")
    gap = micros_between(F.col("received_ts"), F.col("pickup_ts"))
    mature = F.col("received_ts").cast("date") <= cutoff
    hundredths = F.floor(hours(F.when(mature, gap)) * 100 + 0.5).cast("bigint")
    return joined.withColumns({
        "o2s_us": hundredths * 36000000,
        "o2s": hundredths.cast("double") / 100.0,
    }).drop("_oid", "oid", "received_ts")
