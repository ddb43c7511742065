"""De-duplicated order value and every rollup that uses it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelsight.functions.classify import display_category
from parcelsight.functions.scalars import cents, percent, ratio, rounded, rupees
from parcelsight.operators.common import attach_row, spread_blank, with_whole
from parcelsight.operators.kpi import kpi_block, tat_summary
from parcelsight.rules import geo as G
from parcelsight.rules import shipments as S
from parcelsight.session import rule_table


def order_units(df: DataFrame, *attributes: str) -> DataFrame:
    """One row per (order id, value), with the attributes of its first shipment by AWB.

    The source stamps the order value on every AWB of the order. Identical values collapse,
    different ones still add up, rows without an order id stand for themselves. A min over a
    struct combines on the map side, so no window and no hot group; rows without an id are
    never shuffled here.
    """
    base = df.select("order_id", F.coalesce("order_value", F.lit(0.0)).alias("value"), "awb",
                     *attributes)
    first = base.where(F.col("order_id") != "").groupBy("order_id", "value").agg(
        F.min(F.struct("awb", *attributes)).alias("first"))
    units = first.select("order_id", "value", *[F.col(f"first.{a}").alias(a) for a in attributes])
    single = base.where(F.col("order_id") == "").select("order_id", "value", *attributes)
    return units.unionByName(single).withColumn("paise", cents(F.col("value")))


def _paise(condition: Column | None = None) -> Column:
    value = F.col("paise") if condition is None else F.when(condition, F.col("paise"))
    return F.coalesce(F.sum(value), F.lit(0).cast("bigint"))


def order_count(units: DataFrame) -> DataFrame:
    """Distinct orders plus shipments without an order id."""
    blank = units.where(F.col("order_id") == "").agg(F.count("*").alias("k"))
    named = units.where(F.col("order_id") != "").select("order_id").distinct() \
        .agg(F.count("*").alias("k"))
    return named.unionByName(blank).agg(F.sum("k").alias("order_units"))


def revenue_totals(units: DataFrame) -> DataFrame:
    """Total value and its four outcome buckets, in paise."""
    return units.agg(
        _paise().alias("revenue"),
        _paise(F.col("delivered")).alias("delivered_value"),
        _paise(F.col("outcome") == "RTO").alias("rto_value"),
        _paise(F.col("outcome") == "FWD Pendency").alias("pending_value"),
        _paise(F.col("outcome") == "Cancelled").alias("cancelled_value"))


def summary(df: DataFrame) -> DataFrame:
    """The headline row: volumes, rates, mean and median times, value buckets, SLA counts."""
    units = order_units(df, "outcome", "delivered")
    counts = df.agg(
        F.count_if(F.col("outcome") == "FWD Pendency").alias("pending_orders"),
        F.count_if(F.col("outcome") == "Cancelled").alias("cancelled_orders"),
        F.count_if("is_ndd").alias("ndd_orders"),
        F.countDistinct(F.when(F.col("carrier") != "", F.col("carrier"))).alias("carriers"))
    warehouses = df.where(F.col("pickup_pin") != "").agg(
        F.countDistinct("pickup_pin").alias("warehouses"))
    row = kpi_block(df, [])
    for name, part in (("c", counts), ("w", warehouses), ("v", revenue_totals(units)),
                       ("u", order_count(units))):
        row = attach_row(row, part, f"_{name}")
    total, revenue = F.col("n"), F.col("_v.revenue")
    money = ["revenue", "delivered_value", "rto_value", "pending_value", "cancelled_value"]
    out = [
        total.alias("total"), F.col("_u.order_units").alias("order_units"), "picked", "delivered",
        "rto", rounded(F.col("success_rate")).alias("success_rate"),
        rounded(F.col("rto_pct")).alias("rto_pct"),
        *[rounded(F.col(m)).alias(f"avg_{m}") for m in ("p2o", "p2d", "o2s")],
        F.col("_c.carriers").alias("carriers"), F.col("_w.warehouses").alias("warehouses"),
        *[F.col(f"_c.{c}").alias(c) for c in ("ndd_orders", "pending_orders", "cancelled_orders")],
        rounded(percent(F.col("_c.ndd_orders"), total)).alias("ndd_pct"),
        *[rounded(rupees(F.col(f"_v.{m}"))).alias(m) for m in money],
        *[rounded(percent(F.col(f"_v.{m}"), revenue)).alias(f"{m}_pct")
          for m in ("rto_value", "pending_value", "cancelled_value")],
        rounded(ratio(rupees(revenue), F.col("_u.order_units"))).alias("aov"),
    ]
    if "tat_status" in df.columns:
        row = attach_row(row, tat_summary(df), "_t")
        out += [F.col("_t.in_tat").alias("tat_in"), F.col("_t.out_tat").alias("tat_out"),
                F.col("_t.in_tat_pct").alias("tat_in_pct"),
                F.col("_t.out_tat_pct").alias("tat_out_pct"),
                F.col("_t.pending").alias("tat_pending"),
                rounded(percent(F.col("_t.pending"), total)).alias("tat_pending_pct"),
                F.col("_t.out_delivered").alias("tat_out_delivered"),
                F.col("_t.out_pending").alias("tat_out_pending")]
    return row.select(*out)


def _counts(df: DataFrame, keys: list[Column]) -> DataFrame:
    cod = F.when(F.col("outcome") == "FWD Pendency", cents(F.col("cod_value")))
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if("picked").alias("picked"),
        F.count_if("delivered").alias("delivered"),
        F.count_if(F.col("outcome") == "RTO").alias("rto"),
        F.coalesce(F.sum(cod), F.lit(0).cast("bigint")).alias("cod_paise"))


def economics(df: DataFrame, key: str) -> DataFrame:
    """Volume, de-duplicated value and return figures per value of ``key``.

    Counts and value are aggregated apart and meet as one row per key.
    """
    counts = _counts(df, [F.col(key)])
    value = order_units(df, key).groupBy(key).agg(_paise().alias("paise"))
    joined = counts.join(value, key, "left").withColumn(
        "paise", F.coalesce("paise", F.lit(0).cast("bigint")))
    return with_whole(joined, n=F.sum("n"), paise=F.sum("paise"))


def _money_columns() -> dict[str, Column]:
    return {
        "revenue": rounded(rupees(F.col("paise"))),
        "revenue_pct": rounded(percent(F.col("paise"), F.col("_whole.paise"))),
        "n_pct": rounded(percent(F.col("n"), F.col("_whole.n"))),
        "aov": rounded(ratio(rupees(F.col("paise")), F.col("n"))),
        "success_rate": rounded(percent(F.col("delivered"), F.col("picked"))),
        "rto_pct": rounded(percent(F.col("rto"), F.col("n"))),
    }


def payment_performance(df: DataFrame) -> DataFrame:
    """KPI block per payment mode with the COD cash still in transit."""
    named = df.withColumn("payment", F.when(F.col("payment") == "", F.lit("(unknown)"))
                          .otherwise(F.col("payment")))
    return economics(named, "payment").withColumns(_money_columns()).select(
        "payment", "n", "n_pct", "revenue", "revenue_pct", "aov", "delivered", "success_rate", "rto",
        "rto_pct", rounded(rupees(F.col("cod_paise"))).alias("cod_exposure"))


def _on_levels(levels: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Join to a fixed level list so that empty levels keep a row."""
    zero = ["n", "picked", "delivered", "rto", "cod_paise", "paise"]
    joined = levels.join(df, key, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in zero})


def tier_mix(df: DataFrame) -> DataFrame:
    levels = rule_table(df.sparkSession, "tier string", [(t,) for t in G.TIERS])
    return _on_levels(levels, economics(df, "tier"), "tier").select(
        "tier", "n", rounded(rupees(F.col("paise"))).alias("revenue"))


def zone_breakdown(df: DataFrame) -> DataFrame:
    """Economics of the delivery zones, always all four rows."""
    levels = rule_table(df.sparkSession, "geo_zone string,label string", list(G.GEO_ZONES.items()))
    return _on_levels(levels, economics(df, "geo_zone"), "geo_zone") \
        .withColumns(_money_columns()).select(
            F.col("geo_zone").alias("zone"), "label", "n", F.col("n_pct").alias("share_pct"),
            "revenue", "revenue_pct", "rto_pct", "aov", "success_rate")


def daily_series(df: DataFrame) -> DataFrame:
    """Shipments, deliveries and value per order day (pickup, then window date as fallback)."""
    dated = df.withColumn("day", F.coalesce("order_date", "pickup_date", "window_date"))
    counts = _counts(dated.where(F.col("day").isNotNull()), [F.col("day")])
    value = order_units(dated, "day").where(F.col("day").isNotNull()).groupBy("day") \
        .agg(_paise().alias("paise"))
    return counts.join(value, "day", "left").select(
        F.col("day").alias("date"), "n", "delivered",
        rounded(rupees(F.coalesce("paise", F.lit(0).cast("bigint")))).alias("revenue"))


def product_tree(df: DataFrame) -> DataFrame:
    """Display categories, their subcategories and the accounts that ship them, long form.

    ``level`` is category, subcategory or account. Shipments are counted once at the finest
    grain; the levels are rolled up from those counts.
    """
    grouped = df.withColumns({
        "group": display_category("category"),
        "sub": F.when(F.col("subcategory") == "", F.lit("Unknown")).otherwise(F.col("subcategory")),
        "acct": F.when(F.col("account") == "", F.lit("(unknown)")).otherwise(F.col("account")),
    })
    cells = _counts(grouped, [F.col("group"), F.col("sub"), F.col("acct")])
    value = order_units(grouped, "group", "sub").groupBy("group", "sub").agg(_paise().alias("paise"))
    sums = [F.sum(c).alias(c) for c in ("n", "picked", "delivered", "rto")]
    by_sub = cells.groupBy("group", "sub").agg(*sums).join(value, ["group", "sub"], "left") \
        .withColumn("paise", F.coalesce("paise", F.lit(0).cast("bigint")))
    by_group = with_whole(by_sub.groupBy("group").agg(*sums, F.sum("paise").alias("paise")),
                          n=F.sum("n"), paise=F.sum("paise")).withColumns(_money_columns())
    top = by_group.select(F.lit("category").alias("level"), F.col("group").alias("category"),
                          F.lit("").alias("item"), "n", "revenue", "revenue_pct", "rto_pct", "aov",
                          "success_rate")
    subs = by_sub.select(F.lit("subcategory").alias("level"), F.col("group").alias("category"),
                         F.col("sub").alias("item"), "n",
                         rounded(rupees(F.col("paise"))).alias("revenue"),
                         rounded(percent(F.col("rto"), F.col("n"))).alias("rto_pct"))
    accounts = cells.groupBy("group", "acct").agg(F.sum("n").alias("n")).select(
        F.lit("account").alias("level"), F.col("group").alias("category"),
        F.col("acct").alias("item"), "n")
    return top.unionByName(subs, allowMissingColumns=True).unionByName(
        accounts, allowMissingColumns=True)


def filter_options(df: DataFrame) -> DataFrame:
    """Distinct values with counts for every filter, and the date bounds, long form.

    The rows are first counted per combination of the option columns, so the unpivot runs on
    counts instead of shipments.
    """
    dims = ["zone", "channel", "account", "carrier", "is_reverse", "pickup_pin", "warehouse"]
    cells = df.groupBy(*dims).agg(
        F.count("*").alias("n"),
        F.min("pickup_date").alias("p0"), F.max("pickup_date").alias("p1"),
        F.min("order_date").alias("o0"), F.max("order_date").alias("o1"))

    def option(dimension: str, value: Column, label: Column | None = None) -> Column:
        return F.struct(F.lit(dimension).alias("dimension"), value.alias("value"),
                        (value if label is None else label).alias("label"))

    reverse = F.when(F.col("is_reverse"), F.col("carrier")).otherwise("")
    rows = cells.select("n", F.inline(F.array(
        option("zone", F.col("zone")), option("channel", F.col("channel")),
        option("account", F.col("account")), option("reverse_carrier", reverse),
        option("warehouse", F.col("pickup_pin"), F.col("warehouse"))))).where(F.col("value") != "")
    values = rows.groupBy("dimension", "value", "label").agg(F.sum("n").alias("n"))
    bounds = cells.agg(F.min("p0").alias("p0"), F.max("p1").alias("p1"),
                       F.min("o0").alias("o0"), F.max("o1").alias("o1")).select(
        F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(c).cast("string").alias("value"),
                                    F.col(c).cast("string").alias("label"))
                           for d, c in (("pickup_date_min", "p0"), ("pickup_date_max", "p1"),
                                        ("order_date_min", "o0"), ("order_date_max", "o1"))]))) \
        .withColumn("n", F.lit(None).cast("bigint"))
    return values.unionByName(bounds)
