"""Whole reports as named sets of DataFrames, plus digest, health score and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelsight.functions.scalars import inr, ratio, rounded
from parcelsight.operators import invoices as I
from parcelsight.operators import kpi as K
from parcelsight.operators import lookups as L
from parcelsight.operators import revenue as R
from parcelsight.operators.common import attach_row
from parcelsight.operators.filters import Filters, filter_shipments
from parcelsight.rules import shipments as S

#: What the sections that `digest` reads, and all sections, read of classified shipments.
DIGEST_READS = ["awb", "order_id", "order_value", "cod_value", "carrier", "account", "pickup_pin", "warehouse",
                "city", "drop_city", "lane", "category", "subcategory", "order_date", "pickup_date",
                "window_date", "picked", "delivered", "outcome", "attempts", "o2s_us", "p2o_us", "p2d_us"]
REPORT_READS = DIGEST_READS + ["payment", "tier", "geo_zone", "zone", "channel", "is_reverse", "is_ndd",
                               "pendency_state", "tat_status", "tat_margin"]

# Parts of the shipment report that ordinary users do not see.
RESTRICTED_SECTIONS = ["payment", "products", "daily", "zones", "tiers"]
RESTRICTED_SUMMARY = ["revenue", "delivered_value", "rto_value", "pending_value",
                      "cancelled_value", "aov", "rto_value_pct", "pending_value_pct",
                      "cancelled_value_pct", "order_units"]


def shipment_report(classified: DataFrame, filters: Filters | None = None,
                    daily_orders: DataFrame | None = None,
                    only: list[str] | None = None) -> dict[str, DataFrame]:
    """The report's sections over one filtered input, or just the ones in ``only``.

    Before running several sections write the columns they read (``REPORT_READS``) of ``classified``
    out once (`cut_lineage`): each section then scans only the columns it needs. A filter on others
    is to be applied before.
    """
    rows = filter_shipments(classified, filters)
    sections = {
        "summary": lambda: R.summary(rows),
        "carriers": lambda: K.by_carrier(rows),
        "warehouses": lambda: K.by_warehouse(rows).orderBy(F.desc("n"), "pickup_pin")
        .limit(S.TOP_WAREHOUSES),
        "warehouse_accounts": lambda: K.by_warehouse_account(rows),
        "destinations": lambda: K.by_destination(rows),
        "lanes": lambda: K.by_lane(rows),
        "status_matrix": lambda: K.status_matrix(rows),
        "pendency_matrix": lambda: K.pendency_matrix(rows),
        "tat_accounts": lambda: K.tat_matrix(rows),
        "tat_warehouses": lambda: K.tat_matrix(rows, "pickup_pin"),
        "payment": lambda: R.payment_performance(rows),
        "tiers": lambda: R.tier_mix(rows),
        "zones": lambda: R.zone_breakdown(rows),
        "products": lambda: R.product_tree(rows),
        "daily": lambda: R.daily_series(rows) if daily_orders is None else daily_orders,
        "filters": lambda: R.filter_options(classified),
    }
    return {name: build() for name, build in sections.items() if only is None or name in only}


def public_report(report: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The report without the sections and columns kept for privileged users."""
    shown = {k: v for k, v in report.items() if k not in RESTRICTED_SECTIONS}
    shown["summary"] = report["summary"].drop(*RESTRICTED_SUMMARY)
    return shown


def enrich_lines(lines: DataFrame, shipments: DataFrame, master: DataFrame) -> DataFrame:
    """Lines with master categories and the product, value and lane of their shipment."""
    return L.attach_shipments(L.enrich_from_master(lines, master), shipments)


def cost_report(rows: DataFrame, master: DataFrame, carrier: str | None = None,
                only: list[str] | None = None) -> dict[str, DataFrame]:
    """The cost report over enriched lines (`enrich_lines`), or the sections in ``only``."""
    chosen = I.one_carrier(rows, carrier)
    sections = {
        "summary": lambda: I.cost_summary(chosen),
        "carriers": lambda: I.spend_by_carrier(chosen),
        "categories": lambda: I.spend_by_category(chosen),
        "category_skus": lambda: I.top_skus_by_category(chosen),
        "matrix": lambda: I.category_carrier_matrix(chosen),
        "skus": lambda: I.spend_by_sku(chosen),
        "months": lambda: I.months(chosen),
        "month_parts": lambda: I.month_parts(chosen),
        "reconciliation": lambda: I.reconciliation(chosen),
        "reconciliation_totals": lambda: I.reconciliation_totals(I.reconciliation(chosen)),
        "comparison": lambda: I.carrier_comparison(chosen),
        "comparison_totals": lambda: I.carrier_totals(I.carrier_comparison(chosen)),
        "carrier_month": lambda: I.carrier_month(chosen),
        "subcategories": lambda: I.spend_by_subcategory(chosen),
        "products": lambda: I.spend_by_product(chosen),
        "multi_sku": lambda: I.top_multi_sku(I.multi_sku_lines(chosen, master)),
        "disputes": lambda: I.top_disputes(I.weight_disputes(I.weight_checks(chosen, master))),
        "disputes_by_invoice": lambda: I.dispute_rollup(I.weight_checks(chosen, master), "invoice"),
        "disputes_by_subcategory": lambda: I.dispute_rollup(
            I.weight_checks(chosen, master), "subcategory"),
        "disputes_by_product": lambda: I.top_dispute_products(I.weight_checks(chosen, master)),
        "dispute_totals": lambda: I.dispute_rollup(I.weight_checks(chosen, master), "all"),
        "lanes": lambda: I.top_lanes(I.lane_comparison(chosen)),
        "all_carriers": lambda: I.spend_by_carrier(rows).select("carrier"),
    }
    return {name: build() for name, build in sections.items() if only is None or name in only}


def _component(value: Column, worst: float, best: float) -> Column:
    share = (value - worst) / (best - worst)
    return rounded(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * 100.0)


def health_score(summary: DataFrame, payment: DataFrame) -> DataFrame:
    """Five anchored components, weights renormalised over those present, and a grade."""
    cod = payment.where(F.lower("payment").contains("cod") | F.lower("payment").contains("cash")) \
        .agg(F.max_by("rto_pct", F.struct("n", "payment")).alias("rto_pct"))
    row = attach_row(summary, cod, "_cod")
    inputs = {
        "Delivery success": F.col("success_rate"),
        "RTO / returns control": F.col("rto_pct"),
        "On-time / SLA (TAT)": F.col("tat_in_pct"),
        "Revenue realisation": ratio(F.col("delivered_value"), F.col("revenue")) * 100.0,
        "COD risk": F.col("_cod.rto_pct"),
    }
    total, weight = F.lit(0.0), F.lit(0.0)
    subs = []
    for label, (w, worst, best) in S.HEALTH_COMPONENTS.items():
        sub = _component(inputs[label], worst, best)
        subs.append(sub.alias(label.split(" ")[0].split("/")[0].lower().replace("-", "_")))
        total = total + F.coalesce(sub * w, F.lit(0.0))
        weight = weight + F.when(sub.isNotNull(), F.lit(w)).otherwise(0.0)
    out = row.select(rounded(F.when(weight > 0, total / weight)).alias("overall"), *subs)
    grade = F.when(F.col("overall").isNull(), F.struct(F.lit("N/A").alias("g"),
                                                      F.lit("insufficient data").alias("v")))
    for floor, letter, verdict in S.HEALTH_GRADES:
        grade = grade.when(F.col("overall") >= floor,
                           F.struct(F.lit(letter).alias("g"), F.lit(verdict).alias("v")))
    grade = grade.otherwise(F.struct(F.lit(S.HEALTH_FLOOR[0]).alias("g"),
                                     F.lit(S.HEALTH_FLOOR[1]).alias("v")))
    return out.withColumn("_g", grade).select("*", F.col("_g.g").alias("grade"),
                                              F.col("_g.v").alias("verdict")).drop("_g")


def _slice(df: DataFrame, name: str, item: str, value: Column, order: list, top: int) -> DataFrame:
    return df.orderBy(*order, item).limit(top).select(
        F.lit(name).alias("slice"), F.col(item).cast("string").alias("item"),
        F.col("n").cast("bigint").alias("n"), value.cast("double").alias("value"))


def weakest(df: DataFrame, measure: str, top: int, min_n: int, key: str) -> DataFrame:
    """The lowest values of a measure among groups of a minimum size."""
    return df.where((F.col("n") >= min_n) & F.col(measure).isNotNull()) \
        .orderBy(measure, key).limit(top)


def digest(report: dict[str, DataFrame]) -> DataFrame:
    """Best and worst slices of a shipment report, long form; amounts are spelt in ``label``."""
    carriers, products = report["carriers"], report["products"]
    cats = products.where(F.col("level") == "category")
    subs = products.where(F.col("level") == "subcategory")
    days = report["daily"].withColumnRenamed("date", "day")
    floor = S.MIN_N["warehouse"]
    by_rate = [F.asc("success_rate")]

    def scored(df: DataFrame) -> DataFrame:
        return df.where((F.col("n") >= floor) & F.col("success_rate").isNotNull())

    parts = [
        _slice(carriers.where(F.col("score").isNotNull()), "top_carriers", "carrier", F.col("score"),
               [F.desc("score")], 6),
        _slice(carriers.where(F.col("score").isNotNull()), "weakest_carriers", "carrier",
               F.col("score"), [F.asc("score")], 3),
        _slice(scored(report["warehouses"]), "weakest_warehouses", "warehouse", F.col("success_rate"),
               by_rate, 3),
        _slice(scored(report["destinations"]), "weakest_destinations", "drop_city",
               F.col("success_rate"), by_rate, 4),
        _slice(report["destinations"], "top_destinations", "drop_city", F.col("success_rate"),
               [F.desc("n")], 5),
        _slice(report["lanes"], "top_lanes", "lane", F.col("rto_pct"), [F.desc("n")], 5),
        _slice(cats, "top_categories", "category", F.col("revenue"), [F.desc("revenue")], 6),
        _slice(cats.where((F.col("n") >= floor) & F.col("rto_pct").isNotNull()), "riskiest_categories",
               "category", F.col("rto_pct"), [F.desc("rto_pct")], 4),
        _slice(subs, "best_products", "item", F.col("revenue"), [F.desc("revenue")], 5),
        _slice(days, "busiest_day", "day", F.col("revenue"), [F.desc("n")], 1),
        _slice(days, "lightest_day", "day", F.col("revenue"), [F.asc("n")], 1),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    money = F.col("slice").isin("top_categories", "best_products", "busiest_day", "lightest_day")
    return out.withColumn("label", F.when(money, inr(F.col("value"))))


def shipment_export(rows: DataFrame) -> DataFrame:
    """The shipment-level export under its display headers."""
    return rows.select(*[F.col(c).alias(h) for c, h in S.SHIPMENT_EXPORT.items()])


def invoice_export(lines: DataFrame) -> DataFrame:
    """Every billed AWB line with the product joined from its shipment."""
    return lines.select(
        F.col("awb").alias("AWB"), F.col("invoice_number").alias("Invoice Number"),
        F.col("service_month_key").alias("Service Month"), F.col("carrier").alias("Carrier"),
        F.col("direction").alias("Direction"), F.col("sku").alias("SKU"),
        F.col("subcategory").alias("Sub-category"), F.col("category").alias("Category"),
        F.coalesce(F.nullif("product", F.lit("")), F.col("sku_name")).alias("Item Name"),
        F.col("weight_kg").alias("Charged Wt (kg)"),
        rounded(F.col("amount"), 2).alias("Amount with GST"),
        rounded(F.coalesce("amount_ex_gst", F.lit(0.0)), 2).alias("Amount ex GST"),
        F.when(F.col("prod_matched"), F.lit("yes")).otherwise("no").alias("Matched"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_report(report: dict[str, DataFrame], folder: str) -> None:
    """One Parquet directory per section."""
    for name, section in report.items():
        section.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_overrides(clean: DataFrame, folder: str) -> None:
    """Override rows partitioned by rule, so replacing one rule rewrites one directory."""
    clean.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("carrier_rule").parquet(folder)
