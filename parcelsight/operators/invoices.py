"""Spend, reconciliation, weight-dispute and lane rollups over invoice lines.

Money is summed in paise, weight in grams; shares come from a scalar subquery over the
grouped rows, never from a second pass over the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelsight.functions.scalars import (
    blank_to_null, cents, percent, pick, ratio, rounded, rupees, split_skus)
from parcelsight.functions.times import invoice_date, month_label
from parcelsight.operators.common import spread_blank, with_whole
from parcelsight.operators.lookups import (
    attach_shipments, enrich_from_master, sku_labels, sku_weights)

TDS_RATE = 2.0
SLABS = [0.5, 1.0, 2.0, 3.0, 5.0, 7.0, 10.0]
NO_SKU = "(no SKU / unmatched)"


def _grams(c: Column) -> Column:
    return F.floor(F.coalesce(c, F.lit(0.0)) * 1000 + 0.5).cast("bigint")


def _sums() -> list[Column]:
    return [F.sum(cents(F.col("amount"))).alias("paise"),
            F.sum("shipments").alias("shipments"),
            F.sum(_grams(F.col("weight_kg"))).alias("grams")]


def _spend(digits: int = 1) -> Column:
    return rounded(rupees(F.col("paise")), digits).alias("spend")


def _avg() -> Column:
    return rounded(ratio(rupees(F.col("paise")), F.col("shipments"))).alias("avg_cost")


def _per_kg() -> Column:
    kg = F.col("grams") / 1000.0
    return rounded(F.when(F.col("grams") > 0, rupees(F.col("paise")) / kg)).alias("avg_per_kg")


def _weight() -> Column:
    return rounded(F.col("grams") / 1000.0).alias("weight")


def _share() -> Column:
    return rounded(F.coalesce(percent(F.col("paise"), F.col("_whole.paise")), F.lit(0.0))).alias("share")


def sku_key() -> Column:
    """SKU, else product, else a bucket of its own."""
    return F.coalesce(blank_to_null(F.col("sku")), blank_to_null(F.col("product")),
                      F.lit("(unmapped)"))


def spend_by_carrier(lines: DataFrame) -> DataFrame:
    g = with_whole(lines.groupBy("carrier").agg(*_sums()), paise=F.sum("paise"))
    return g.select("carrier", _spend(), "shipments", _avg(), _per_kg(), _weight(), _share())


def spend_by_category(lines: DataFrame) -> DataFrame:
    named = lines.withColumns({"category": F.coalesce(blank_to_null(F.col("category")),
                                                      F.lit("Others")), "_sku": sku_key()})
    cells = named.groupBy("category", "_sku").agg(*_sums())
    g = cells.groupBy("category").agg(
        *[F.sum(c).alias(c) for c in ("paise", "shipments", "grams")],
        F.count("*").alias("sku_count"))
    return with_whole(g, paise=F.sum("paise")).select(
        "category", _spend(), "shipments", _avg(), _per_kg(), _share(), "sku_count")


def category_carrier_matrix(lines: DataFrame) -> DataFrame:
    cat = F.coalesce(blank_to_null(F.col("category")), F.lit("Others")).alias("category")
    return lines.groupBy(cat, "carrier").agg(*_sums()).select(
        "category", "carrier", _spend(), "shipments", _avg())


def top_skus_by_category(lines: DataFrame, top: int = 8) -> DataFrame:
    """The report's leading SKUs of each category, by spend."""
    cat = F.coalesce(blank_to_null(F.col("category")), F.lit("Others")).alias("category")
    g = lines.groupBy(cat, sku_key().alias("item")).agg(*_sums())
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("paise"), "item"))
    return g.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= top).select(
        "category", "rank", "item", _spend(), "shipments", _avg())


def spend_by_sku(lines: DataFrame, top: int | None = None) -> DataFrame:
    g = lines.groupBy(sku_key().alias("item")).agg(
        *_sums(), F.min("category").alias("category"), F.min(blank_to_null(F.col("product"))).alias("p"))
    out = g.withColumn("name", F.coalesce("p", "item"))
    if top:
        out = out.orderBy(F.desc("paise"), "item").limit(top)
    return out.select("item", "name", "category", _spend(), "shipments", _avg())


def months(lines: DataFrame) -> DataFrame:
    """Spend per billing month and the change against the previous one, of rounded values."""
    g = lines.groupBy("month", "month_label").agg(*_sums()).select(
        "month", "month_label", _spend(), "shipments", _avg())
    w = Window.partitionBy(F.lit(0)).orderBy("month")  # one row per month
    before, avg_before = F.lag("spend").over(w), F.lag("avg_cost").over(w)
    return g.withColumns({
        "spend_delta": rounded(F.when(before != 0, (F.col("spend") - before) / before * 100.0)),
        "avg_delta": rounded(F.when(avg_before != 0,
                                    (F.col("avg_cost") - avg_before) / avg_before * 100.0)),
    })


def month_parts(lines: DataFrame) -> DataFrame:
    """Spend per month and carrier, and per month and category, long form."""
    cat = F.coalesce(blank_to_null(F.col("category")), F.lit("Others"))
    cells = lines.groupBy("month", "carrier", cat.alias("category")).agg(*_sums())
    by_carrier = cells.groupBy("month", F.lit("carrier").alias("part"), F.col("carrier").alias("name")) \
        .agg(F.sum("paise").alias("paise"))
    by_category = cells.groupBy("month", F.lit("category").alias("part"),
                                F.col("category").alias("name")).agg(F.sum("paise").alias("paise"))
    return by_carrier.unionByName(by_category).select("month", "part", "name", _spend())


def reconciliation(lines: DataFrame, adjustments: DataFrame | None = None,
                   tds_rate: float = TDS_RATE) -> DataFrame:
    """One row per (carrier, invoice): amounts, TDS on the ex-GST amount, adjustments, payable."""
    kinds = ["billing_dispute", "weight_dispute", "billing_cn", "weight_cn", "lost_cn"]
    month = invoice_date(F.concat("service_month_key", F.lit("-01")))
    g = lines.where(F.col("invoice_number") != "").groupBy("carrier", "invoice_number").agg(
        F.min(blank_to_null(F.col("invoice_date"))).alias("invoice_date"),
        F.min(month).alias("_month"),
        F.sum("shipments").alias("shipments"),
        *[F.coalesce(F.sum(cents(F.col(c))), F.lit(0)).alias(out)
          for c, out in (("amount", "paise"), ("amount_ex_gst", "ex_paise"))])
    if adjustments is not None:
        g = g.join(adjustments.select("carrier", "invoice_number", *kinds),
                   ["carrier", "invoice_number"], "left")
    else:
        g = g.withColumns({k: F.lit(0.0) for k in kinds})
    g = g.withColumns({k: F.coalesce(k, F.lit(0.0)) for k in kinds})
    tds = rounded(rupees(F.col("ex_paise")) * tds_rate / 100.0, 2)
    held = tds
    for k in kinds:
        held = held + F.col(k)
    return g.select(
        "carrier", "invoice_number", F.coalesce("invoice_date", F.lit("")).alias("invoice_date"),
        month_label(F.col("_month")).alias("service_month"), "shipments",
        rupees(F.col("paise")).alias("amount_with_gst"),
        rupees(F.col("ex_paise")).alias("amount_ex_gst"), tds.alias("tds"), *kinds,
        rounded(rupees(F.col("paise")) - held, 2).alias("payable"))


def reconciliation_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("invoice_count"), F.sum("shipments").alias("total_shipments"),
        rupees(F.sum(cents(F.col("amount_with_gst")))).alias("total_amount"),
        rupees(F.sum(cents(F.col("amount_ex_gst")))).alias("total_amount_ex_gst"),
        rupees(F.sum(cents(F.col("tds")))).alias("total_tds"),
        rupees(F.sum(cents(F.col("payable")))).alias("total_payable"))


def _comparison(g: DataFrame, tds_rate: float) -> DataFrame:
    amount = rupees(F.col("paise"))
    tds = rounded(amount * tds_rate / 100.0, 2)
    return g.select(
        "carrier", "invoices", "shipments", amount.alias("amount_with_gst"),
        rupees(F.col("ex_paise")).alias("amount_ex_gst"),
        rounded(ratio(amount, F.col("shipments")), 2).alias("per_parcel"), _weight(),
        tds.alias("tds_with_gst"), rounded(amount - tds, 2).alias("payable"))


def carrier_comparison(lines: DataFrame, tds_rate: float = TDS_RATE) -> DataFrame:
    """Per carrier: invoices, amounts, TDS on the with-GST amount and payable."""
    cells = lines.groupBy("carrier", "invoice_number").agg(
        *_sums(), F.sum(cents(F.coalesce("amount_ex_gst", F.lit(0.0)))).alias("ex_paise"))
    g = cells.groupBy("carrier").agg(
        F.count_if(F.col("invoice_number") != "").alias("invoices"),
        *[F.sum(c).alias(c) for c in ("shipments", "paise", "ex_paise", "grams")])
    return _comparison(g, tds_rate)


def carrier_totals(comparison: DataFrame) -> DataFrame:
    """Totals of the comparison; TDS and payable add up the rounded carrier figures."""
    def money(c: str) -> Column:
        return rupees(F.sum(cents(F.col(c))))

    t = comparison.agg(F.sum("invoices").alias("invoices"), F.sum("shipments").alias("shipments"),
                       *[money(c).alias(c) for c in
                         ("amount_with_gst", "amount_ex_gst", "tds_with_gst", "payable")])
    return t.withColumn("per_parcel", rounded(ratio(F.col("amount_with_gst"), F.col("shipments")), 2))


def carrier_month(lines: DataFrame) -> DataFrame:
    """Carrier x service month cells, with month totals as carrier '(all)'."""
    month = F.coalesce(blank_to_null(F.col("service_month_key")), F.lit("zzzz")).alias("month")
    cells = lines.groupBy("carrier", month).agg(*_sums())
    totals = cells.groupBy(F.lit("(all)").alias("carrier"), "month").agg(
        *[F.sum(c).alias(c) for c in ("paise", "shipments", "grams")])
    kg = F.col("grams") / 1000.0
    return cells.unionByName(totals).select(
        "carrier", "month", rupees(F.col("paise")).alias("amount_with_gst"), "shipments", _weight(),
        rounded(ratio(rupees(F.col("paise")), F.col("shipments")), 2).alias("per_parcel"),
        rounded(F.when(F.col("grams") > 0, rupees(F.col("paise")) / kg), 2).alias("per_kg"))


def spend_by_subcategory(lines: DataFrame) -> DataFrame:
    """Spend by subcategory; unmatched lines keep a bucket, so totals reconcile."""
    sub = F.coalesce(blank_to_null(F.col("subcategory")),
                     F.when(F.col("prod_matched"), F.lit("Other")).otherwise("Unmatched"))
    g = lines.groupBy(sub.alias("subcategory")).agg(*_sums())
    return with_whole(g, paise=F.sum("paise")).select(
        "subcategory", _spend(2), "shipments", _weight(), _share())


def _first_values(lines: DataFrame) -> DataFrame:
    """Lines with ``value_paise`` counted once per (order key, value).

    Distinct (order key, value) pairs are reduced to their first line by a map-side min, and
    the value is booked on that line's SKU.
    """
    item = F.coalesce(blank_to_null(F.upper(F.trim("sku"))), F.lit(NO_SKU))
    base = lines.select(item.alias("item"), "order_key", "awb", F.coalesce("order_value", F.lit(0.0))
                        .alias("value"))
    once = base.where(F.col("order_key") != "").groupBy("order_key", "value").agg(
        F.min(F.struct("awb", "item")).alias("f")).select(F.col("f.item").alias("item"), "value")
    alone = base.where(F.col("order_key") == "").select("item", "value")
    return once.unionByName(alone).groupBy("item").agg(F.sum(cents(F.col("value"))).alias("value_paise"))


def spend_by_product(lines: DataFrame, top: int | None = None) -> DataFrame:
    """Spend and selling value by SKU text, value counted once per order."""
    item = F.coalesce(blank_to_null(F.upper(F.trim("sku"))), F.lit(NO_SKU))
    name = F.coalesce(blank_to_null(F.trim("product")), blank_to_null(F.trim("sku_name")))
    g = lines.groupBy(item.alias("item")).agg(*_sums(), F.min(name).alias("name"))
    joined = g.join(_first_values(lines), "item", "left")
    out = with_whole(joined, paise=F.sum("paise"))
    if top:
        out = out.orderBy(F.desc("paise"), "item").limit(top)
    return out.select(
        "item", F.coalesce("name", "item").alias("name"), _spend(2), "shipments", _weight(),
        F.when(F.col("value_paise") != 0, rupees(F.col("value_paise"))).alias("sell_value"), _share())


def multi_sku_lines(lines: DataFrame, master: DataFrame) -> DataFrame:
    """Lines whose AWB carries more than one SKU, with tokens and master names."""
    several = lines.where(F.size(split_skus(F.col("sku"))) > 1)
    return several.join(sku_labels(several, master), F.col("sku") == F.col("sku_text")).select(
        "awb", "invoice_number", "carrier", "order_id", "product_count", "skus", "names",
        rounded(F.coalesce("weight_kg", F.lit(0.0)), 2).alias("weight"),
        rounded(F.col("amount"), 2).alias("amount"))


def top_multi_sku(rows: DataFrame, top: int = 1000) -> DataFrame:
    return rows.orderBy(F.desc("product_count"), F.desc("amount"), "awb", "order_id").limit(top)


def multi_sku_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("multi_awbs"), rupees(F.sum(cents(F.col("amount")))).alias("spend"),
        rounded(ratio(F.sum("product_count"), F.count("*")), 2).alias("avg_products"),
        F.max("product_count").alias("max_products"))


def weight_slab(kg: Column) -> Column:
    """Weight rounded up to the next chargeable slab; whole kilograms above the ladder."""
    out = F.when(F.coalesce(kg, F.lit(0.0)) <= 0, F.lit(0.0))
    for s in SLABS:
        out = out.when(kg <= s + 1e-9, F.lit(s))
    return out.otherwise(F.ceil(kg - 1e-9).cast("double"))


def slab_index(slab: Column) -> Column:
    """Position of a slab on the ladder."""
    out = F.when(F.abs(slab - SLABS[0]) < 1e-9, F.lit(0))
    for i, s in enumerate(SLABS[1:], start=1):
        out = out.when(F.abs(slab - s) < 1e-9, F.lit(i))
    return out.otherwise(len(SLABS) - 1 + F.floor(slab - 10.0 + 0.5).cast("int"))


def weight_checks(lines: DataFrame, master: DataFrame, min_jump: int = 2) -> DataFrame:
    """Every line the master can check, flagged when billed ``min_jump`` slabs too high."""
    weighed = lines.where((F.col("sku") != "") & (F.col("weight_kg") > 0))
    checked = weighed.join(sku_weights(weighed, master), F.col("sku") == F.col("sku_text")) \
        .where(F.col("expected_g").isNotNull())
    slabs = checked.withColumns({
        "expected_slab": weight_slab(F.col("expected_g") / 1000.0),
        "charged_slab": weight_slab(F.col("weight_kg")),
    }).withColumns({
        "slabs_jumped": slab_index(F.col("charged_slab")) - slab_index(F.col("expected_slab")),
        "excess": rounded(F.col("weight_kg") - F.col("expected_slab"), 3),
    })
    return slabs.withColumns({
        "flagged": F.col("slabs_jumped") >= min_jump,
        "overcharge": F.col("excess") * (F.col("amount") / F.col("weight_kg")),
        "subcategory": _named_subcategory() if "subcategory" in lines.columns else F.lit("Unmatched"),
    }).drop("sku_text")


def _named_subcategory() -> Column:
    return F.coalesce(blank_to_null(F.trim("subcategory")), F.lit("Unmatched"))


def flagged_checks(settled: DataFrame, master: DataFrame, shipments: DataFrame) -> DataFrame:
    """The flagged checks of lines with settled SKUs, enriched from their own SKU after the check."""
    flagged = weight_checks(settled, master).where("flagged") \
        .withColumn("sku", F.col("own_sku")).drop("own_sku", "subcategory")
    return attach_shipments(enrich_from_master(flagged, master), shipments) \
        .withColumn("subcategory", _named_subcategory())


def weight_disputes(checks: DataFrame) -> DataFrame:
    """The flagged lines, rounded for the export."""
    return checks.where("flagged").select(
        "awb", "invoice_number", "carrier", "sku", "subcategory",
        F.coalesce(blank_to_null(F.col("product")), F.col("sku")).alias("name"),
        rounded(F.col("weight_kg"), 2).alias("charged_kg"),
        rounded(F.col("expected_slab"), 2).alias("expected_kg"),
        rounded(F.col("excess"), 2).alias("excess_kg"),
        rounded(F.col("overcharge"), 2).alias("est_overcharge"), "skus_missing")


def dispute_rollup(checks: DataFrame, by: str) -> DataFrame:
    """Dispute totals by 'invoice', 'subcategory', 'product' or 'all'."""
    keys = {
        "invoice": [F.coalesce(blank_to_null(F.col("invoice_number")), F.lit("(no invoice)"))
                    .alias("invoice_number")],
        "subcategory": [F.col("subcategory")],
        "product": [F.coalesce(blank_to_null(F.upper("sku")), F.lit("(no SKU)")).alias("item")],
        "all": [],
    }[by]
    rows = checks if by in ("invoice", "all") else checks.where("flagged")

    def over(c: Column, scale: int) -> Column:
        whole = F.floor(F.when(F.col("flagged"), c) * scale + 0.5).cast("bigint")
        return F.coalesce(F.sum(whole), F.lit(0).cast("bigint")) / float(scale)

    return rows.groupBy(*keys).agg(
        F.count("*").alias("checked"), F.count_if("flagged").alias("flagged"),
        rounded(over(F.col("weight_kg"), 1000)).alias("charged_kg"),
        rounded(over(F.col("expected_slab"), 1000)).alias("expected_kg"),
        rounded(over(F.col("excess"), 1000)).alias("excess_kg"),
        rounded(over(F.col("overcharge"), 1000000), 2).alias("est_overcharge"))


def top_disputes(rows: DataFrame, top: int = 10000) -> DataFrame:
    """Dispute lines by product, biggest excess first."""
    return rows.orderBy("name", F.desc("excess_kg"), "awb", "carrier", "invoice_number",
                        F.desc("est_overcharge"), "sku").limit(top)


def top_dispute_products(checks: DataFrame, top: int = 200) -> DataFrame:
    return dispute_rollup(checks, "product").orderBy(F.desc("est_overcharge"), "item").limit(top)


def lane_cells(lines: DataFrame) -> DataFrame:
    """Average cost per (lane, carrier)."""
    on_lane = lines.where((F.col("pickup_pin") != "") & (F.col("drop_pin") != ""))
    return on_lane.groupBy("pickup_pin", "drop_pin", "carrier").agg(*_sums()).select(
        "pickup_pin", "drop_pin", "carrier", "shipments", _avg(), _spend())


def lane_comparison(lines: DataFrame) -> DataFrame:
    """Lanes that several priced carriers serve: cheapest, dearest and the saving between."""
    priced = F.when(F.col("avg_cost").isNotNull(), F.struct("avg_cost", "carrier"))
    g = lane_cells(lines).groupBy("pickup_pin", "drop_pin").agg(
        F.count("*").alias("carrier_count"), F.count("avg_cost").alias("priced"),
        F.sum("shipments").alias("shipments"), F.min(priced).alias("lo"), F.max(priced).alias("hi"))
    low, high = F.col("lo.avg_cost"), F.col("hi.avg_cost")
    return g.where((F.col("carrier_count") >= 2) & (F.col("priced") >= 2)).select(
        F.col("pickup_pin").alias("pickup"), F.col("drop_pin").alias("drop"),
        F.concat_ws(" → ", "pickup_pin", "drop_pin").alias("lane"), "shipments", "carrier_count",
        F.col("lo.carrier").alias("cheapest"), F.col("hi.carrier").alias("priciest"),
        low.alias("min_avg"), high.alias("max_avg"),
        rounded(F.when(high != 0, (high - low) / high * 100.0)).alias("save_pct"))


def top_lanes(lanes: DataFrame, top: int = 400) -> DataFrame:
    return lanes.orderBy(F.desc("shipments"), "pickup", "drop").limit(top)


def cost_summary(lines: DataFrame) -> DataFrame:
    cat = F.coalesce(blank_to_null(F.col("category")), F.lit("Others"))
    cells = lines.groupBy("carrier", cat.alias("category"), sku_key().alias("item")).agg(*_sums())
    return cells.agg(
        F.sum("paise").alias("paise"), F.sum("shipments").alias("shipments"),
        F.sum("grams").alias("grams"), F.countDistinct("carrier").alias("carriers"),
        F.countDistinct("category").alias("categories"), F.countDistinct("item").alias("skus")) \
        .select(_spend(), "shipments", _avg(), _weight(), _per_kg(), "carriers", "categories", "skus")


def one_carrier(lines: DataFrame, carrier: str | None) -> DataFrame:
    """Lines of one carrier; all of them for none or 'all'."""
    return lines if carrier in (None, "", "all") else lines.where(F.col("carrier") == carrier)


def tag_period(lines: DataFrame, key: Column, label: Column) -> DataFrame:
    """Billing month from the file; carriers that bill per line use their service month."""
    swift = F.lower(F.trim("carrier")).startswith("swift") & (F.col("service_month_key") != "")
    own = month_label(invoice_date(F.concat("service_month_key", F.lit("-01"))))
    return lines.withColumns({
        "month": F.when(swift, F.col("service_month_key")).otherwise(key),
        "month_label": F.when(swift, own).otherwise(label),
    })


def add_gst(amount: Column, rate: float = 18.0) -> Column:
    return rounded(amount * (1.0 + rate / 100.0), 2)


def strip_gst(amount: Column, rate: float = 18.0) -> Column:
    return rounded(amount / (1.0 + rate / 100.0), 2)
