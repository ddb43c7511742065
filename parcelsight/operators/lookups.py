"""Shipment and item-master dimensions, and the joins that enrich invoice lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelsight.functions.classify import add_invoice_category, master_category
from parcelsight.functions.scalars import (
    blank_to_null, clean_name, norm_awb, norm_order, split_skus, text, to_money)
from parcelsight.operators.common import maybe_in, spread_blank

WEAK = ["Others", "Unknown", ""]


def _payload() -> Column:
    return F.struct("category", "subcategory", "sku", "item_name")


def _product() -> Column:
    filled = F.concat("category", "subcategory", "sku", "item_name") != ""
    return F.when(filled, _payload())


def _lane() -> Column:
    both = (F.col("pickup_pin") != "") & (F.col("drop_pin") != "")
    return F.when(both, F.struct("pickup_pin", "drop_pin"))


def awb_dim(shipments: DataFrame) -> DataFrame:
    """Product, value, lane and order id per AWB; the latest shipment wins.

    max over a struct combines on the map side and settles ties by content.
    """
    def last(value: Column) -> Column:
        return F.max(F.when(value.isNotNull(), F.struct("order_date", "order_id", value.alias("v"))))

    dim = shipments.withColumn("key", norm_awb(F.col("awb"))).where(F.col("key") != "").groupBy("key")
    oid = blank_to_null(norm_order(F.col("order_id")))
    return dim.agg(last(_product()).alias("p"), last(F.col("order_value")).alias("v"),
                   last(_lane()).alias("l"), last(oid).alias("o")).select(
        F.col("key").alias("awb_key"), F.col("p.v").alias("awb_product"),
        F.col("v.v").alias("awb_value"), F.col("l.v").alias("awb_lane"),
        F.col("o.v").alias("awb_order"))


def order_dim(shipments: DataFrame) -> DataFrame:
    """Product, value and lane per order id; the first AWB wins."""
    def first(value: Column) -> Column:
        return F.min(F.when(value.isNotNull(), F.struct("awb", value.alias("v"))))

    dim = shipments.withColumn("key", norm_order(F.col("order_id"))).where(F.col("key") != "")
    return dim.groupBy("key").agg(first(_product()).alias("p"), first(F.col("order_value")).alias("v"),
                                  first(_lane()).alias("l")).select(
        F.col("key").alias("ord_key"), F.col("p.v").alias("ord_product"),
        F.col("v.v").alias("ord_value"), F.col("l.v").alias("ord_lane"))


def likely_billed(shipments: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shipments whose AWB may be on a line, and those whose order id may be: `match_shipments` needs no
    others. It is for lines that are far fewer than shipments, and takes shipments as they come.
    """
    return tuple(maybe_in(shipments, key(F.col(c)), lines.select(key(F.col(c)).alias("id")), "_billed")
                 .where("_billed").drop("_billed") for c, key in (("awb", norm_awb), ("order_id", norm_order)))


def billed_shipments(shipments: DataFrame, lines: DataFrame) -> DataFrame:
    """Shipments whose AWB or order id is on an invoice.

    Two left joins against distinct ids set flags, so the shipments are read once and none is
    repeated or lost; ids of any number are joined, never chunked.
    """
    awbs = lines.select(norm_awb(F.col("awb")).alias("_a")).where(F.col("_a") != "").distinct() \
        .withColumn("_has_awb", F.lit(True))
    orders = lines.select(norm_order(F.col("order_id")).alias("_o")).where(F.col("_o") != "") \
        .distinct().withColumn("_has_order", F.lit(True))
    keyed = shipments.withColumns({
        "_ka": spread_blank(norm_awb(F.col("awb")), F.col("order_id")),
        "_ko": spread_blank(norm_order(F.col("order_id")), F.col("awb"))})
    return keyed.join(awbs, F.col("_ka") == F.col("_a"), "left") \
        .join(orders, F.col("_ko") == F.col("_o"), "left") \
        .where(F.coalesce("_has_awb", "_has_order")) \
        .drop("_ka", "_ko", "_a", "_o", "_has_awb", "_has_order")


def enrichment_window(lines: DataFrame) -> DataFrame:
    """Dates to search shipments in: 90 days before the first billed month to 15 after the last."""
    start = F.to_date(F.concat(F.min(blank_to_null(F.col("service_month_key"))), F.lit("-01")))
    end = F.last_day(F.to_date(F.concat(F.max(blank_to_null(F.col("service_month_key"))),
                                        F.lit("-01"))))
    return lines.agg(F.date_sub(start, 90).alias("from_date"), F.date_add(end, 15).alias("to_date"))


def in_enrichment_window(shipments: DataFrame, lines: DataFrame) -> DataFrame:
    bounds = enrichment_window(lines).select(F.struct("from_date", "to_date").alias("b"))
    day = F.coalesce("order_date", "pickup_date")
    return shipments.withColumn("_b", bounds.scalar()) \
        .where(day.between(F.col("_b.from_date"), F.col("_b.to_date"))).drop("_b")


def match_shipments(lines: DataFrame, shipments: DataFrame | tuple[DataFrame, DataFrame]) -> DataFrame:
    """Match lines by AWB, else by order id, adding ``m_product``, ``m_value``, ``m_lane``.

    The payload travels as a struct, so fields of the two sources never mix. Given as a pair, the first
    shipments are searched by AWB and the second by order id (`likely_billed`).
    """
    by_awb, by_order = shipments if isinstance(shipments, tuple) else (shipments, shipments)
    keyed = lines.withColumns({
        "_ka": spread_blank(norm_awb(F.col("awb")), F.concat("order_id", "sku", "amount")),
        "_ko": spread_blank(norm_order(F.col("order_id")), F.concat("awb", "sku", "amount"))})
    joined = keyed.join(awb_dim(by_awb), F.col("_ka") == F.col("awb_key"), "left") \
        .join(order_dim(by_order), F.col("_ko") == F.col("ord_key"), "left")
    return joined.withColumns({
        "m_product": F.coalesce("awb_product", "ord_product"),
        "m_value": F.coalesce("awb_value", "ord_value"),
        "m_lane": F.coalesce("awb_lane", "ord_lane"),
        "m_order": F.coalesce(blank_to_null(norm_order(F.col("order_id"))), F.col("awb_order"),
                              F.lit("")),
    }).drop("_ka", "_ko", "awb_key", "awb_product", "awb_value", "awb_lane", "awb_order", "ord_key",
            "ord_product", "ord_value", "ord_lane")


def attach_products(matched: DataFrame) -> DataFrame:
    """Subcategory, blank SKU and name from the shipment; its category unless that is weak."""
    p = F.col("m_product")
    found = p.isNotNull()
    name = F.when(F.col("product") == "", blank_to_null(p["item_name"]))
    return matched.withColumns({
        "subcategory": F.coalesce(p["subcategory"], F.lit("")),
        "sku": F.when(F.col("sku") == "", F.coalesce(p["sku"], F.lit(""))).otherwise(F.col("sku")),
        "product": F.coalesce(name, F.col("product")),
        "sku_name": F.when(F.col("sku_name") == "", F.coalesce(name, F.lit("")))
        .otherwise(F.col("sku_name")),
        "category": F.when(found & ~p["category"].isin(WEAK), p["category"])
        .otherwise(F.col("category")),
        "prod_matched": found,
    }).drop("m_product")


def attach_values(matched: DataFrame) -> DataFrame:
    """Declared order value and the order key it is de-duplicated by."""
    return matched.withColumnsRenamed({"m_value": "order_value", "m_order": "order_key"})


def attach_lanes(matched: DataFrame) -> DataFrame:
    return matched.withColumns({
        "pickup_pin": F.coalesce("m_lane.pickup_pin", F.lit("")),
        "drop_pin": F.coalesce("m_lane.drop_pin", F.lit("")),
    }).drop("m_lane")


def attach_shipments(lines: DataFrame, shipments: DataFrame) -> DataFrame:
    """All three attachments from one match."""
    return attach_lanes(attach_values(attach_products(match_shipments(lines, shipments))))


def read_master(raw: DataFrame) -> DataFrame:
    """Item-master rows with cleaned names, resolved category and a positive weight."""
    cleaned = raw.withColumns({
        "sku": text(F.col("sku")), "awb": norm_awb(F.col("awb")),
        "product": clean_name(F.col("product")), "vol_kg": to_money(F.col("vol_kg"))})
    resolved = add_invoice_category(cleaned, F.col("category"), F.col("product"), "_resolved")
    return resolved.where(F.concat(text(F.col("category")), "product", "sku") != "").withColumns({
        "category": master_category(F.col("category"), F.col("product"), F.col("_resolved")),
        "sku_key": F.upper("sku"),
        "vol_kg": F.when(F.col("vol_kg") > 0, F.col("vol_kg")),
    }).drop("_resolved")


def master_by_awb(master: DataFrame) -> DataFrame:
    named = F.when(F.col("product") != "", F.col("product")).otherwise(F.col("sku"))
    return master.where(F.col("awb") != "").groupBy(F.col("awb").alias("ma_key")).agg(
        F.max(F.struct("sku_key", F.struct("category", named.alias("product"), "sku").alias("v")))
        .alias("x")).select("ma_key", F.col("x.v").alias("ma"))


def master_by_sku(master: DataFrame) -> DataFrame:
    named = F.when(F.col("product") != "", F.col("product")).otherwise(F.col("sku"))
    usable = (F.col("sku_key") != "") & ((F.col("product") != "") | (F.col("category") != "Others"))
    return master.where(usable).groupBy(F.col("sku_key").alias("ms_key")).agg(
        F.max(F.struct("awb", F.struct("category", named.alias("product")).alias("v"))).alias("x")) \
        .select("ms_key", F.col("x.v").alias("ms"))


def master_weights(master: DataFrame) -> DataFrame:
    """Volumetric grams per SKU."""
    grams = F.floor(F.col("vol_kg") * 1000 + 0.5).cast("bigint")
    return master.where((F.col("sku_key") != "") & F.col("vol_kg").isNotNull()).groupBy(
        F.col("sku_key").alias("mw_key")).agg(F.max(grams).alias("grams"))


def overlay(default: DataFrame, session: DataFrame, key: str) -> DataFrame:
    """Keyed overlay: the session's row replaces the default's."""
    names = [c for c in default.columns if c != key]
    joined = default.alias("d").join(session.alias("s"), key, "full_outer")
    has_session = F.coalesce(F.col("s._present"), F.lit(False))
    return joined.select(key, *[F.when(has_session, F.col(f"s.{c}")).otherwise(F.col(f"d.{c}"))
                                .alias(c) for c in names if c != "_present"])


def _by_key(master: DataFrame, fields: list[str]) -> DataFrame:
    """One row per SKU, that of the largest values where a SKU repeats; blank SKUs go."""
    return master.where(F.coalesce("sku_key", F.lit("")) != "").groupBy("sku_key").agg(
        F.max(F.struct(*fields)).alias("x")).select("sku_key", "x.*")


def master_overlay(default: DataFrame, session: DataFrame) -> DataFrame:
    """Default item master overlaid by the session's, per SKU."""
    fields = ["category", "product", "vol_kg"]
    present = F.lit(True).alias("_present")
    return overlay(_by_key(default, fields).select("*", present),
                   _by_key(session, fields).select("*", present), "sku_key")


def master_merge(files: DataFrame) -> DataFrame:
    """Several master files as one: per SKU the latest file (``seq``) that has a value wins.

    Category and product come together from one file, the weight from the latest that has one.
    """
    latest = F.struct("seq", "category", "product")
    weighed = F.when(F.col("vol_kg").isNotNull(), F.struct("seq", "vol_kg"))
    named = F.when(F.col("category").isNotNull() | F.col("product").isNotNull(), latest)
    return files.groupBy("sku_key").agg(F.max(named).alias("n"), F.max(weighed).alias("w")) \
        .select("sku_key", "n.category", "n.product", "w.vol_kg")


def enrich_from_master(lines: DataFrame, master: DataFrame) -> DataFrame:
    """Weak lines take category, product and SKU from the master by AWB, then by SKU."""
    weak = F.col("category").isin(WEAK)
    open_line = weak | (F.col("product") == "")
    first = lines.withColumn("_ka", spread_blank(norm_awb(F.col("awb")), F.concat("order_id", "sku"))) \
        .join(master_by_awb(master), F.col("_ka") == F.col("ma_key"), "left")
    a = F.when(open_line, F.col("ma"))
    step = first.withColumns({
        "_open": open_line,
        "category": F.when(weak & ~F.coalesce(a["category"], F.lit("Others")).isin("Others", ""),
                           a["category"]).otherwise(F.col("category")),
        "product": F.when(F.col("product") == "", F.coalesce(a["product"], F.lit("")))
        .otherwise(F.col("product")),
        "sku": F.when(F.col("sku") == "", F.coalesce(a["sku"], F.lit(""))).otherwise(F.col("sku")),
    }).drop("_ka", "ma_key", "ma")
    second = step.withColumn("_ks", spread_blank(F.upper("sku"), F.concat("awb", "order_id"))) \
        .join(master_by_sku(master), F.col("_ks") == F.col("ms_key"), "left")
    s = F.when(F.col("_open") & weak, F.col("ms"))
    return second.withColumns({
        "category": F.when(~F.coalesce(s["category"], F.lit("Others")).isin("Others", ""),
                           s["category"]).otherwise(F.col("category")),
        "product": F.when(F.col("product") == "", F.coalesce(s["product"], F.lit("")))
        .otherwise(F.col("product")),
    }).drop("_ks", "ms_key", "ms", "_open")


def _sku_is_blank() -> Column:
    return F.coalesce(F.col("sku") == "", F.lit(False))


def without_sku(lines: DataFrame) -> DataFrame:
    return lines.where(_sku_is_blank())


def settle_skus(lines: DataFrame, master: DataFrame,
                shipments: DataFrame | tuple[DataFrame, DataFrame]) -> DataFrame:
    """Lines with the SKU that the enrichment gives them; their own one goes to ``own_sku``.

    Only a blank SKU is ever replaced, so only lines without one meet the master and the shipments.
    """
    kept = lines.withColumn("own_sku", F.col("sku"))
    own = {c: f"_own_{c}" for c in ("category", "product", "sku_name")}
    filled = attach_products(match_shipments(enrich_from_master(
        without_sku(kept).withColumns({o: F.col(c) for c, o in own.items()}), master), shipments))
    # only the SKU is taken: all else is enriched from the line as it came
    return kept.where(~_sku_is_blank()).unionByName(
        filled.select(*[F.col(own.get(c, c)).alias(c) for c in kept.columns]))


def sku_texts(lines: DataFrame) -> DataFrame:
    """Distinct SKU texts with their tokens exploded; far fewer rows than lines."""
    return lines.select("sku").where(F.col("sku") != "").distinct().select(
        F.col("sku").alias("sku_text"),
        F.posexplode(F.transform(split_skus(F.col("sku")), F.upper)).alias("pos", "token"))


def sku_weights(lines: DataFrame, master: DataFrame) -> DataFrame:
    """Expected grams per SKU text, and how many of its SKUs the master does not know."""
    return sku_texts(lines).join(master_weights(master), F.col("token") == F.col("mw_key"), "left") \
        .groupBy("sku_text").agg(
            F.sum("grams").alias("expected_g"),
            F.count_if(F.col("grams").isNull()).alias("skus_missing"))


def sku_labels(lines: DataFrame, master: DataFrame) -> DataFrame:
    """Tokens and master names of multi-SKU texts, in the order written."""
    named = sku_texts(lines).join(master_by_sku(master), F.col("token") == F.col("ms_key"), "left") \
        .withColumn("name", F.coalesce(blank_to_null(F.col("ms.product")), F.col("token")))
    packed = named.groupBy("sku_text").agg(
        F.sort_array(F.collect_list(F.struct("pos", "token", "name"))).alias("parts"))
    return packed.where(F.size("parts") > 1).select(
        "sku_text", F.array_join("parts.token", ", ").alias("skus"),
        F.array_join("parts.name", ", ").alias("names"),
        F.size(F.array_distinct("parts.token")).cast("bigint").alias("product_count"))


def category_from_master(shipments: DataFrame, master: DataFrame) -> DataFrame:
    """Shipment category from the first SKU of its list that the master knows.

    Resolved per distinct SKU text and joined back.
    """
    by_sku = master_by_sku(master)
    tokens = shipments.select("sku").where(F.col("sku") != "").distinct().select(
        F.col("sku").alias("sku_text"),
        F.posexplode(F.split("sku", "[,;|/]+")).alias("pos", "token"))
    hits = tokens.join(by_sku, F.upper(F.trim("token")) == F.col("ms_key")) \
        .groupBy("sku_text").agg(F.min(F.struct("pos", "ms")).alias("hit")) \
        .select("sku_text", F.col("hit.ms").alias("hit"))
    keyed = shipments.withColumn("_ks", spread_blank(F.col("sku"), F.col("awb")))
    good = F.coalesce(F.col("hit.category"), F.lit("Others")) != "Others"
    return keyed.join(hits, F.col("_ks") == F.col("sku_text"), "left").withColumns({
        "category": F.when(good, F.col("hit.category")).otherwise(F.col("category")),
        "subcategory": F.when(good, F.coalesce(blank_to_null(F.col("hit.product")),
                                               blank_to_null(F.col("subcategory")),
                                               F.col("hit.category"))).otherwise(F.col("subcategory")),
    }).drop("_ks", "sku_text", "hit")
