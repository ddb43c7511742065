"""Row classification: outcomes, bands, product categories, carrier flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelsight.functions.scalars import (
    constant_array, contains_any_sql, lookup, pick, text)

from parcelsight.rules import products as P
from parcelsight.rules import shipments as S
from parcelsight.session import sql_literal


def banded(c: Column, bands: list[tuple], above: str) -> Column:
    out = F.when(c.isNull(), F.lit("Unknown"))
    for top, label in bands:
        out = out.when(c <= top, F.lit(label))
    return out.otherwise(F.lit(above))


def weight_class(grams: Column) -> Column:
    return banded(grams, S.WEIGHT_CLASSES, "Heavy")


def weight_bucket(grams: Column) -> Column:
    return banded(grams, S.WEIGHT_BUCKETS, "5kg+")


def pickup_slot(ts: Column) -> Column:
    h = F.hour(ts)
    return (
        F.when(ts.isNull(), F.lit("Unknown"))
        .when(h < 12, F.lit(S.PICKUP_SLOTS[0]))
        .when(h >= 17, F.lit(S.PICKUP_SLOTS[-1]))
        .otherwise(pick(h - 11, S.PICKUP_SLOTS))
    )


def status_outcome(status: Column) -> Column:
    """Delivered / RTO / Cancelled, everything else is still moving forward."""
    low = F.lower(text(status))
    return (
        F.when(low == "delivered", F.lit("Delivered"))
        .when(low.startswith("rto-") | low.startswith("rto "), F.lit("RTO"))
        .when(low.isin(S.CANCELLED_STATUSES), F.lit("Cancelled"))
        .otherwise(F.lit("FWD Pendency"))
    )


def settled_outcome(outcome: Column, pickup: Column, order: Column, as_of: Column) -> Column:
    """Never-picked orders of a certain age are presumed lost and count as cancelled."""
    age = F.date_diff(as_of.cast("date"), order.cast("date"))
    lost = (outcome == "FWD Pendency") & pickup.isNull() & (age >= S.LOST_AFTER_DAYS)
    return F.when(lost, F.lit("Cancelled")).otherwise(outcome)


def pendency_state(status: Column) -> Column:
    low = F.lower(text(status))
    index = F.array_position(constant_array([s.lower() for s in S.PENDENCY_STATES]), low)
    found = F.when(index > 0, pick(index.cast("int") - 1, S.PENDENCY_STATES))
    return F.coalesce(found, F.lit("Other"))


def is_reverse(*columns: Column) -> Column:
    hit = F.lit(False)
    for c in columns:
        low = F.lower(F.coalesce(c, F.lit("")))
        hit = hit | low.contains("revers") | low.contains("rvp")
    return hit


def reverse_label(carrier: Column) -> Column:
    """Carrier name without its reverse markers."""
    s = text(carrier)
    cleaned = F.regexp_replace(s, r"(?i)\b(reverse|revers|rvp)\b", " ")
    cleaned = F.regexp_replace(cleaned, r"\s*\[\s*", " [")
    cleaned = F.trim(F.regexp_replace(cleaned, r"\s{2,}", " "))
    return F.when(cleaned != "", cleaned).otherwise(s)


def is_ndd(account: str) -> Column:
    """Next-day account, from the name of a lower-case account column."""
    return F.col(account).isin(S.NDD_ACCOUNT_NAMES) | F.expr(
        contains_any_sql(account, S.NDD_ACCOUNT_TOKENS))


def _first_rule(low: str, keyword_lists: list) -> Column:
    """Index of the first rule with a keyword inside the column; null when none has.

    ``low`` names a lower-case column. Plain substring tests are compiled with the stage and
    need no join on names, so a name that fills a third of the table costs nothing extra.
    """
    branches = " ".join(f"WHEN {contains_any_sql(low, words)} THEN {i}"
                        for i, words in enumerate(keyword_lists))
    return F.expr(f"CASE {branches} END")


def _first_rule_compact(low: str, keyword_lists: list) -> Column:
    """Same result as `_first_rule` from a constant array of (rule, keyword) pairs.

    The generated code stays tiny however often Catalyst copies the expression into filters
    and join keys; used where the inputs are smaller than the shipment table.
    """
    pairs = ", ".join(f"struct({i} AS i, {sql_literal(k)} AS k)"
                      for i, words in enumerate(keyword_lists) for k in words)
    return F.expr(f"get(filter(array({pairs}), r -> contains({low}, r.k)), 0).i")


def product_rule(low: str) -> Column:
    """Product rule index for a lower-case item name column: -1 blank, null unmatched."""
    return F.when(F.col(low) == "", F.lit(-1)).otherwise(
        _first_rule(low, [r[2] for r in P.PRODUCT_RULES]))


def product_category(rule: Column) -> Column:
    return F.when(rule == -1, F.lit(P.PRODUCT_BLANK[0])).otherwise(
        F.coalesce(pick(rule, [r[0] for r in P.PRODUCT_RULES]), F.lit(P.PRODUCT_DEFAULT[0])))


def product_subcategory(rule: Column) -> Column:
    return F.when(rule == -1, F.lit(P.PRODUCT_BLANK[1])).otherwise(
        F.coalesce(pick(rule, [r[1] for r in P.PRODUCT_RULES]), F.lit(P.PRODUCT_DEFAULT[1])))


def display_category(category: str) -> Column:
    """Fine category -> display group; blank counts as Unknown, other labels pass through."""
    cat = F.col(category)
    return F.coalesce(lookup(category, P.DISPLAY_GROUP), F.when(cat != "", cat),
                      F.lit(P.DISPLAY_GROUP["Unknown"]))


def add_invoice_category(df: DataFrame, label: Column, name: Column, out: str) -> DataFrame:
    """Known label, else keywords in the name, else keywords in the label, else Others."""
    words, cats = [k for _, k in P.INVOICE_RULES], [c for c, _ in P.INVOICE_RULES]
    staged = df.withColumns({"_label": F.lower(text(label)), "_name": F.lower(text(name))}) \
        .withColumn("_first", F.trim(F.get(F.split("_label", "[|/]"), 0)))
    return staged.withColumn(out, F.coalesce(
        lookup("_first", P.EXPLICIT_CATEGORY),
        pick(_first_rule_compact("_name", words), cats),
        F.when(F.col("_label") != "", pick(_first_rule_compact("_label", words), cats)),
        F.lit(P.INVOICE_DEFAULT),
    )).drop("_label", "_name", "_first")


def master_category(label: Column, name: Column, resolved: Column) -> Column:
    """Category of an item-master row: combos group as bundles, flat-feet ones as orthotics."""
    first = F.lower(F.trim(F.get(F.split(text(label), "[|/]"), 0)))
    low = F.lower(text(name))
    combo = F.when(low.contains("flat feet") | low.contains("flat foot"), F.lit("Orthotics")) \
        .otherwise(F.lit("Bundles"))
    return F.when(first == "combo", combo).otherwise(resolved)
