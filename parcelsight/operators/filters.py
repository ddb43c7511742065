"""The dashboard filters as one declarative predicate."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelsight.functions.scalars import text
from parcelsight.rules import shipments as S

# Filter -> column it constrains.
_COLUMNS = {
    "delivery_type": "delivery_type",
    "zone": "zone",
    "payment": "payment",
    "warehouse": "pickup_pin",
    "account": "account",
    "weight": "weight_class",
    "slot": "pickup_slot",
    "tier": "tier",
    "channel": "channel",
    "reverse_carrier": "carrier",
}


@dataclass(frozen=True)
class Filters:
    """Each categorical filter takes nothing, 'all', one value or several."""

    delivery_type: object = None
    zone: object = None
    payment: object = None
    warehouse: object = None
    account: object = None
    weight: object = None
    slot: object = None
    tier: object = None
    channel: object = None
    reverse_carrier: object = None
    date_from: str | None = None
    date_to: str | None = None


def _chosen(value) -> list:
    items = value if isinstance(value, (list, tuple, set, frozenset)) else [value]
    return sorted(str(v) for v in items if v not in (None, "", "all"))


def filter_predicates(filters: Filters) -> list[Column]:
    preds = []
    for field in fields(filters):
        if field.name not in _COLUMNS:
            continue
        values = _chosen(getattr(filters, field.name))
        if values:
            preds.append(F.col(_COLUMNS[field.name]).isin(values))
            if field.name == "reverse_carrier":
                preds.append(F.col("is_reverse"))
    if filters.date_from:
        preds.append(F.col("order_date") >= F.lit(filters.date_from).cast("date"))
    if filters.date_to:
        preds.append(F.col("order_date") <= F.lit(filters.date_to).cast("date"))
    return preds


def filter_shipments(df: DataFrame, filters: Filters | None = None) -> DataFrame:
    """Conjunction of the set filters; unconstrained input passes through unchanged.

    Rows without an order date only drop when a date bound is set.
    """
    preds = filter_predicates(filters) if filters else []
    return df.where(reduce(and_, preds)) if preds else df


def tat_status_in(df: DataFrame, statuses) -> DataFrame:
    chosen = _chosen(statuses)
    if not chosen:
        return df
    return df.where(F.coalesce(F.col("tat_status"), F.lit("No rule")).isin(chosen))


def is_d2c_channel(channel: Column) -> Column:
    up = F.upper(channel)
    return up.contains(S.D2C_CHANNEL_TOKEN) | up.isin(S.D2C_CHANNELS)


def carrier_prefix(name: Column) -> Column:
    """First token of a carrier name, letters and digits only, lower case."""
    first = F.regexp_extract(F.lower(text(name)), r"^[^ _\-/]*", 0)
    return F.regexp_replace(first, "[^a-z0-9]", "")


def carrier_prefix_in(df: DataFrame, names: DataFrame, carrier: str = "carrier",
                      key: str = "awb") -> DataFrame:
    """Shipments whose carrier starts with the first token of any carrier in ``names``.

    Works on distinct carrier labels: the prefix test runs once per (label, prefix length),
    as an equality join, and the result is a semi join back to the rows.
    """
    prefixes = names.select(carrier_prefix(F.col(carrier)).alias("prefix")).distinct() \
        .where(F.col("prefix") != "")
    labels = df.select(carrier).distinct().withColumn(
        "prefix", F.explode(F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(carrier), F.lit(1))),
            lambda n: F.lower(F.col(carrier)).substr(F.lit(1), n))))
    wanted = labels.join(prefixes, "prefix", "left_semi").select(carrier).distinct()
    return df.join(wanted, carrier, "left_semi")
