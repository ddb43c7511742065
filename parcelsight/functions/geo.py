"""Pincode attributes: one small prefix table, joined once per pincode column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelsight.functions.scalars import digits, lookup
from parcelsight.rules import geo as G
from parcelsight.session import rule_table


def _prefix_row(prefix: str) -> tuple:
    circle = G.CIRCLE_BY_PIN2.get(prefix[:2])
    city = G.CITY_BY_PIN3.get(prefix)
    if len(prefix) < 3:
        tier = "Unknown"
    elif prefix in G.TIER1_PIN3:
        tier = "Tier 1"
    else:
        tier = "Tier 2" if prefix in G.TIER2_PIN3 else "Tier 3"
    return (
        prefix,
        city or circle or f"PIN {prefix}xx",
        city.split(" (")[0].strip() if city else None,
        tier,
        prefix[:2] in G.REMOTE_PIN2 or prefix in G.REMOTE_PIN3,
        G.HUB_BY_PIN3.get(prefix),
    )


def prefix_table(spark: SparkSession) -> DataFrame:
    """All 2- and 3-digit prefixes with city, metro, tier, remote flag and hub.

    1100 rows by construction, so broadcasting it is always safe.
    """
    prefixes = [f"{i:02d}" for i in range(100)] + [f"{i:03d}" for i in range(1000)]
    return rule_table(
        spark, "prefix string,city string,metro string,tier string,remote boolean,hub string",
        [_prefix_row(p) for p in prefixes])


def join_prefix(df: DataFrame, pin: Column, tag: str) -> DataFrame:
    """Add ``<tag>_city/_metro/_tier/_remote/_hub/_prefix`` for a pincode column."""
    table = prefix_table(df.sparkSession)
    table = table.select(*[F.col(c).alias(f"{tag}_{c}") for c in table.columns])
    keyed = df.withColumn(f"{tag}_digits", digits(pin)) \
        .withColumn(f"{tag}_p3", F.substring(f"{tag}_digits", 1, 3))
    return keyed.join(F.broadcast(table), F.col(f"{tag}_p3") == F.col(f"{tag}_prefix"), "left")


def city_name(tag: str) -> Column:
    return F.coalesce(F.col(f"{tag}_city"), F.lit(""))


def tier_name(tag: str) -> Column:
    return F.coalesce(F.col(f"{tag}_tier"), F.lit("Unknown"))


def warehouse_label(pin: Column, city: Column) -> Column:
    return F.when(city != "", F.concat_ws(" · ", city, pin)).otherwise(pin)


def delivery_zone(pickup: str, drop: str) -> Column:
    """A same city, E remote, B tier-1 city, C the rest; the first that holds."""
    p, d = F.col(f"{pickup}_p3"), F.col(f"{drop}_p3")
    known = (F.length(p) == 3) & (F.length(d) == 3)
    same = (p == d) | F.coalesce(F.col(f"{pickup}_metro") == F.col(f"{drop}_metro"), F.lit(False))
    return (
        F.when(known & same, F.lit("A"))
        .when(F.coalesce(F.col(f"{drop}_remote"), F.lit(False)), F.lit("E"))
        .when(tier_name(drop) == "Tier 1", F.lit("B"))
        .otherwise(F.lit("C"))
    )


def hub_code(tag: str) -> Column:
    """Warehouse code of a pickup pincode: exact pin, else its prefix, else ''."""
    return F.when(F.length(f"{tag}_p3") == 3, F.coalesce(
        lookup(f"{tag}_digits", G.HUB_BY_PIN), F.col(f"{tag}_hub"), F.lit(""))).otherwise("")
