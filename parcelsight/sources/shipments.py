"""Shipment exports, the shipment table, OMS orders and SLA files."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelsight.functions.scalars import text
from parcelsight.operators.filters import is_d2c_channel
from parcelsight.rules.layouts import (
    SLA_DROP_TOKENS, SLA_ORIGIN_TOKENS, SLA_PIN_TOKENS, SLA_TAT_TOKENS)
from parcelsight.rules.shipments import (
    REQUIRED_HEADERS, SHIPMENT_HEADERS, SHIPMENT_TABLE_COLUMNS)
from parcelsight.sources.cells import cell, first_rows, read_fields, select_fields
from parcelsight.sources.windows import Window, window_date


def shipment_fields(cells: DataFrame) -> DataFrame:
    """Raw logical fields of shipment exports; rows without a carrier are skipped."""
    return _carried(select_fields(cells, SHIPMENT_HEADERS, REQUIRED_HEADERS))


def _carried(raw: DataFrame) -> DataFrame:
    return raw.drop("path").where(text(F.col("carrier")) != "")


def read_shipment_files(spark: SparkSession, path: str) -> DataFrame:
    """`shipment_fields` of all delimited files under ``path``; other columns aren't read."""
    return _carried(read_fields(spark, path, SHIPMENT_HEADERS, REQUIRED_HEADERS))


def scan_shipments(table: DataFrame, window: Window, columns: dict[str, str] | None = None,
                   partition: str | None = "window_ts", limit: int | None = None) -> DataFrame:
    """Logical columns of the shipment table in a load window.

    ``partition`` names the logical field the table is partitioned by; its derived bound lets
    Catalyst skip partitions. A row cap takes the first AWBs, so it is repeatable.
    """
    names = columns or SHIPMENT_TABLE_COLUMNS
    kinds = {f.name: f.dataType for f in table.schema.fields}
    day = window_date(F.col(names["order_ts"]), F.col(names["pickup_ts"]),
                      kinds[names["order_ts"]], kinds[names["pickup_ts"]])
    kept = table
    if partition and names.get(partition) in kinds:
        kept = kept.where(window.partition_predicate(F.col(names[partition])))
    kept = kept.where(window.predicate(day)).select(
        *[F.col(column).alias(field) for field, column in names.items()])
    return kept.orderBy("awb").limit(limit) if limit else kept


def scan_orders(table: DataFrame) -> DataFrame:
    """OMS orders of the self-shipped channels."""
    return table.where(F.col("order_code").isNotNull() & is_d2c_channel(F.col("channel"))) \
        .select("order_code", "channel", "order_ts")


def _loose(header: Column, tokens: list[str], exclude: Column | None = None) -> Column:
    """Index of the first header cell that holds any of the tokens."""
    hit = F.transform(header, lambda h: reduce(or_, [F.contains(h, F.lit(t)) for t in tokens]))
    if exclude is not None:
        hit = F.transform(hit, lambda h, i: h & ((exclude.isNull()) | (i != exclude)))
    at = F.array_position(hit, F.lit(True))
    return F.when(at > 0, at - 1).cast("int")


def sla_rows(cells: DataFrame) -> DataFrame:
    """(origin_pin, pincode, tat) rows of SLA files with loose header names; origin may be ANY."""
    heads = first_rows(cells).withColumn("_origin", _loose(F.col("header"), SLA_ORIGIN_TOKENS))
    heads = heads.select(
        "path", "_origin",
        F.coalesce(_loose(F.col("header"), SLA_DROP_TOKENS, F.col("_origin")),
                   _loose(F.col("header"), SLA_PIN_TOKENS, F.col("_origin"))).alias("_pin"),
        _loose(F.col("header"), SLA_TAT_TOKENS).alias("_tat")) \
        .where(F.col("_pin").isNotNull() & F.col("_tat").isNotNull())
    body = cells.where(F.coalesce("row_no", F.lit(1)) > 0).join(heads, "path")
    origin = text(cell("_origin"))
    return body.select(
        "path", "row_no", F.when(origin == "", F.lit("ANY")).otherwise(origin).alias("origin_pin"),
        cell("_pin").alias("pincode"), cell("_tat").alias("tat")) \
        .where(F.col("pincode").isNotNull() & F.col("tat").isNotNull())


def sla_lookup(lookups: DataFrame) -> DataFrame:
    """Nested lookup documents (rule, tier, map of hub -> map of pincode -> tat) as lane rows."""
    hubs = lookups.select("rule", "tier", F.explode("lookup").alias("warehouse", "pins"))
    return hubs.select("rule", "tier", F.when(F.col("warehouse") != "*", F.col("warehouse"))
                       .alias("warehouse"), F.explode("pins").alias("drop_pin", "tat"))


def config_overlay(local: DataFrame, shared: DataFrame) -> DataFrame:
    """Carrier configurations: the shared copy replaces the local one."""
    names = [c for c in local.columns if c != "carrier"]
    marked = shared.withColumn("_present", F.lit(True))
    joined = local.alias("l").join(marked.alias("s"), "carrier", "full_outer")
    has_shared = F.coalesce(F.col("s._present"), F.lit(False))
    return joined.select("carrier", *[F.when(has_shared, F.col(f"s.{c}")).otherwise(F.col(f"l.{c}"))
                                      .alias(c) for c in names])
