"""Identities the figures must satisfy whatever the data."""

import pytest
from pyspark.sql import functions as F

from parcelsight.catalog import load
from parcelsight.catalog.registry import Inputs, run
from parcelsight.operators import invoices as I
from parcelsight.operators import kpi as K
from parcelsight.operators import revenue as R
from parcelsight.operators import sla
from parcelsight.operators.filters import Filters, filter_shipments
from parcelsight.plans import reports
from parcelsight.rules.shipments import SCORE_WEIGHTS
from parcelsight.rules.sla import SLA_RULES


@pytest.fixture(scope="module")
def inputs(spark, folder):
    return Inputs(spark, folder)


@pytest.fixture(scope="module")
def summary(inputs):
    return R.summary(inputs.classified).first()


def test_weights_sum_to_one():
    assert abs(sum(w for w, _ in SCORE_WEIGHTS.values()) - 1.0) < 1e-12


def test_value_buckets_add_up(summary):
    parts = sum(summary[c] for c in ("delivered_value", "rto_value", "pending_value", "cancelled_value"))
    assert parts == pytest.approx(summary["revenue"], abs=0.3)


def test_counts_add_up(summary):
    assert summary["delivered"] + summary["rto"] + summary["pending_orders"] \
        + summary["cancelled_orders"] == summary["total"]


def test_sla_statuses_partition(inputs):
    t = K.tat_summary(inputs.classified).first()
    assert t["in_tat"] + t["out_tat"] + t["no_rule"] + t["pending"] == t["n"]


def test_zones_and_days_cover_all(inputs, summary):
    assert R.zone_breakdown(inputs.ships).agg(F.sum("n")).first()[0] == summary["total"]
    assert R.daily_series(inputs.facts).agg(F.sum("n")).first()[0] == summary["total"]


def test_status_shares(inputs):
    row = K.status_matrix(inputs.facts).first()
    assert sum(row[c] for c in row.asDict() if c.endswith("_pct")) == pytest.approx(100, abs=0.3)


def test_product_spend_reconciles(inputs):
    lines = inputs.enriched
    total = I.cost_summary(lines).first()["spend"]
    for part in (I.spend_by_product(lines, None), I.spend_by_subcategory(lines)):
        assert part.agg(F.sum("spend")).first()[0] == pytest.approx(total, abs=1.0)


def test_no_filter_passes_through(inputs):
    assert filter_shipments(inputs.facts, Filters(zone="all", payment=[])) is inputs.facts


def test_rule_order():
    names = [r.name for r in SLA_RULES]
    assert names.index("Swift NDD") < names.index("GoSwift")
    assert names.index("Shadowfax Large") < names.index("Shadowfax")


def test_scores_scan_once(inputs):
    """The score bounds reuse the shuffle of the groups they are taken from."""
    df = K.by_carrier(inputs.facts)
    plan_holder = df._jdf.queryExecution()
    df.collect()
    assert "ReusedExchange" in plan_holder.executedPlan().toString() or _reused(df)


def _reused(df):
    return "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_median_of_a_hot_key_with_distinct_gaps(spark):
    """One carrier holds nine tenths of the rows, every gap differs by microseconds."""
    import statistics

    rows = spark.range(6000).select(
        F.when(F.col("id") % 10 == 0, F.concat(F.lit("c"), F.col("id") % 70)).otherwise("hot").alias("carrier"),
        F.when(F.col("id") % 97 != 0, F.pmod(F.xxhash64("id"), F.lit(400_000_000_000))).alias("o2s_us"),
        F.lit(True).alias("picked"), F.lit(True).alias("delivered"), F.lit(1).alias("attempts"),
        F.lit("RTO").alias("outcome"), F.lit(3_600_000_000).alias("p2o_us"), F.lit(1).alias("p2d_us"))
    gaps = {}
    for r in rows.collect():
        gaps.setdefault(r.carrier, []).append(r.o2s_us)
    got = {r.carrier: (r.n, r.o2s) for r in K.kpi_block(rows, ["carrier"]).collect()}
    assert got == {c: (len(g), statistics.median([x for x in g if x is not None]) / 3.6e9) for c, g in gaps.items()}
    whole = K.kpi_block(rows, []).first()
    assert whole.o2s == statistics.median([x for g in gaps.values() for x in g if x is not None]) / 3.6e9


def test_median_walks_share_a_shuffle(inputs):
    """Both walks of the median read the shuffle of the first grouping: the source is read once."""
    block = K.kpi_block(inputs.facts, ["account"])
    block.collect()
    final = block._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final


@pytest.mark.parametrize("name", ["inv_product"])
def test_lines_are_enriched_once(spark, folder, name):
    """What reads enriched lines several times reads them written, not joined again each time."""
    load()
    files = run(name, spark, folder).inputFiles()
    assert any("enriched-" in f for f in files) and not any("lineitem" in f for f in files)


def test_promises_are_found_where_the_shipments_are(spark):
    """Shipments aren't shuffled to meet promises; those without a rule or a pincode find none."""
    ships = spark.createDataFrame(
        [("a", "Blue Dart", "x_STD", "412106", "411001", "CAH", "PUNE", "CHENNAI"),
         ("b", "Blue Dart", "x_STD", "412106", "", "CAH", "PUNE", ""),
         ("c", "Nobody", "", "", "411001", "", "", ""),
         ("d", "GoSwift", "x", "562114", "600001", "BLR", "BANGALORE", "CHENNAI")],
        "awb string, carrier string, account string, pickup_pin string, drop_pin string, hub string, "
        "city string, drop_city string")
    rules = {r.awb: r.rule for r in sla.add_rule(ships).collect()}
    assert rules["c"] is None
    lanes = spark.createDataFrame(
        [(rules["a"], "primary", None, "411001", None, None, 3.0), (rules["d"], "city", None, None, "BANGALORE", "CHENNAI", 4.0)],
        "rule string, tier string, warehouse string, drop_pin string, pickup_city string, drop_city string, tat double")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = sla.add_lane_tat(sla.add_city_tat(sla.add_rule(ships), lanes), lanes)
        got = {r.awb: (r.tat_primary, r.tat_city) for r in found.collect()}
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got["a"][0] == 3.0 and got["b"] == got["c"] == (None, None)
    assert got["d"][1] == (4.0 if rules["d"] in sla._rules_with(SLA_RULES, "has_city_lanes") else None)
    assert "SortMergeJoin" not in plan


def test_report_sections_read_the_columns_named(inputs):
    """Every section can be built from the columns that reports write out."""
    rows = inputs.classified
    assert len(reports.shipment_report(rows.select(*reports.REPORT_READS))) == 16
    some = ["carriers", "warehouses", "destinations", "lanes", "products", "daily"]
    assert reports.digest(reports.shipment_report(rows.select(*reports.DIGEST_READS), only=some)).columns


@pytest.mark.parametrize("name", ["agg_single_pass"])
def test_only_columns_read_are_written(spark, folder, name):
    load()
    first = run(name, spark, folder).inputFiles()[0].rsplit("/", 1)[0]
    written = spark.read.parquet(first).columns
    assert "tat_status" in written and "item_name" not in written and len(written) < 20
