"""Multi-SKU lines and weight checks: which lines meet the shipments, and that none is lost by it."""

import pytest

from parcelsight.catalog import load
from parcelsight.catalog.registry import Inputs
from parcelsight.operators import invoices as I
from parcelsight.operators import lookups as L
from parcelsight.operators.shipments import shipment_facts

LINES = [
    # awb, order_id, sku, product, weight_kg: blank SKUs that the master, the AWB, the order or nobody knows
    ("A1", "1", "S1", "", 9.0), ("A2", "2", "", "", 9.0), ("A3", "", "", "", 9.0), ("", "#4_R1", "", "", 9.0),
    ("", "", "", "", 9.0), ("A6", "6", None, "x", 9.0), ("A7", "7", "S1, S2", "", 9.0),
    ("A7", "7", "S1, S2", "", 9.0), ("A8", "8", "S9", "named", 9.0), ("A9", "9", "", "", 0.0),
    ("A1", "1", "S1", "", 0.4), ("A10", "10", " ", "", 9.0), (None, None, "S1", None, 9.0),
    ("A11", "11", "", "", 9.0), ("A12", "12", "S1/", "", 9.0), ("A7", "", "S2|S2", "", 9.0)]


@pytest.fixture(scope="module")
def frames(spark):
    lines = spark.createDataFrame(
        [(f"c{k % 2}", a, o, s, p, p, "Others", w, "", float(k), 1.0, 1, f"I{k % 3}", "2024-01-02", "2024-01", "F")
         for k, (a, o, s, p, w) in enumerate(LINES)],
        "carrier string, awb string, order_id string, sku string, product string, sku_name string, "
        "category string, weight_kg double, zone string, amount double, amount_ex_gst double, shipments long, "
        "invoice_number string, invoice_date string, service_month_key string, direction string")
    master = L.read_master(spark.createDataFrame(
        [("s1", "", "Insoles", "Arch Insole", "0.4"), ("s2", "A2", "Mobility", "Wheelchair", "0.5"),
         ("s3", "", "Orthotics", "Knee Brace", "0.3")],
        "sku string, awb string, category string, product string, vol_kg string"))
    ships = spark.createDataFrame(
        [("x", a, o, s, "Knee Brace", "2024-01-01 00:00:00") for a, o, s in (
            ("A1", "1", "S3"), ("A2", "2", "S3"), ("A3", "3", "S3, S1"), ("A4", "4", "S3"), ("A7", "7", "S3"),
            ("A9", "9", "S3"), ("A11", "11", ""), ("A1", "1", "S1"))],
        "carrier string, awb string, order_id string, sku string, item_names string, order_ts string")
    return lines, master, shipment_facts(ships, "2024-06-30 00:00:00")


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_settled_skus(frames):
    lines, master, ships = frames
    settled = L.settle_skus(lines, master, ships)
    enriched = L.attach_shipments(L.enrich_from_master(lines, master), ships)
    assert rows(settled.select("amount", "sku")) == rows(enriched.select("amount", "sku"))
    assert rows(settled.withColumn("sku", settled["own_sku"]).drop("own_sku")) == rows(lines)


def test_checks_of_settled_lines(frames):
    lines, master, ships = frames
    settled = L.settle_skus(lines, master, ships)
    enriched = L.attach_shipments(L.enrich_from_master(lines, master), ships)
    want, got = I.weight_checks(enriched, master), I.weight_checks(settled, master)
    flagged = I.flagged_checks(settled, master, ships)
    found = rows(flagged)
    assert len(found) >= 8 and found == rows(want.where("flagged").select(flagged.columns))
    assert rows(I.dispute_rollup(got, "product")) == rows(I.dispute_rollup(want, "product"))
    several = I.multi_sku_lines(settled, master)
    found = rows(several)
    assert len(found) == 4 and found == rows(I.multi_sku_lines(enriched, master))


def test_lines_that_meet_shipments(spark, folder, monkeypatch):
    """Lines without a SKU of their own, and the flagged ones where more than their SKU is read."""
    met, match = [], L.match_shipments
    monkeypatch.setattr(L, "match_shipments", lambda lines, ships: met.append(lines) or match(lines, ships))
    inputs = Inputs(spark, folder)
    for name in ("inv_multi_sku", "inv_multi_sku_summary", "topk_multi_sku", "inv_dispute_invoice",
                 "inv_dispute_product", "inv_dispute_rollups", "topk_dispute_products"):
        load()[name][0](inputs)
    assert len(met) == 1 and met[0].where("own_sku <> ''").isEmpty()
    for name in ("inv_weight_dispute", "topk_dispute_lines", "inv_dispute_subcategory"):
        load()[name][0](inputs)
    assert len(met) == 4 and met[1].where("NOT flagged").isEmpty()
