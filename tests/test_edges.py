"""Hand-made edge cases on small frames."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelsight.functions import classify as C
from parcelsight.functions import scalars as N
from parcelsight.functions import times as TM
from parcelsight.functions.geo import join_prefix
from parcelsight.operators import invoices as I
from parcelsight.operators import kpi as K
from parcelsight.operators import lookups as L
from parcelsight.operators import revenue as R
from parcelsight.operators.shipments import build_shipments
from parcelsight.sources.cells import read_cells, select_fields
from parcelsight.sources.shipments import config_overlay
from parcelsight.sources.windows import Window, clamp_lookback

AS_OF = "2024-06-30 00:00:00"


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(column(F.col("x"))).collect()]


def ships(spark, rows):
    names = ["awb", "order_id", "carrier", "account", "pickup_ts", "order_ts", "delivery_ts",
             "ofd1_ts", "status", "attempts", "order_value", "pickup_pin", "drop_pin"]
    raw = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows],
                                ", ".join(f"{n} string" for n in names))
    return build_shipments(raw, AS_OF)


def test_pincodes(spark):
    assert one(spark, N.norm_pincode, "560037.0", " 560037 ", "AB12", "", None) == \
        ["560037", "560037", "AB12", "", ""]


def test_numbers(spark):
    assert one(spark, N.to_number, "5d", "1e3", " 7 ", "", "1,000", None) == \
        [None, 1000.0, 7.0, None, None, None]
    assert one(spark, N.to_money, "₹ 1,180.00", "x") == [1180.0, None]


def test_timestamps(spark):
    got = one(spark, TM.text_to_ts, "6/2/2026 23:58", "6/2/26", "6/2/70", "2026-06-02T10:00:00.5",
              "13/40/2026", "45000", "soon")
    assert got == [dt.datetime(2026, 6, 2, 23, 58), dt.datetime(2026, 6, 2), dt.datetime(1970, 6, 2),
                   dt.datetime(2026, 6, 2, 10, 0, 0, 500000), None, None, None]


def test_file_months(spark):
    names = ["2025-05.csv", "ER 05.2025.xlsx", "May'25", "ElasticRun May FY2025.xlsx", "December",
             "statement.csv", "Swift_2024_7", "mar-2024.tsv", "12-05-2025", "june 99 x", "2025 05"]
    df = spark.createDataFrame(list(enumerate(names)), "i int, x string")
    got = TM.add_month_of_name(df, "x", "k", "l").orderBy("i").collect()
    assert [r["k"] for r in got] == \
        ["2025-05", "2025-05", "2025-05", "2025-05", "0000-12", "zzzz-statement", "2024-07", "2024-03",
         "2025-05", "1999-06", "zzzz-2025 05"]


def test_outcomes(spark):
    assert one(spark, C.status_outcome, "RTO", "RTO-Delivered", "rto initiated", "Delivered ", "Lost", None) \
        == ["FWD Pendency", "RTO", "RTO", "Delivered", "Cancelled", "FWD Pendency"]


def test_ndd_accounts(spark):
    df = spark.createDataFrame([("test",), ("fastest",), ("swift_ndd",)], "a string")
    assert [r[0] for r in df.select(C.is_ndd("a")).collect()] == [True, False, True]


def test_reverse_label(spark):
    assert one(spark, C.reverse_label, "Bluedart MPS Reverse [B2B]", "RVP", "Ekart") == \
        ["Bluedart MPS [B2B]", "RVP", "Ekart"]


def test_slabs(spark):
    df = spark.createDataFrame([(w,) for w in (0.0, 0.5, 0.51, 10.0, 10.0000000001, 10.2, 12.0)], "w double")
    rows = df.select(I.weight_slab(F.col("w")).alias("s")).select("s", I.slab_index(F.col("s"))).collect()
    assert [r[0] for r in rows] == [0.0, 0.5, 1.0, 10.0, 10.0, 11.0, 12.0]
    assert [r[1] for r in rows[1:]] == [0, 1, 6, 6, 7, 8]


def test_single_group_has_no_score(spark):
    df = ships(spark, [{"awb": "1", "carrier": "A", "status": "Delivered", "attempts": "1",
                        "pickup_ts": "2024-06-01 00:00:00", "delivery_ts": "2024-06-02 00:00:00"}])
    row = K.by_carrier(df).first()
    assert row["score"] is None and row["p2d"] == 24.0


def test_equal_metrics_score_full(spark):
    rows = [{"awb": c, "carrier": c, "status": "Delivered", "attempts": "1",
             "pickup_ts": "2024-06-01 00:00:00", "ofd1_ts": "2024-06-01 12:00:00",
             "delivery_ts": "2024-06-02 00:00:00"} for c in "AB"]
    assert {r["score"] for r in K.by_carrier(ships(spark, rows)).collect()} == {100.0}


def test_thresholds(spark):
    rows = [{"awb": f"{p}{k}", "carrier": "A", "pickup_pin": p, "status": "Delivered", "attempts": "1",
             "pickup_ts": "2024-06-01 00:00:00", "delivery_ts": "2024-06-02 00:00:00"}
            for p, n in (("411001", 20), ("400001", 20), ("560001", 19)) for k in range(n)]
    got = {r["pickup_pin"]: r["score"] for r in K.by_warehouse(ships(spark, rows)).collect()}
    assert got["560001"] is None and got["411001"] is not None


def test_median_is_exact(spark):
    rows = [{"awb": str(h), "carrier": "A", "order_ts": "2024-06-01 00:00:00",
             "pickup_ts": f"2024-06-01 0{h}:00:00"} for h in (1, 2, 4, 9)]
    assert K.kpi_block(ships(spark, rows), ["carrier"]).first()["o2s"] == 3.0


def test_negative_gap_is_null(spark):
    row = ships(spark, [{"awb": "1", "carrier": "A", "pickup_ts": "2024-06-02 00:00:00",
                         "delivery_ts": "2024-06-01 00:00:00", "status": "Delivered"}]).first()
    assert row["p2d"] is None and row["transit_days"] is None


def test_presumed_lost(spark):
    rows = [{"awb": "old", "carrier": "A", "order_ts": "2024-05-31 10:00:00", "status": "InTransit"},
            {"awb": "new", "carrier": "A", "order_ts": "2024-06-01 00:00:00", "status": "InTransit"}]
    got = {r["awb"]: r["outcome"] for r in ships(spark, rows).collect()}
    assert got == {"old": "Cancelled", "new": "FWD Pendency"}


def test_revenue_counts_each_value_once(spark):
    rows = [{"awb": a, "carrier": "A", "order_id": o, "order_value": v, "status": "Delivered"}
            for a, o, v in (("1", "x", "10"), ("2", "x", "10"), ("3", "x", "7"), ("4", "", "5"), ("5", "", "5"))]
    assert R.revenue_totals(R.order_units(ships(spark, rows), "outcome", "delivered")).first()["revenue"] == 2700


def test_lookback_is_clamped():
    assert [clamp_lookback(v) for v in ("5", None, "x", 0, 9999)] == [5, 30, 30, 1, 366]
    assert Window.lookback(3, dt.date(2024, 1, 10)).start == dt.date(2024, 1, 7)


def test_cells_from_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.csv").write_text('Carrier Partner Name,AWB\n"Blue, Dart",1\n')
    (tmp_path / "a" / "two.csv").write_text("AWB,Other,Carrier Partner Name\n2,x,Swift\n")
    (tmp_path / "a" / "three.csv").write_text("AWB\n3\n")
    cells = read_cells(spark, str(tmp_path))
    got = select_fields(cells, {"carrier": ["Carrier Partner Name"], "awb": ["AWB"]}, ["carrier"])
    assert sorted((r["carrier"], r["awb"]) for r in got.collect()) == [("Blue, Dart", "1"), ("Swift", "2")]


def test_ambiguous_file_takes_first_layout_with_lines(spark):
    """A file fitting two layouts goes to the earlier one that yields lines."""
    from parcelsight.sources.invoices import parse_lines
    header = ["awb", "total", "sku name", "awb no", "total amount", "gst amount"]
    rows = [("/f/2025-05/x.csv", 0, header), ("/f/2025-05/x.csv", None, ["", "", "", "A1", "118", "18"])]
    cells = spark.createDataFrame(rows, "path string, row_no bigint, cells array<string>")
    got = parse_lines(cells).collect()
    assert [(r["layout"], r["awb"], r["amount"], r["amount_ex_gst"]) for r in got] == \
        [("urbanbolt", "A1", 118.0, 100.0)]


def test_null_kind_of_numbers(spark):
    assert spark.range(1).select(N.to_number(F.lit(5), T.IntegerType())).first()[0] == 5.0


def test_circle_of_odisha(spark):
    df = spark.createDataFrame([("770017",), ("751001",), ("290001",)], "pin string")
    got = join_prefix(df, F.col("pin"), "d").collect()
    assert {r["pin"]: r["d_city"] for r in got} == \
        {"770017": "Odisha", "751001": "Odisha", "290001": "PIN 290xx"}


MASTER = "sku_key string, category string, product string, vol_kg double"


def test_master_overlay_repeated_and_blank_skus(spark):
    rows = spark.createDataFrame([("", "A", "x", 1.0), ("", "B", "y", 2.0), ("S", "A", "x", 1.0),
                                  ("S", "A", "x", 1.0)], MASTER)
    got = L.master_overlay(rows, rows).collect()
    assert [tuple(r) for r in got] == [("S", "A", "x", 1.0)]


def test_master_merge_keeps_the_older_weight(spark):
    files = spark.createDataFrame([(1, "S", "A", "x", 1.5), (2, "S", "B", "y", None)],
                                  "seq int, " + MASTER)
    assert [tuple(r) for r in L.master_merge(files).collect()] == [("S", "B", "y", 1.5)]


def test_shared_config_without_mode_wins(spark):
    kind = "carrier string, gst_mode string, note string"
    local = spark.createDataFrame([("C", "incl", "local"), ("D", None, "local")], kind)
    shared = spark.createDataFrame([("C", None, "shared")], kind)
    got = {r["carrier"]: (r["gst_mode"], r["note"]) for r in config_overlay(local, shared).collect()}
    assert got == {"C": (None, "shared"), "D": (None, "local")}


def test_invoice_without_net_amount(spark):
    lines = spark.createDataFrame(
        [("C", "I1", "2024-05-03", "2024-05", 2, 118.0, None)],
        "carrier string, invoice_number string, invoice_date string, service_month_key string, "
        "shipments long, amount double, amount_ex_gst double")
    row = I.reconciliation(lines).collect()[0]
    assert (row["amount_ex_gst"], row["tds"], row["payable"]) == (0.0, 0.0, 118.0)
