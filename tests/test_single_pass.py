"""The single pass holds every grouping of the report with all its measures."""

from types import SimpleNamespace

from parcelsight.catalog import load
from parcelsight.operators import kpi as K

COLUMNS = ("carrier string, account string, pickup_pin string, warehouse string, city string, drop_city string, "
           "lane string, o2s_us long, p2o_us long, p2d_us long, picked boolean, delivered boolean, "
           "attempts double, outcome string, pendency_state string, tat_status string, tat_margin double")
ROWS = [
    ("A", "acc", "1", "W", "C", "D", "C → D", 3600000000, 7200000000, 9000000000, True, True, 1.0, "Delivered",
     "Other", "In TAT", 1.5),
    ("A", "acc", "1", "W", "C", "E", "C → E", 1800000000, None, None, True, False, 2.0, "FWD Pendency", "Lost",
     "Out of TAT", -2.0),
    ("B", "", "1", "W", "C", "D", "C → D", None, None, None, False, False, None, "FWD Pendency", "Other",
     "Pending", None),
    ("B", None, "", "", "", "", "", None, None, None, False, False, None, "RTO", "Other", "No rule", None)]


def test_all_groupings(spark):
    rows = spark.createDataFrame(ROWS, COLUMNS)
    out = load()["agg_single_pass"][0](SimpleNamespace(classified=rows)).cache()
    want = {
        "carrier": (K.by_carrier(rows), ["carrier"]), "warehouse": (K.by_warehouse(rows), ["pickup_pin"]),
        "destination": (K.by_destination(rows), ["drop_city"]), "lane": (K.by_lane(rows), ["lane"]),
        "warehouse_account": (K.by_warehouse_account(rows), ["pickup_pin", "account"]),
        "status": (K.status_matrix(rows), ["account"]),
        "pendency": (K.pendency_matrix(rows), ["account", "pendency_state"]), "tat": (K.tat_summary(rows), [])}
    for dimension, (df, keys) in want.items():
        measures = [c for c in df.columns if c not in keys]
        got = out.where(out.dimension == dimension).select(*["grp", "part"][:len(keys)], *measures)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(
            map(str, map(tuple, df.select(*keys, *measures).collect())))
    sla = out.where("dimension = 'sla'").select("grp", "n").collect()
    assert sorted(map(tuple, sla)) == [("In TAT", 1), ("No rule", 1), ("Out of TAT", 1), ("Pending", 1)]
    assert out.where("dimension = 'pendency'").count() == 1
    out.unpersist()
