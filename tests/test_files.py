"""Files of many dialects in one folder, files that give no rows, listing by month, profiles."""

import pytest
from pyspark.sql import functions as F

from parcelsight.sources import cells as CE
from parcelsight.sources import invoices as SI

FIELDS = {"carrier": ["Carrier Partner Name"], "awb": ["AWB"]}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("an export + b")
    wide = ";".join(["Carrier Partner Name", "AWB", *[f"x{k}" for k in range(198)]])
    (root / "wide.csv").write_text(wide + "\n" + ";".join(["Blue", "w1", *["1,5"] * 197, "last"]) + "\n")
    (root / "tabs.tsv").write_text('Carrier Partner Name\t"Zone\nof drop, A;B"\tAWB\nSwift\t"a\n""b"", c;d"\tt1\n')
    (root / "commas [1].csv").write_text('Carrier Partner Name,AWB\n"Blue, Dart; x",c1\n')
    (root / "bars.CSV").write_text("AWB|Carrier Partner Name\nb1|Ekart\n")
    (root / "latin.csv").write_bytes("Carrier Partner Name,AWB,Stadt\nSwift,l1,München\n".encode("latin-1"))
    (root / "mark.csv").write_bytes("﻿Carrier Partner Name,AWB\nSwift,m1\n".encode())
    (root / "single.csv").write_text("Carrier Partner Name\nAlone\n")
    (root / "page.csv").write_text("\n  <html><table></table></html>\n")
    (root / "blank.csv").write_text("\n \n")
    (root / "lacking.csv").write_text("AWB,Status\n1,x\n")
    (root / "notes.txt").write_text("Carrier Partner Name,AWB\nno,1\n")
    return str(root)


def name(c):
    return F.regexp_extract(c, "([^/]*)$", 1)


def test_dialects(spark, folder):
    got = {r.n: (r.sep, r.encoding, r.multiline, r.width, r.markup) for r in
           CE.file_dialects(spark, folder).withColumn("n", name(F.col("file"))).collect()}
    assert got == {
        "wide.csv": (";", "UTF-8", False, 200, False), "tabs.tsv": ("\t", "UTF-8", True, 3, False),
        "commas [1].csv": (",", "UTF-8", False, 2, False), "bars.CSV": ("|", "UTF-8", False, 2, False),
        "latin.csv": (",", "ISO-8859-1", False, 3, False), "mark.csv": (",", "UTF-8", False, 2, False),
        "single.csv": (",", "UTF-8", False, 1, False), "page.csv": (",", "UTF-8", False, 1, True),
        "lacking.csv": (",", "UTF-8", False, 2, False)}


def test_every_cell_is_read(spark, folder):
    rows = CE.read_cells(spark, folder).withColumn("n", CE.file_of(F.col("path"))).collect()
    cells = {(r.n, r.row_no): [c for c in r.cells if c is not None] for r in rows}
    assert cells["wide.csv", 1][-1] == "last" and len(cells["wide.csv", 1]) == 200
    assert cells["tabs.tsv", 0] == ["Carrier Partner Name", "Zone\nof drop, A;B", "AWB"]
    assert cells["tabs.tsv", 1] == ["Swift", 'a\n"b", c;d', "t1"]
    assert cells["commas [1].csv", 1] == ["Blue, Dart; x", "c1"]
    assert cells["latin.csv", 1] == ["Swift", "l1", "München"]
    assert not any(n == "page.csv" for n, _ in cells)


def test_fields_of_all_dialects(spark, folder):
    got = CE.select_fields(CE.read_cells(spark, folder), FIELDS, ["carrier"])
    assert sorted((r.carrier, r.awb) for r in got.collect()) == sorted(
        [("Blue", "w1"), ("Swift", "t1"), ("Blue, Dart; x", "c1"), ("Ekart", "b1"), ("Swift", "l1"),
         ("Swift", "m1"), ("Alone", None)], key=str)


def test_only_the_fields_asked_for_are_read(spark, folder):
    got = CE.read_fields(spark, folder, FIELDS, ["carrier"])
    want = CE.select_fields(CE.read_cells(spark, folder), FIELDS, ["carrier"])
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "FileScan csv" in plan and "c150" not in plan and "SortMergeJoin" not in plan


def test_no_fields(spark, tmp_path):
    assert CE.read_fields(spark, str(tmp_path), FIELDS, ["carrier"]).columns == ["path", *FIELDS]


def test_problems_name_every_file_without_rows(spark, folder):
    got = CE.file_problems(spark, folder, FIELDS, ["carrier"])
    assert {(r.n, r.problem) for r in got.select(name(F.col("file")).alias("n"), "problem").collect()} == {
        ("blank.csv", "no rows"), ("page.csv", "looks like HTML or XML"),
        ("lacking.csv", "missing required column(s): carrier")}


def test_no_files(spark, tmp_path):
    assert CE.read_cells(spark, str(tmp_path)).count() == 0


def test_a_month_is_found_by_listing(spark, tmp_path):
    for month in ("2025-04", "2025-05", "notes"):
        (tmp_path / month).mkdir()
        (tmp_path / month / "bill.csv").write_text("Waybill Number,Grand Total,Bill Number\nA1,118,B\n")
    (tmp_path / "notes" / "May 2025.csv").write_text("Waybill Number,Grand Total,Bill Number\nA2,118,B\n")
    files = SI.of_month(spark, str(tmp_path), "2025-05")
    assert sorted(f.rsplit("/", 2)[1:] for f in files) == [["2025-05", "bill.csv"], ["notes", "May 2025.csv"]]
    cells = CE.read_cells(spark, files)
    assert {f.rsplit("/", 2)[1] for f in cells.inputFiles()} == {"2025-05", "notes"}
    assert sorted(r.awb for r in SI.parse_lines(cells).collect()) == ["A1", "A2"]


def test_rows_of_files_are_not_shuffled(spark):
    cells = spark.createDataFrame(
        [("/f/ekart.csv", 0, ["Order ID", "Invoice Amt"]), ("/f/ekart.csv", None, ["O1", "118"])],
        "path string, row_no bigint, cells array<string>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = SI.parse_lines(cells)
        assert "SortMergeJoin" not in lines._jdf.queryExecution().sparkPlan().toString()
        assert [r.order_id for r in lines.collect()] == ["O1"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_profile_reaches_the_end_of_a_file(spark):
    rows = [("/f/x.csv", k, [str(k), "late" if k in (900, 950) else ""]) for k in range(1, 1000)]
    cells = spark.createDataFrame([("/f/x.csv", 0, ["AWB", "Remark"]), *rows],
                                  "path string, row_no bigint, cells array<string>").repartition(5)
    got = {r.name: (r.filled, r.samples) for r in CE.column_profile(cells, {"awb": ["awb"]}).collect()}
    assert got == {"AWB": (999, "1 | 2 | 3"), "Remark": (2, "late | late")}


CONFIGS = "carrier string, fields map<string,string>, gst_mode string, gst_rate double, sheet string"


def test_registered_mappings_are_data(spark):
    """Many mappings, none of which passes through the driver; the first by name that fits wins."""
    maps = [(f"carrier {k:04d}", {"amount": f"Fee {k}", "awb": "Docket"}, "included", 18.0, None)
            for k in range(1500)]
    maps += [("Acme", {"amount": " Charge (₹) ", "awb": "DOCKET", "zone": "Lane"}, "add_18", 12.0, ""),
             ("Beta", {"amount": "charge", "awb": "docket"}, None, None, None),
             ("Aaa", {"amount": "charge", "awb": "docket"}, None, None, "Sheet 9"),
             ("Nil", None, None, None, None), ("Half", {"amount": "charge"}, None, None, None)]
    configs = spark.createDataFrame(maps, CONFIGS)
    rows = [("/f/x.csv", 0, ["Statement", None, None]), ("/f/x.csv", 1, ["Lane", "Charge", "Docket"]),
            ("/f/x.csv", None, ["north", "100", "A1"]), ("/f/x.csv", None, [None, None, "Total"]),
            ("/f/sheet 9 y.csv", 0, ["Docket", "Charge", None]), ("/f/sheet 9 y.csv", None, ["B1", "118", None]),
            ("/f/z.csv", 0, ["Fee 1499", "Docket", None]), ("/f/z.csv", None, ["59", "C1", None])]
    cells = spark.createDataFrame(rows, "path string, row_no bigint, cells array<string>")
    got = {(r.layout, r.carrier, r.awb, r.zone, r.amount, r.amount_ex_gst)
           for r in SI.parse_lines(cells, configs).collect()}
    assert got == {("configured:Acme", "Acme", "A1", "North", 112.0, 100.0),
                   ("configured:Aaa", "Aaa", "B1", "", 118.0, 100.0),
                   ("configured:carrier 1499", "carrier 1499", "C1", "", 59.0, 50.0)}
    errors = {r.carrier: r.error for r in SI.config_errors(configs, cells).collect()}
    assert errors["Acme"] is None and errors["Beta"] is None and errors["Aaa"] is None
    assert errors["Nil"] == "no amount column" and errors["Half"] == "no AWB or order id column"
    assert errors["carrier 0007"] == "no lines on the sample" and errors["carrier 1499"] is None
    assert {r.error for r in SI.config_errors(configs).where("carrier LIKE 'carrier %'").collect()} == {None}
