"""What is written and moved: joined rows once per run, shipments only where a line may need them."""

import gzip
import os

from pyspark.sql import functions as F

from parcelsight.catalog import ingest_queries, load
from parcelsight.catalog.registry import Inputs, run
from parcelsight.operators import lookups as L
from parcelsight.operators.shipments import shipment_facts
from parcelsight.session import shared_folder
from parcelsight.sources import cells as CE

NOW = "2024-06-30 00:00:00"


def rows(df):
    return sorted(map(str, df.collect()))


def test_only_billed_shipments_are_matched(spark):
    ships = spark.range(3000).select(
        F.lit("x").alias("carrier"), F.concat(F.lit("a"), "id").alias("awb"),
        F.concat(F.lit("#o"), F.col("id") / 2).alias("order_id"), F.concat(F.lit("S"), "id").alias("sku"),
        F.lit("Knee Brace").alias("item_names"), F.lit("2024-01-01 00:00:00").alias("order_ts"))
    ships = ships.unionByName(ships.where("id % 7 = 0")).unionByName(ships.where("id = 3").withColumns(
        {"awb": F.lit(None).cast("string"), "order_id": F.lit(None).cast("string")}))
    lines = spark.createDataFrame(
        [(" A7 ", "", 1.0), ("", "#O5.0_R1", 2.0), ("zz", "9.5", 3.0), (None, None, 4.0), ("A14.0", "O1.0", 5.0)],
        "awb string, order_id string, amount double").withColumn("sku", F.lit(""))
    billed = L.likely_billed(ships, lines)
    assert all(0 < b.count() < 20 for b in billed) and billed[0].columns == ships.columns
    facts = shipment_facts(ships, NOW)
    few = tuple(shipment_facts(b, NOW) for b in billed)
    assert rows(L.match_shipments(lines, few)) == rows(L.match_shipments(lines, facts))


def test_joined_rows_are_written_once_per_run(spark, folder):
    """No reading of shipments repeats the joins, and no run reads what another one wrote."""
    load()
    written = []
    for name in ("inv_multi_sku", "inv_dispute_product", "inv_weight_dispute", "inv_cost_summary"):
        files = run(name, spark, folder).inputFiles()
        assert not any("lineitem" in f or "/orders." in f for f in files)
        written.append({f.rsplit("/", 1)[0] for f in files if "/shipments-" in f})
    assert all(len(w) == 1 for w in written) and len(set.union(*written)) == len(written)


def test_exports_are_packed(spark, folder):
    top = ingest_queries.shipment_files(Inputs(spark, folder)).removeprefix("file://")
    names = [n for _, _, found in os.walk(top) for n in found if n.startswith("part-")]
    assert sum(n.endswith(".csv.gz") for n in names) == len(names) - 1  # but for the page


def test_packed_files_are_read(spark):
    """Separators, encodings and line breaks in cells are found in packed files as in plain ones."""
    texts = {"a.csv": "awb;carrier\nA1;Blue\nA2;Blü\n".encode("latin-1"), "b.tsv": b"awb\nB1\nB2\n",
             "c.csv": b'awb,"the\ncarrier"\n"C\n1","x"\n'}
    found = []
    for packed in (False, True):
        top = shared_folder(spark, "packed").removeprefix("file://")
        os.makedirs(top)
        for name, text in texts.items():
            with open(f"{top}/{name}{'.gz' * packed}", "wb") as f:
                f.write(gzip.compress(text) if packed else text)
        dialects = CE.file_dialects(spark, top).select(
            F.regexp_replace(CE.file_of(F.col("file")), r"\.gz$", "").alias("file"), "sep", "encoding", "multiline", "width")
        cells = CE.read_cells(spark, top).select(
            F.regexp_replace(CE.file_of(F.col("path")), r"\.gz$", "").alias("file"), "row_no", "cells")
        listed = CE.list_files(spark, top).count()
        found.append((rows(dialects), rows(cells), listed))
    assert found[0] == found[1] and found[1][2] == 3
