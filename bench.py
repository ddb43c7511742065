"""Headline queries on one data folder; prints one JSON line.

Each query runs once to warm up and then BENCH_RUNS times; the median is reported. Results are
written to the no-op sink, so every row and column is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from parcelsight.catalog import load
from parcelsight.catalog.registry import run
from parcelsight.session import local_session

HEADLINE = [
    "agg_carrier", "agg_warehouse_account", "agg_lane", "agg_payment_perf", "agg_daily",
    "agg_product_tree", "sla_classify", "agg_tat_matrix", "agg_orders_per_day", "join_o2s",
    "join_idset_pushdown", "inv_spend_carrier", "inv_reconciliation", "inv_product",
    "inv_weight_dispute", "inv_lane_comparison",
]
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def timed(name: str, spark, folder: str) -> float:
    start = time.perf_counter()
    run(name, spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    load()
    seconds = {}
    for name in HEADLINE:
        timed(name, spark, folder)
        seconds[name] = round(statistics.median(timed(name, spark, folder) for _ in range(RUNS)), 3)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).replace("sf", "")}))


if __name__ == "__main__":
    main()
