"""Time the headline queries and print one JSON line.

$BENCH_SF_DIR names the folder of parquet tables, $BENCH_CPUS the cores. Each query runs once to warm up and
then three times into Spark's no-op sink; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from millrace.plans import registered  # noqa: E402
from millrace.session import local_session  # noqa: E402

HEADLINE = [
    "sales_orders",
    "daily_sales_summary",
    "warehouse_stock",
    "support_tickets",
    "monthly_pnl",
    "upsert_order_items",
    "upsert_order_items_stored",
    "parse_responses",
    "distributor_prices",
    "page_text",
    "site_search",
]
RUNS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("millrace-bench", cores=cores, shuffle_partitions=int(cores))
    times = {}
    for name in HEADLINE:
        taken = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            registered.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
    spark.stop()
    line = {"metric": "sum of median seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times}
    print(json.dumps({**line, "sf": os.path.basename(folder).removeprefix("sf"), "cores": int(cores)}))


if __name__ == "__main__":
    main()
