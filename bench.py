"""Wall times of the headline queries as one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the number of cores.  Every query runs to
its end with all columns computed (noop sink); the best of two runs counts, after warm-up.
"""

from __future__ import annotations

import json
import os
import sys
import time

from cdcgold.plans.catalog import QUERIES
from cdcgold.session import session

HEADLINE = (
    "fold_live_children",
    "profile_documents",
    "profile_one_shuffle",
    "assemble_from_flat",
    "baseline_profile",
    "order_documents",
    "flat_join",
    "rows_scanned_per_root",
    "edge_join_both",
    "edge_documents_both",
    "summary_view",
    "bulk_lookup",
    "replace_upsert",
    "point_updates",
    "change_feed",
    "decode_records",
    "standard_envelope",
    "reconcile",
    "verify_changes",
    "constraints",
    "latency_report",
    "sync_lag_report",
    "stream_fold",
    "stream_fold_state",
)
ONCE = {"stream_fold", "stream_fold_state"}


def seconds(spark, name: str, directory: str) -> float:
    start = time.perf_counter()
    QUERIES[name].build(spark, directory).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    only = sys.argv[1:]
    spark = session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds(spark, "profile_documents", directory)
    times = {}
    for name in only or HEADLINE:
        runs = 1 if name in ONCE else 2
        times[name] = round(min(seconds(spark, name, directory) for _ in range(runs)), 3)
    line = {
        "metric": "headline queries, total wall time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(directory.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
