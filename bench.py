"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

QUERIES = [
    "assign_round_asof", "running_totals_asof", "gap_sessions", "engagement_windows", "simultaneity_windows", "grid_and_boundary_samples", "state_features_pit", "active_utility",
    "kill_actions", "rotations", "partition_telescoping", "shapley_exact", "martingale_drift", "metric_breakdowns", "knn_panel", "shrinkage", "qa_profile", "inventory_cube", "redact_pages",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8)))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("tickledger-bench").config("spark.sql.shuffle.partitions", str(cpus)).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tickledger.plans.all import QUERIES as ALL

    # the first job of a session pays for its start, not the queries
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times: dict[str, float] = {}
    for name in QUERIES:
        t0 = time.perf_counter()
        ALL[name](spark, sf_dir).write.mode("overwrite").format("noop").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    sf = sf_dir.rstrip("/").split("sf")[-1]
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
