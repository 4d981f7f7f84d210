"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the
number of local cores (default 8), BENCH_QUERIES a comma list in place of all
headline queries.
"""

import contextlib
import importlib.util
import json
import os
import sys
import time
from pathlib import Path

HEADLINE = (
    "p1_found p2_found p3_found p4_found p5_found p6_found p7_found p8_packed p9_found p10_found "
    "interface_summary repository_rollup binding_records module_rules nearest_views latest_views innermost_priority needle_lines release_gaps "
    "adjacent_snapshots weekly_shares line_offsets renamed_files shared_commits signal_scores fact_counts traced_bindings pricing_summary nation_revenue"
).split()


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    here = Path(__file__).resolve().parent
    sys.path.insert(0, str(here))
    spec = importlib.util.spec_from_file_location("__spark_entry__", here / "__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    from pyspark.sql import SparkSession

    with contextlib.redirect_stdout(sys.stderr):
        spark = (
            SparkSession.builder.master(f"local[{cpus}]")
            .appName("bench")
            .config("spark.sql.shuffle.partitions", cpus)
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.driver.memory", "16g")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .getOrCreate()
        )
        spark.sparkContext.setLogLevel("ERROR")
        spark.read.parquet(f"{folder}/nation.parquet").count()  # start-up is not timed
        queries, took = entry.queries(), {}
        names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n in queries]
        for name in names:
            began = time.time()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
            spark.catalog.clearCache()
        spark.stop()
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(folder).name}))


if __name__ == "__main__":
    main()
