"""Times of the headline queries; prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from orrery.plans import registry

HEADLINE = ["q_bbox_xvp", "q_shell_tile8", "q_bbox_halo", "q_nearest_step", "q_ngp_grid", "q_cic_grid", "q_density_stats", "q_pk_ngp", "q_pk_cic", "q_pk_window", "q_pk_fine", "q_pk_analysis", "q_halo_mass", "q_submittable", "q_report_rows", "q_stream_grid_equals_batch"]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "4")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("orrery-bench")
        .config("spark.sql.shuffle.partitions", str(max(4, int(cpus) if cpus.isdigit() else 8)))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "4g"))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    queries = dict(registry.QUERIES)
    queries[names[0]](spark, folder).write.format("noop").mode("overwrite").save()  # the session's own start isn't a query's
    times = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rsplit("sf", 1)[-1], "cpus": cpus}))


if __name__ == "__main__":
    main()
