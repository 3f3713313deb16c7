"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the input folder, BENCH_CPUS the local cores.  Analyses read
the study panel from a table, which is timed on its own as ``panel_table``.
``bootstrap_cif_50`` is ``bootstrap_cif`` with 50 replicates in place of 4.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "eligible_cohort", "thin_events_1y", "panel_full", "panel_table", "cum_adherence", "cif_crude", "cif_weighted",
    "cif_robust_ci", "weight_summary", "crosstab_chisq", "ip_weights", "exposure_weighted_cif", "bootstrap_summary",
    "bootstrap_cif", "bootstrap_cif_50",
)


def session() -> SparkSession:
    scratch = tempfile.mkdtemp(prefix="riskline-bench-")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("riskline-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", CPUS)
        # The inputs are small but costly per byte: keep one task per core.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "32KB")
        .config("spark.checkpoint.dir", scratch)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    spark = session()
    from riskline.catalog.queries import EVERY, REGISTRY, panel_table
    from riskline.plans import study
    from riskline.sources import derived

    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        if name == "panel_table":
            panel_table(spark, SF_DIR)
        elif name == "bootstrap_cif_50":
            result = study.weighted_analysis(panel_table(spark, SF_DIR), EVERY, reps=50, periods=derived.PERIODS)
            result.write.format("noop").mode("overwrite").save()
        else:
            REGISTRY[name].run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
