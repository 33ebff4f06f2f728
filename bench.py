"""Times the headline queries and prints one line of JSON. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "biggest_movers", "chart_history", "overlap_pct", "history_delta", "coverage_all_periods", "entry_scores", "work_chart_positions",
    "position_xref", "normalize_title", "ratio", "search_fuzzy", "rgs_for_recordings", "resolve", "multi_source_boost", "detect_drift",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from chartloom.plans import registry
    from chartloom.sources.shared import release

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-")).config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()
    took = {}
    for name in HEADLINE:
        began = time.time()
        registry.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir).removeprefix("sf")}))
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()
