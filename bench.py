"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from retailcast.queries import QUERIES
from retailcast.session import SETTINGS

HEADLINE = (
    "w_lag_and_rolling",
    "w2_rolling_features",
    "j4_merge_sources",
    "j11_densify",
    "f9_all_features",
    "f8_oil_by_row",
    "v1_validate_table",
    "n1_iqr_global",
    "n5_interpolate_by_series",
    "n5_interpolate_global",
    "n2_isolation_forest",
    "y1_spectrum",
    "y5_analyze",
    "y6_decompose",
    "b3_baselines",
    "b5_metrics",
    "b7_diebold_mariano",
    "b2_run_backtest",
    "b4_additive_backtest",
    "m1_m3_fit_additive",
    "m7_m8_boosted_predictions",
    "m10_m11_sequence_forecast",
    "m14_optimal_weights",
    "t1_naive_band",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench")
    settings = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": cpus,
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    names = tuple(sys.argv[1:]) or HEADLINE
    # start the JVM and the Python workers outside the timing
    for name in ("w_lag_and_rolling", "y1_spectrum"):
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
