"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (data folder), BENCH_CPUS (local cores).
"""

from __future__ import annotations

import json
import os
import sys
import time

from residua.plans.catalog import CATALOG
from residua.session import get_session

HEADLINE = [
    "numeric_stats", "correlation_pairs", "null_unique_counts", "ridge_oof", "fold_scores", "residual_scan", "quantile_scan",
    "planted_scan", "variance_regimes", "interaction_strength", "ljung_box", "rolling_drift", "levene_test", "fold_auc",
    "bootstrap_presence", "permutation_test", "double_ml", "apply_rules", "single_rule_gain", "column_snapshot",
    "text_verdicts", "failure_ratio", "p95_window", "sustained_condition",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = get_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings: dict[str, float] = {}
    warm = spark.read.parquet(f"{folder}/orders.parquet")
    warm.groupBy("o_orderstatus").count().collect()
    for name in only or HEADLINE:
        start = time.perf_counter()
        CATALOG[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
                "queries": timings, "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
