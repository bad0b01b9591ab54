"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINES = (
    "weighted_mean", "weighted_mean_all", "weighted_distribution", "weighted_proportion", "weighted_quantile", "kish_mean", "paired_change", "transition_joint", "weighted_pearson", "weighted_spearman",
    "weighted_correlations", "adjusted_gaussian", "all_pairs_by_country", "cross_tab", "unpivot_long", "pivot_wide", "coverage", "averaged_cross_tab",
)


def main() -> None:
    cpus, sf = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from quorumstat.plans.catalog import QUERIES

    seconds = {}
    QUERIES["weighted_mean"](spark, sf).collect()  # starts the engine
    for name in HEADLINES:
        best = None
        for _ in range(2):
            began = time.time()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.time() - began)
        seconds[name] = round(best, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
