"""Times the headline queries: one JSON line. BENCH_SF_DIR, BENCH_CPUS and BENCH_REPEATS set the run."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from tessera.plans.queries import QUERIES

HEADLINE = (
    "valuation_tiers", "comparable_match", "target_alerts", "type_suggest_topk",
    "price_basis", "market_stats_by_type", "dominant_basis", "evidence_quality", "dedupe_sales", "source_conflicts", "iqr_outliers", "fx_normalise", "liquidity", "trend",
    "fee_rule_asof", "buyer_cost", "collection_facets", "collection_value_by_currency", "knowledge_consensus", "trust_levels", "fingerprint_topk", "master_fingerprint",
    "upsert_latest", "cascade_delete", "html_extract", "running_cap", "history_topn", "latency_p50_p90", "text_fold",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(repeats):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(statistics.median(runs[1:] or runs), 3)  # the first run warms up
    spark.stop()
    print(json.dumps({"metric": "seconds of all headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
