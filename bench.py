"""Time the headline queries and print one JSON line.

BENCH_SF_DIR picks the data (default /root/testdata/sf0.1), BENCH_CPUS the local cores (default 8),
BENCH_QUERIES a comma-separated choice of query names.
"""

from __future__ import annotations

import json
import os
import time

from basketry.plans import queries
from basketry.session import get_session

HEADLINE = [
    "b01_last_90_days",  # scan and filter
    "d02_daily_sales",
    "d05_calendar_patterns",
    "d06_business_figures",
    "d08_value_segments",
    "d11_rfm",
    "d15_customer_features",
    "d17_schema_analysis",
    "d24_iqr_outliers",
    "d28_outlier_summary",
    "b28_clean_transactions",
    "e06_rfm_scores",
    "k05_correlation_pearson",
    "h06_tfidf",
    "i04_kmeans",
    "i07_silhouette",
    "i17_profile_hybrid",
    "j05_sequences",
    "j11_ranking_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = queries()
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    # Start the JVM's compilers and the Python workers before the clock.
    known["d11_rfm"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.range(8).selectExpr("id").mapInPandas(lambda it: it, "id bigint").count()
    times = {}
    for name in names:
        start = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
