"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
data and the cores. Every query runs in full into a sink that keeps nothing.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from ledgerlens.plans.catalog import QUERIES  # noqa: E402
from ledgerlens.session import local_session  # noqa: E402

HEADLINE = [
    "velocity_card",
    "card_stats_zscore",
    "extra_card_aggregates",
    "target_encode_smoothed",
    "uid_rate",
    "star_join",
    "profile_columns",
    "iqr_outliers",
    "statement_aggregates",
    "last_n_stats",
    "subscription_aggregate",
    "tick_aggregate",
    "har_lags",
    "market_cross_section",
    "auc",
    "threshold_sweep",
    "capture_rate",
    "ranking_metrics",
    "audit_group_auc",
    "text_lexical",
    "top_bigrams",
    "tfidf",
    "negatives",
    "pair_features",
    "split_stratified",
    "credit_features",
]


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    run(spark, "rate_by_weekday", folder)  # starts the JVM's code generation
    seconds = {name: round(run(spark, name, folder), 3) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
                "cores": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
