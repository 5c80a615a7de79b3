"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder (default sf0.1), BENCH_CPUS the cores of the local
master. Every query runs to a sink that keeps nothing, so all rows are computed; one
untimed query starts the JVM and the Python workers first.
"""

from __future__ import annotations

import json
import logging
import os
import time

from brightshelf.queries import QUERIES
from brightshelf.session import local_session

HEADLINE = [
    "a1_user_features",
    "a2_product_features",
    "a5_decayed_popularity",
    "w1_top_k_per_user",
    "j11_point_in_time_features",
    "j6_users_by_all_items",
    "w2_similar_items",
    "w2_similar_purchased_items",
    "c1_collaborative",
    "c3_content_based",
    "c15_two_stage_recommendations",
    "e3_all_generators",
    "e6_binary_metrics",
    "x5_experiment_results",
    "d1_feature_drift",
    "d6_latency_quantiles",
    "t3_stratified_split",
    "t5_negatives_without_replacement",
    "q3_outliers",
    "st1_stream_to_lake",
]


def main() -> None:
    logging.disable(logging.CRITICAL)
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, shuffle_partitions=cores)
    seconds: dict[str, float] = {}

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("w2_similar_items")
    for name in HEADLINE:
        seconds[name] = round(run(name), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cores": cores,
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
