"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the local cores, BENCH_ONLY a comma list of queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tallyframe.plans import all_queries
from tallyframe.session import local_session

HEADLINE = [
    "auc_rank",
    "auc_hanley_mcneil",
    "auc_cluster_bootstrap",
    "split_half_selection",
    "permutation_null",
    "mapping_null",
    "best_item_mapping",
    "match_nearest",
    "rule_scores",
    "channel_statistics",
    "dice",
    "log_classify",
    "log_sessions",
    "spacing_regularity",
    "robust_z",
    "curve_residual_cubic",
    "paired_injection",
    "line_overlap",
    "dataset_diff",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_ONLY")
    every = all_queries()
    names = list(every) if only == "all" else only.split(",") if only else HEADLINE
    spark = local_session(cpus, cpus)
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        every[name][0](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": folder.rstrip("/").split("sf")[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
