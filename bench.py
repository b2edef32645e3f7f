"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line.  Each query runs whole into a sink; the best of three counts."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

#: The reference's benchmark shapes (scan, filter, range, sort, top-k, group, joins, window, subquery, CTE) by registered query.
HEADLINE = [
    "scan_table", "scan_point", "scan_range", "count_all", "comparisons", "like_any_case", "order_by", "top_k", "distinct", "group_by", "group_by_expression", "having", "count_distinct",
    "join_group_having", "join_residual", "join_four", "exists", "not_in_subquery", "scalar_correlated", "lateral_top", "window_ranking", "window_aggregates", "window_lag_lead", "cte", "cte_recursive",
    "fn_string", "fn_date_arithmetic", "json_group", "engine_insert_select", "engine_update", "engine_on_conflict_update", "engine_merge",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    from tarnwick.operators.registry import QUERIES
    from tarnwick.session import build_spark

    spark = build_spark(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(3):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        times[name] = round(best, 4)
    print(json.dumps({"metric": "total of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
