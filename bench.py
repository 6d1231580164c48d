"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "adjusted_bars", "asof_backward", "publication_lag", "rolling_statistics", "rolling_factor_model", "forward_drawdowns",
    "stress_scores", "supplier_stress_latches", "leverage_backtest", "supplier_leverage_backtest", "hold_machine_state", "layer_ablation", "parameter_grid",
    "bootstrap_sharpe_difference", "bootstrap_crash_lift", "break_point_scan", "drawdown_episode_list", "event_matching",
]


def main() -> None:
    """Cold: shared tables are dropped before each query. Warm: the same query again. ``queries`` holds the cold times."""
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    from tidemark.operators.signals import release
    from tidemark.plans import QUERIES
    from tidemark.session import local_session

    if missing := [n for n in HEADLINE if n not in QUERIES]:
        raise SystemExit(f"not registered: {', '.join(missing)}")
    spark = local_session(cores, int(cores))
    spark.range(1000).selectExpr("sum(id)").collect()
    rows = sum(spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("lineitem", "orders"))

    def timed(name: str) -> float:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    timed(HEADLINE[0])  # the session's first query compiles for all
    cold, warm = {}, {}
    for name in HEADLINE:
        release()
        cold[name], warm[name] = timed(name), timed(name)
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    short = lambda d: {k: round(v, 3) for k, v in d.items()}
    print(json.dumps({
        "metric": "headline_queries_total_cold", "value": round(sum(cold.values()), 3), "unit": "sec", "queries": short(cold), "warm": short(warm), "sf": float(sf),
        "warm_total": round(sum(warm.values()), 3), "input_rows": rows, "input_rows_per_sec_cold": {k: round(rows / v) for k, v in cold.items()},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
