"""Headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.plans import load_all  # noqa: E402
from tidemark.session import local_session  # noqa: E402

HEADLINE = ["momentum_12_1_price", "rsi", "macd", "ma_ema_cross", "yang_zhang", "drawdown_structure", "asof_latest_filed", "nearest_within_tolerance", "ttm_rolling4", "quality_scorecard", "cs_robust_normalise", "risk_summary_stats",
            "ownership_concentration", "triple_barrier", "uniqueness_weights", "backtest_nav", "portfolio_var_cvar", "score_signal", "rank_by_horizon", "event_classify"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, os.environ.get("BENCH_MEMORY", "12g"))
    reg = load_all()
    times: dict[str, float] = {}
    t0 = time.time()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey").count().write.format("noop").mode("overwrite").save()
    warm = time.time() - t0
    for name in HEADLINE:
        spark.catalog.clearCache()
        t = time.time()
        reg[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "warmup_sec": round(warm, 3)}))


if __name__ == "__main__":
    main()
