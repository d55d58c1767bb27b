"""Time the headline queries and print one JSON line.

Each query runs once untimed (class loading, code generation) and is then timed to a no-op sink.
"""

from __future__ import annotations

import json
import os
import time

from clientpulse.catalog import all_queries
from clientpulse.session import build_session

HEADLINE = (
    "feats_trx",
    "feats_geo",
    "feats_dialog",
    "feats_purchase",
    "c1_master",
    "d13_transitions",
    "d16_gap_distribution",
    "k4_stratified_sample",
    "i7_anova",
    "i12_iv_table",
    "j10_robust_scale",
    "m2_threshold_metrics",
    "m7_pr_auc",
    "m14_metrics_table",
    "l3_expanding_folds",
    "n7_portfolio_messages",
    "n12_answers",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    known, times = all_queries(), {}
    for key in HEADLINE:
        for timed in (False, True):
            start = time.perf_counter()
            known[key].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if timed:
                times[key] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
