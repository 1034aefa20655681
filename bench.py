"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The `build_*` entries write the tables that later steps read (entries with pace
from lineitem, features, exported predictions); the queries scan them as they
would any landed parquet input.
"""

from __future__ import annotations

import json
import os
import time

from formbook.plans import catalog
from formbook.plans.tables import feature_table, scored_entries
from formbook.sources import league
from tests.sparktest import local_session

HEADLINE = (
    "flagship_form_vs_grid", "feat14_asof_features", "win6_past_mean_excluding_contest", "win8_past_ewm_excluding_contest",
    "win_long_prefix", "win_long_ewm", "join5_asof_backward", "agg3_race_pace", "agg6_best_runs", "dq1_leakage_audit",
    "prob5_plackett_luce", "prob8_fit_temperature", "prob15_select_weights", "eval4_comparison_table",
    "eval5_paired_bootstrap", "rec2_score_forecasts")


def timed(run) -> float:
    start = time.time()
    run()
    return round(time.time() - start, 3)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session()
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {"build_entries": timed(lambda: league.paced_entries(spark, sf).count())}
    took["build_features"] = timed(lambda: feature_table(spark, sf).count())
    took["build_predictions"] = timed(lambda: scored_entries(spark, sf).count())
    for name in HEADLINE:
        took[name] = timed(lambda: catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save())
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": os.path.basename(sf).removeprefix("sf")}))


if __name__ == "__main__":
    main()
