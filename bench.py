"""Prints one JSON line with the seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]."""

from __future__ import annotations

import json
import os
import time

from quern.plans.queries import QUERIES
from quern.session import get_spark

HEADLINE = ("daily_counts", "dense_panel", "per_cutoff", "stage1_backtest", "rolling_levels", "special_factors", "damp_factors", "shape_level_forecast", "hand_forecast", "stage3_hand_backtest", "lag_features", "blend_forecast", "stage1_gbt_backtest")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["daily_counts"](spark, sf_dir).count()  # the JVM compiles and the files are cached
    seconds = {}
    for name in HEADLINE:
        begin = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - begin, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
