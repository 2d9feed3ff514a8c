"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from flowspark.plans import catalog
from flowspark.session import clear, session

#: Their sum is the metric; the others are timed beside them.
HEADLINE = ["volume_bars", "vpin", "rolling_percent_rank", "robust_z", "shock_trigger", "label_variable_horizon", "asof_book", "cross_instrument", "grid_bars", "spearman_by_fold"]
OTHERS = ["domain_score", "grid_rows", "exit_features", "growing_threshold", "sql_bars", "stream_labels"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", spark_master=f"local[{cpus}]", spark_sql_shuffle_partitions=cpus, spark_ui_enabled="false", spark_driver_memory="8g", spark_ui_showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["tick_view"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up is not counted
    took = {}
    for name in HEADLINE + OTHERS:
        began = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        clear(spark)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took[n] for n in HEADLINE), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
