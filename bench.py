"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` (default the sf0.1 tables) and ``BENCH_CPUS`` choose data and
cores. Each query is run to the end (its whole result is produced) after one
warm-up query; the value is the sum over all queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from clienttrace import build_session  # noqa: E402
from clienttrace.plans import catalog  # noqa: E402

HEADLINE = ("client_profile", "churn_profile", "rich_profile", "history_text", "client_features", "top_categories",
            "half_trend", "event_sequences", "category_encoding", "stratified_split", "kfold", "max_abs_scale",
            "knn_join", "knn_vote_binary", "roc_auc", "accuracy_f1", "infonce", "parse_json", "messages", "budget",
            "score_prompts", "logreg_eval", "knn_join_pruned", "running_auc")

# Of these, what reads the order lines.
SHIPMENTS = ("churn_profile", "event_sequences", "category_encoding", "client_profile", "client_features", "half_trend")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session("bench", f"local[{cpus}]", spark_sql_shuffle_partitions=cpus, spark_ui_enabled="false",
                          spark_driver_memory="12g", spark_ui_showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    known = catalog.queries()

    def run(name: str) -> float:
        start = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("activity_span")
    times = {name: run(name) for name in HEADLINE}
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    spark.stop()
    print(json.dumps({"metric": "headline_queries_wall_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                      "cpus": int(cpus), "lineitem_rows": lineitem,
                      "lineitem_rows_per_sec": {n: round(lineitem / s) for n, s in times.items() if n in SHIPMENTS}}))


if __name__ == "__main__":
    main()
