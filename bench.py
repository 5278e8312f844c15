"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = (
    "scenario_composite", "metric_scores", "public_mapping", "clauses", "check_scores",
    "policy_schema_score", "verdicts", "regulation_summary", "assess_policies", "nb_predictions",
    "classifier_metrics", "calibration_summary", "threshold_sweep", "posterior_risk",
    "policy_split", "policy_flat", "practice_sentences", "articles", "chunks", "dense_topk",
    "sparse_topk", "group_dedup", "alignment", "stream_tallies",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "20g")
        .config("spark.ui.enabled", "false")
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from clausewise.plans import catalog

    registered = catalog.queries()
    wanted = sys.argv[1:] or HEADLINE
    # One untimed pass over a tiny input starts the JVM's and the workers' machinery.
    registered["check_scores"](spark, os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
                               ).write.format("noop").mode("overwrite").save()
    times = {}
    for name in wanted:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
