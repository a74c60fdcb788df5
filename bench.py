"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "qa_pairs", "noise_reasons", "shell_unwrap", "redaction", "raw_dedupe_insert", "cross_source_dedupe", "session_tiers",
    "gap_blocks", "task_state", "term_frequency", "qa_lexical_scores", "card_search", "vector_top_k", "topic_radar",
    "near_duplicate_components", "topic_assignment", "rank_fusion", "selection_trace", "context_packing", "token_spans",
    "overlapping_windows", "budget_batches", "health_diagnosis", "distinct_facts", "related_topics", "version_chains",
    "as_of_recorded", "range_containment", "invalidation_ledger", "category_metrics", "topic_keyword_scores",
    "contaminated_pairs", "mutual_knn_components", "density_clusters", "recall_trace",
)
#: Runs first and is not timed, so that no headline query is charged for the start.
WARM_UP = "host_event_kinds"


def main() -> None:
    from pyspark.sql import SparkSession

    from mnemolake.catalog import all_queries

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "20g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = all_queries()
    only = sys.argv[1:] or HEADLINE
    found[WARM_UP].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in only:
        start = time.time()
        # every row and column is computed, nothing is returned to the driver
        found[name].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(sf.group(1)) if sf else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
