"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR  folder of the parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "flatten_leaves", "sanitize_json", "sibling_context", "reject_reasons", "score_pairs", "coverage", "statuses",
    "two_pass_select", "json_pairs", "resolve_aliases", "extract_label_pairs", "event_table_documents", "dedupe_documents",
    "historic_matches", "topk_resolutions", "render_response", "merge_views", "score_outcomes", "mapping_metrics",
    "subgroup_accuracy", "compare_experiments", "promotion_gate", "derive_decisions", "quarantine", "validate_records",
    "record_hashes", "review_report", "compile_items", "negative_sampling", "length_buckets", "dataset_manifest", "clean_text",
)


def main() -> None:
    names = sys.argv[1:] or HEADLINE
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from evimap import build_session
    from evimap.plans import QUERIES

    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
    })
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in names:
        started = time.perf_counter()
        # the noop sink computes every row and column and keeps none
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "evidence_mapping_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
