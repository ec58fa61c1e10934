"""Seconds per headline query; prints one JSON line.

`BENCH_SF_DIR` (default sf0.1) is the data, `BENCH_CPUS` the cores of the local master. Each query
runs once to warm up and is then timed to the end of all its tasks (a sink that drops the rows).
"""

import json
import os
import re
import sys
import time

from pyspark.sql import SparkSession

import bindings

HEADLINE = [
    "consolidated_fields", "consolidated_values", "normalised_votes", "consensus_ranking",
    "consensus_prefill", "coverage_cut", "dead_engine_cut", "call_progress", "first_valid_box",
    "document_types", "fold_text", "field_audit", "audit_sections", "postcode_check", "iban_check",
    "page_batches", "restore_warnings", "fill_report", "edit_replay_undo", "assigned_canonicals",
    "template_fingerprints", "signature_placements", "moved_stamps", "otsu_thresholds",
    "threshold_islands", "history_list", "change_feed_stream", "edit_replay_stream",
    "live_votes_stream", "merged_candidates", "intruder_flags", "risky_sources", "field_decisions",
    "protected_fields", "autofilled_values", "pending_decisions", "state_counts",
    "field_values_as_of", "fragments_in_boxes", "failure_windows_stream", "catalogue_matches",
]


def main(names):
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g")).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        for run in ("warm", "timed"):
            start = time.perf_counter()
            bindings.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([\d.]+)", sf)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": float(scale.group(1)) if scale else sf}))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:] or HEADLINE)
