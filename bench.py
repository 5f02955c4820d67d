"""Headline queries, timed. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from veilspark.plans import registry
from veilspark.session import local_session

QUERIES = (
    "scan_summary", "det_provider_rules", "det_pii_email", "det_pii_credit_card", "src_documents", "sup_order", "agg_dedup",
    "join_allowlist", "sink_sarif", "mask_match", "mask_key_blocks", "psd_table", "psd_text", "psd_restore_text",
    "sink_restore_map", "psd_linkage", "src_history_blobs", "src_audit_log", "agg_audit_summary", "agg_audit_by_rule",
    "win_top_events", "aud_agent_servers", "aud_workflow_checkout", "agg_env_file_state", "grd_first_category",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    chosen = sys.argv[1:] or QUERIES
    queries = registry().queries
    # the JVM compiles its hot paths on first use; one small query keeps that out of the first figure
    queries["agg_by_severity"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for key in chosen:
        began = time.time()
        queries[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[key] = round(time.time() - began, 3)
        print(key, seconds[key], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
