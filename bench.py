"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR  folder with the tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_QUERIES comma-separated names (default: the headline list; "all" for every query)
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from bundleflow.plans.catalog import QUERIES  # noqa: E402
from bundleflow.session import local_session  # noqa: E402

HEADLINE = [
    "segment_pages", "key_supplier_fuzzy", "document_heads", "page_ranges", "early_stop_merge", "po_extract",
    "normalize_names", "normalize_entities", "name_similarity", "le_alias_build", "le_fuzzy_top1", "sensitive_match",
    "vn_match", "tag_documents", "route_invoices", "quarantine_split", "batch_assign", "success_rows", "invoice_report",
    "run_stats", "pair_attachments", "unique_names", "sheet_match", "parse_eml", "expand_zip", "parse_signals",
    "whole_run_report", "whole_run_batches",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    spark = local_session(cpus, "bundleflow-bench")
    # untimed: start the executors and load classes
    QUERIES[names[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
