"""Time the headline queries at one scale and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [name ...]
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from wayweft.plans.catalog import all_queries
from wayweft.session import local_session

HEADLINE = [
    "overview_kind_counts", "overview_top_files", "entrypoints_top_per_category", "edges_dedup_first_wins",
    "artifact_lineage", "contracts_missing_producer", "contracts_missing_consumer", "neighborhood_downstream_d2",
    "neighborhood_batch", "shortest_path_nodes", "trace_theta_join", "trace_runner_neighbours",
    "symbol_prefix_and_search", "symbol_postings", "doc_bm25_scores", "doc_bm25_topk", "doc_bm25_porter",
    "doc_sections", "link_resolve", "diff_line_numbers", "diff_hunk_sets", "diff_changed_symbols",
    "diff_inline_validate", "diff_batch_packing", "content_key", "lru_evict_budget", "overlay_merge", "dirty_roots",
    "content_key_wide", "code_facts", "workflow_facts", "container_facts", "makefile_facts", "markdown_facts", "shell_script_facts",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    known = all_queries()
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(known)
    spark.range(10**6).selectExpr("sum(id)").collect()
    seconds = {}
    for name in names:
        began = time.time()
        known[name][0](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    scale = re.search(r"sf([\d.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": float(scale[1]) if scale else None,
            }
        )
    )


if __name__ == "__main__":
    main()
