"""Time the headline queries once each and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from clauseloom.plans import load_catalog
from clauseloom.session import build_session, release

HEADLINE = ["a6_passage_binding", "x10_assemble_text", "x1_normalize_title", "e1_normalize_evidence", "c1_extract_clauses",
            "w7_monotonic_progress", "w8_progress_changes", "w10_reusable_task", "k2_fold_updates", "a17_task_stats",
            "a18_latency_quantiles", "w6_number_clauses", "a7_quality_report", "a10_subtree_tokens", "w4_fill_ranges",
            "s10_clause_matrix", "g2_convert_positions", "j2_node_blocks", "e8_locate_visual", "e9_locate_clauses",
            "t3_thin_tree", "t12_toc_items", "t16_repair_toc", "x7_find_title_robust", "x15_fill_node_text",
            "r1_stream_progress", "e4_match_similarity", "e6_locate_text", "x6_find_title_anywhere", "x13_positions_between",
            "t9_group_pages", "t17_resolve_toc"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, "20g", "clauseloom-bench")
    spark.sparkContext.setLogLevel("ERROR")
    catalog = load_catalog()
    spark.read.parquet(f"{folder}/region.parquet").count()
    times = {}
    for name in wanted:
        begin = time.perf_counter()
        catalog[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
        release(spark)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
