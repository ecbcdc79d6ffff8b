"""Wall time of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from rankmill.plans import QUERIES
from rankmill.session import local_session
from rankmill.sources.tables import PARTS, TABLES, table

HEADLINE = (
    "e03_top_15", "e01_rank_in_job", "d01_weighted_total", "d06_facet_counts", "b12_interview_preset",
    "a12_detail_sheet", "a06_reuse_by_hash", "h01_scrub", "h07_shorten_by_section", "s02_distinct_lines",
    "c07_exact_duplicate_groups", "c06_near_duplicates", "d19_term_frequency", "d23_relevance", "e04_cap_split",
    "e06_gaps", "c05_overlaps", "d24_covered_years", "d11_test_totals", "d12_score_groups", "d14_interview_totals",
    "d17_rater_agreement", "h33_decision", "a22_model_output_repair", "a23_hydrated_shape", "d03_stage_counters",
    "m07_deadline_overflow", "m05_audit_rows", "k11_references_and_keys", "a21_request_table", "t01_budget_per_key",
    "h31_requirement_rules", "h14_ranges_in_text", "m01_rerank_with_new_weights", "t03_incremental_intake",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    picked = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.conf.set(PARTS, spark.sparkContext.defaultParallelism)  # each given table is one row group
    for name in TABLES:  # warm up the session: file listing, footers, code generation
        table(spark, folder, name).groupBy().count().collect()
    times: dict[str, float] = {}
    for name in picked:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    sf = folder.rstrip("/").rsplit("sf", 1)[-1]
    print(
        json.dumps(
            {
                "metric": "total wall time of headline queries", "value": round(sum(times.values()), 3),
                "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
            }
        )
    )


if __name__ == "__main__":
    main()
