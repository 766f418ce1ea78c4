"""Times the headline queries and prints one JSON line.

Each query is warmed up once and then timed three times (median), its result
forced with a ``noop`` write. Eager steps (staged tables) are part of the time.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from siftline.plans import catalogue_of_queries
from siftline.session import build_session

HEADLINE = [
    "order_quality_report",
    "validate_schema_contact",
    "violations_contact",
    "issues_contact",
    "error_report_contact",
    "unique_part_name",
    "unique_document_text",
    "check_picklist_large",
    "clean_lineitem",
    "coerce_bool_lineitem",
    "functions_number",
    "formula_lineitem",
    "run_summary_lineitem",
    "message_rules_customer",
    "message_rules_joined",
    "apply_constraints_contact",
    "extract_fields_documents",
    "extract_constraints_documents",
    "extract_constraints_messages",
    "profile_lineitem",
    "profile_lineitem_approx",
    "profile_documents",
    "detect_types_texts",
    "column_issues_orders",
    "quality_documents",
    "duplicate_rows_lineitem",
    "lookup_customer_nation",
    "lookup_large_parent",
    "categorize_orders",
    "batch_orders",
    "upsert_customer",
    "batch_report",
    "gaps_rules",
    "alignment_rules",
    "grade_rules",
    "log_entries_events",
    "logs_top",
    "prioritize_parts",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "siftline-bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": cpus,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = catalogue_of_queries()
    times: dict[str, float] = {}
    for name in names:
        measured = []
        for i in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            if i:
                measured.append(time.perf_counter() - start)
        times[name] = round(statistics.median(measured), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": folder.rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
