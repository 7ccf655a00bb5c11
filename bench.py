"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from foliospark.plans import QUERIES
from foliospark.session import build_session

HEADLINE = (
    "w1_rag_chunks", "a2_chunk_statistics", "p4_invoice_main", "w6_invoice_line_items", "a5_invoice_totals", "p6_p8_provenance_flatten",
    "u2_field_extraction", "j4_first_reference_boxes", "u4_schema_conformance", "u5_schema_dispatch", "w2_a12_split_documents",
    "w6_order_line_index", "p25_p26_pixel_boxes", "s12_columnar_filings", "f1_filing_filter", "x1_j10_missing_periods",
    "a9_w3_company_report", "j1_file_map_join", "j8_skip_existing", "u1_page_chunks", "u7_page_classes", "r2_text_search",
    "r5_batch_search", "a14_distinct_rows", "a6_files_per_status", "st4_job_states",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cores)
    chosen = sys.argv[1:] or HEADLINE
    QUERIES["a5_invoice_totals"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in chosen:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cores),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
