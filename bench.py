"""Time the headline queries; prints one JSON line.

Scale and cores come from ``BENCH_SF_DIR`` and ``BENCH_CPUS``.  Each query runs
once to warm up and then three times; the median counts.  Results go to the
``noop`` sink, so every row and column is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "page_assembly",
    "page_assembly_rows",
    "method_choice",
    "text_clean",
    "prompt_build",
    "request_rows",
    "chosen_text",
    "doc_reply",
    "document_result",
    "processing_log",
    "upload_verdict",
    "reply_gate",
    "parse_invoice",
    "token_cost",
    "ledger_header",
    "ledger_items",
    "ledger_stats",
    "ledger_page",
    "invoice_detail",
    "invoice_nested",
    "lookup_found",
    "totals",
    "check_arithmetic",
    "violation_summary",
    "form_payload",
    "job_latest",
    "job_status_view",
    "job_results",
    "report_rows",
    "invoice_overview",
    "stream_ledger",
)


def main() -> None:
    from ledgerloom.catalog import QUERIES
    from ledgerloom.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        runs = []
        for attempt in range(4):
            started = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            if attempt:
                runs.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(runs), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
