"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the data and the local cores. Each query runs once to warm up and is then timed
on a full scan of its result (the noop sink).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallymark.registry import queries  # noqa: E402
from tallymark.session import build_session  # noqa: E402

HEADLINE = [
    "project_health", "evm_metrics", "budget_variance", "resource_utilization", "budget_vs_actual", "variance_alert_cols",
    "sla_dashboard", "pending_clearances", "clearance_by_department", "tm_invoice_lines", "tm_invoice_total", "portfolio_rollup",
    "ar_aging", "financial_summary", "metric_sum", "metric_count_distinct", "top_n_bar", "share_of_total", "kpi_compare_lag",
    "kpi_anomaly", "chart_line", "chart_pivot_table", "chart_treemap", "chart_boxplot", "chart_histogram", "chart_word_cloud",
    "dashboard_bundle", "upsert_latest", "budget_audit", "clearance_timeline", "drift_diff", "bundle_validate", "parity_coverage",
    "page_tree", "link_edges", "datastore_findings", "redact_corpus", "stream_upsert",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-")})
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    names = [a for a in sys.argv[1:] if a in registered] or HEADLINE
    times = {}
    for name in names:
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
