"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (optional comma list).  Every query is run once to warm up at the small
scale and once, timed, at the given scale; results are written to Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tabwise.plans.catalog import QUERIES  # noqa: E402
from tabwise.session import session  # noqa: E402

HEADLINE = [
    "numeric_summary", "exact_quantiles", "profile_columns", "infer_types", "resolve_dates", "pii_values", "duplicate_rate",
    "dedupe_keep_first", "dedupe_sidecar", "coerce_table", "impute_numeric", "impute_categorical", "flag_outliers",
    "outlier_counts", "reconstruct", "categorical_summary", "pearson_pairs", "spearman_pairs", "hist", "trend", "box_by_group",
    "violin_density", "scatter_sample", "leakage_pearson", "leakage_nmi", "split_stratified", "clf_metrics", "reg_metrics",
    "roc_auc", "ask_group_sum", "ask_value_counts", "ask_median", "ask_batch", "extract_numbers", "ground_numbers",
    "screen_claims", "mask_documents", "screen_messages", "leak_scan", "redact_log_lines", "semantic_scorecard", "usage_ledger",
    "full_analysis", "stream_intake", "scan_delimited", "ingest_folder", "audit_files", "scan_workbooks", "violin", "spearman_gaps",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = session("tabwise-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
    })
    spark.sparkContext.setLogLevel("OFF")
    small = str(Path(folder).parent / "sf0.001")
    took: dict[str, float] = {}
    for name in names:
        if Path(small).exists() and small != folder:
            QUERIES[name](spark, small).write.format("noop").mode("overwrite").save()
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 4)
        print(f"{name:28s} {took[name]:8.3f}s", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": Path(folder).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
