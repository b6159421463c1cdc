"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEATS (default 1; the best run counts), BENCH_QUERIES (comma list).
"""

from __future__ import annotations

import json
import os
import time

from ledgerrecon.session import build_session
from workloads.queries import QUERIES

HEADLINE = (
    "recon_basic", "recon_multi_key", "recon_invert", "recon_text_values", "recon_summary", "side_totals_kept",
    "missing_order_keys", "composite_keys", "number_clean", "fill_null_cells", "cancel_normalized", "concilable_rows",
    "reversal_pair_groups", "reversal_pairs_1to1", "reversal_flags", "reversal_flags_tolerance",
    "enrich_first", "enrich_last", "enrich_items", "results_page", "purge_results", "infer_types",
    "ingest_roundtrip", "header_at_coordinates", "row_ordinals", "export_ordered", "preprocess_upload",
    "run_then_enrich",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    spark = build_session(
        "ledgerrecon-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/orders.parquet").write.format("noop").mode("overwrite").save()
    QUERIES[names[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # code is compiled before times count
    seconds = {}
    for name in names:
        runs = []
        for _ in range(repeats):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
    spark.stop()
    scale = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }))


if __name__ == "__main__":
    main()
