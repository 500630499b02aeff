"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full into Spark's ``noop`` sink (every row computed,
nothing collected to the driver).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from valuelens.plans.catalog import REGISTRY  # noqa: E402
from valuelens.session import local_session  # noqa: E402

HEADLINE = [
    "batch_pipeline",          # pages -> assemble -> extract -> validate -> calibrate -> comps -> CSV row
    "batch_rows",              # roll-up over derived records
    "calibrate",               # cross-field calibration report
    "field_reliabilities",     # per-field calibrated confidence (long)
    "analyze_comps",           # comparable-sales report
    "compare_summary",         # pair join + field diff counts
    "compare_fields",          # pair join + long per-field diff
    "decode_appraisal_repair",  # strict JSON decode via VARIANT
    "extract_labelled_loan",   # loan text extraction
    "assemble_documents",      # pages -> documents (shuffle)
    "choose_strategy",         # strategy choice over documents
    "batch_summary",           # global summary
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2, app="valuelens-bench")
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    times = {}
    for name in HEADLINE:
        df = REGISTRY[name](spark, sf_dir)
        t0 = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total_time", "value": total, "unit": "sec", "queries": times,
                      "sf": sf, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
