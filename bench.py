"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lectern.plans import catalog  # noqa: E402
from lectern.session import build_session  # noqa: E402

HEADLINE = [
    "rank_blocks",
    "repeated_boundary_lines",
    "merge_paragraphs",
    "grounding_report",
    "reading_progress",
    "retrieve",
    "evidence_recall",
    "structural_score",
    "budget_admission",
    "rate_window",
    "leakage_pairs",
    "extract_blocks",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    rounds = int(os.environ.get("BENCH_ROUNDS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's code paths: the scan, the split into blocks and terms, a written cut and a join that every query shares.
    for name in ("document_frequency", "drop_blank_blocks"):
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        spent = []
        for _ in range(rounds):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            spent.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(spent), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
                "cpus": cpus,
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
