"""Time queries on one machine and print one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the cores; BENCH_QUERIES (comma separated,
or "all") chooses the queries. Each query runs once to warm up, then BENCH_RUNS times; the
median counts. Results are fully computed and thrown away.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from clinicflow.plans.queries import QUERIES  # noqa: E402
from clinicflow.session import local_session  # noqa: E402

HEADLINE = (
    "invoice_totals", "invoice_line_amounts", "invoice_numbering", "invoice_admission",
    "appointments_complete", "appointment_overlaps", "appointment_admission",
    "appointment_changes", "inventory_status", "critical_stock_report", "movement_validation",
    "movement_admission", "stock_ledger", "running_stock", "low_stock_alerts",
    "expiration_alerts", "code_generation", "user_audit_update", "dq_checks", "dq_orphans",
    "dq_unique",
)


def run(spark, name: str, folder: str) -> float:
    began = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = local_session(cpus)
    seconds = {}
    for name in names:
        run(spark, name, folder)
        seconds[name] = round(statistics.median(run(spark, name, folder) for _ in range(runs)), 3)
        print(name, seconds[name], file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "sum of median query seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rsplit("sf", 1)[-1],
                "cpus": cpus,
                "spark": spark.version,
                "runs": runs,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
