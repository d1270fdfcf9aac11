"""Time the headline queries; prints one JSON line.

Tables come from $BENCH_SF_DIR, cores from $BENCH_CPUS. Each query runs once to
warm up, then $BENCH_RUNS times; its time is the median. Results go to Spark's
`noop` sink, so every row and column is computed and none is collected.
"""

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from gable.plans.queries import REGISTERED  # noqa: E402
from gable.session import local_session  # noqa: E402

HEADLINE = (
    "sales_extract", "mean_price", "std_house_price", "most_expensive_sale", "count_house_types",
    "avg_house_tenancy", "count_price", "sale_volume", "pct_change_price", "stats_bundle",
    "house_detail", "linked_epcs", "usage_summary", "usage_trends", "top_routes", "billing_history",
    "ledger_rollup", "usage_stamped", "ledger_items",
    "ppd_normalise", "ppd_upsert_houses", "ppd_upsert_sales", "ppd_apply_changes", "epc_typed",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, partitions=int(cores) if cores.isdigit() else 8, **{"spark.driver.memory": "16g"})

    def once(name: str) -> float:
        begun = time.perf_counter()
        REGISTERED[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begun

    times = {}
    for name in names:
        once(name)
        times[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
        print(f"{name}: {times[name]}", file=sys.stderr)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
