"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores. Each query runs three times in one
session, every row is produced and thrown away, and the best run counts.
"""

from __future__ import annotations

import json
import os
import time

from tidewire.catalog.queries import QUERIES
from tidewire.session import build_session

HEADLINE = [
    "tokenize_text", "dnf_match", "item_matches", "item_matches_vocab", "watch_matches", "dedup_first", "dedup_fifo",
    "route_items", "route_items_scoped", "outbox", "throttle", "throttle_then_mute", "stream_route", "stream_throttle",
]


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "tidewire-bench", master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false", spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    times = {name: round(min(run(spark, name, folder) for _ in range(3)), 3) for name in names}
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline queries, total", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
