"""Seconds of the relations as one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the threads. Each query is run to its last row (a
no-op sink). A query that makes a table which others share (a graph's edges, the channels' metrics) or
takes over three seconds counts with its first run, and so with the making of that table; all others with
a second, warm one. `value` sums the relational set; loops over a graph are listed beside it.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: Loops, and what needs their results.
LOOPS = [
    "connected_components", "core_numbers", "betweenness", "communities", "node_metrics", "bridge_actors", "network_actor_metrics", "bridge_profiles",
    "community_summary", "network_summary", "community_profiles", "diagnostics", "video_network_summary", "video_network_metrics",
    "video_community_summary", "video_cluster_profiles", "video_communities", "video_modules", "video_communities_greedy", "video_partition_checks",
    "best_titles",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from tidemark.plans import registry

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        began = time.time()
        registry.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        return round(time.time() - began, 3)

    run("video_metrics")  # the session's first job
    seconds = {}
    for name in [*(q for q in registry.QUERIES if q not in LOOPS), *LOOPS]:
        shared = len(registry._SHARED)
        first = run(name)
        seconds[name] = first if first > 3 or len(registry._SHARED) > shared else run(name)
        print(name, seconds[name], file=sys.stderr, flush=True)
    loops = {name: seconds[name] for name in LOOPS}
    total = round(sum(v for k, v in seconds.items() if k not in loops), 3)
    print(json.dumps({"metric": "relational set, warm", "value": total, "unit": "sec", "queries": seconds, "loops": round(sum(loops.values()), 3), "sf": Path(SF_DIR).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
