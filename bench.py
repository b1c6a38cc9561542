"""Time the headline queries. Prints one JSON line.

BENCH_SF_DIR: table directory (default /root/testdata/sf0.1); BENCH_CPUS: local cores (default 8).
Every query builds what it needs from the tables; nothing is shared between queries.
"""

from __future__ import annotations

import json
import os
import re
import time

from checks.queries import QUERIES
from flowlens.session import local_session

HEADLINE = [
    "scl4_classify_call", "scl8_categories_in", "scl8_categories_in_documents", "scl5_identifiers",
    "graph_from_calls_flows", "graph_from_calls_nodes", "scan_files_flows", "prj3_line_at", "agg3_merge_flows",
    "agg14_collapse", "agg8_node_throughput", "flow_volume_ribbons", "agg5_dominant_sensitivity", "prj8_flow_details",
    "view_flows", "sensitive_leaks", "jon8_adjacency", "grf1_node_depth", "grf2_lineage", "grf3_focus",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=8, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["scl4_classify_call"](spark, sf_dir).limit(1).collect()  # start the Python and JVM side
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf.group(1)) if sf else None}))
    spark.stop()


if __name__ == "__main__":
    main()
