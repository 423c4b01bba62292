"""Wall-clock seconds of the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose
data and cores; arguments, if any, name the queries to run.
"""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
# Python workers import the package too, wherever the bench is started from.
os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (HERE, os.environ.get("PYTHONPATH")) if p)

HEADLINE = [
    "b9_iou_pairs", "c2_c3_merge_tiles_nms", "d2_link_detections", "d5_track_summary",
    "e2_e13_track_features", "f1_f2_match_detections", "f3_f4_evaluate_dataset", "f6_score_report", "f7_f9_false_alarm_rate_per_clip",
    "g2_census_counts", "g3_track_census", "h3_feature_ranges", "j3_match_authorization", "j5_query_history", "j8_j9_decide",
]


def main() -> None:
    from skytriage.plans import load_all
    from skytriage.plans.registry import QUERIES
    from skytriage.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus), spark__ui__enabled="false", spark__driver__memory="16g")
    load_all()
    names = sys.argv[1:] or HEADLINE
    # One small job starts the executor threads and compiles the common code paths.
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
