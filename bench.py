"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from motionmatch.session import build_session  # noqa: E402
from motionmatch.workloads import registry  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = (
    "jn3_target_search", "fn9_manual_score", "jn9_export_differences", "flt6_quality_gate",
    "ts1_densify", "ts3_normalise", "ts5_prepare", "ts7_embed", "ts9_motion_energy",
    "agg1_group_summary", "agg2_per_word", "agg3_confusions", "agg5_auroc_orders",
    "agg6_latency_percentiles", "agg8_threshold_lines", "agg10_fingerprint", "agg14_standardisation",
    "val1_manifest", "val2_duplicates", "val5_keypoints", "val7_calibration_rows", "prj1_label_rows",
    "jn6_coverage_grid", "fn1_normalize_key", "fn15_first_clean_image", "fn18_digest_status",
    "str1_attempt_stream", "str2_sessions", "str3_str4_outcomes", "win4_last_frames",
)


def main() -> None:
    session = build_session("bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    found = registry()
    chosen = sys.argv[1:] or HEADLINE
    seconds: dict[str, float] = {}
    # One untimed query starts the Python workers and warms the compiler.
    found["jn3_target_search"][0](session, FOLDER).write.format("noop").mode("overwrite").save()
    for name in chosen:
        times = []
        for _ in range(RUNS):
            start = time.perf_counter()
            found[name][0](session, FOLDER).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(FOLDER.rstrip("/"))}))
    session.stop()


if __name__ == "__main__":
    main()
