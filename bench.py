"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dialoom.plans.catalog import QUERIES  # noqa: E402
from dialoom.session import local_session  # noqa: E402

HEADLINE = [
    "interval_union", "overlap_regions", "overlap_ratio", "talk_time_share", "atomic_intervals", "two_speaker_overlap",
    "interval_subtract", "clamp_to_region", "neighbor_support", "best_overlap_match", "merge_adjacent", "block_packing",
    "clean_transcript", "line_rules", "block_features", "token_set_dedup", "same_text_dedup", "exact_fingerprint", "reuse_quota",
    "hyp_ref_label_map", "overlap_prf", "diarization_error", "wer", "nearest_centroid", "knn_top8", "track_votes", "clean_spans",
    "stable_zones", "speaker_retrieval", "training_chunks", "latest_status", "lockout_sessions", "retention_purge", "summary_upsert",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="dialoom-bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    chosen = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    times: dict[str, float] = {}
    for name in chosen:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "total wall time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf.group(1)) if sf else None}))
    spark.stop()


if __name__ == "__main__":
    main()
