"""Time the pipeline stages and headline queries; prints one JSON line.

BENCH_SF_DIR  dataset folder (default sf0.1)      BENCH_CPUS  local cores (default 8)

Every stage is computed from the stored output of the stages before it, and
written; every query is computed and drained into a no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from accesslens.operators import evaluate as ev  # noqa: E402
from accesslens.operators import reports as rp  # noqa: E402
from accesslens.plans.pipeline import Pipeline  # noqa: E402
from accesslens.session import local_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "accesslens-bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    p = Pipeline(spark, sf_dir)
    times: dict[str, float] = {}

    def timed(name: str, work) -> None:
        start = time.perf_counter()
        result = work()
        if hasattr(result, "write"):
            result.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)

    for name, stage in (
        ("engineer_features", p.engineered), ("profile_build", p.store_path), ("detect", p.detection),
        ("evidence_bundle", p.evidence), ("classify", p.classified), ("explain", p.explained), ("build_alerts", p.alerts),
    ):
        start = time.perf_counter()
        stage()
        times[name] = round(time.perf_counter() - start, 3)
    timed("overview_metrics", lambda: rp.overview_metrics(p.detection()))
    timed("hourly_activity", lambda: rp.hourly_activity(p.engineered(), p.detection()))
    timed("feature_summary", lambda: rp.feature_summary(p.engineered()))
    timed("eval_detection", lambda: ev.eval_detection(p.detection()))
    timed("eval_classification", lambda: ev.eval_classification(p.classified()))
    timed("cold_start_segments", lambda: rp.cold_start_segments(rp.join_cold_start(p.detection(), p.engineered())))
    timed("detection_stability", lambda: rp.detection_stability(p.detection()))
    events = p.engineered().count()
    scoring = times["detect"]
    print(
        json.dumps(
            {
                "metric": "pipeline_wall_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "events": events,
                "detect_events_per_sec": round(events / scoring, 1),
                "detect_ms_per_event": round(1000 * scoring / events, 4),
                "cpus": int(cpus),
                "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
                "spark": spark.version,
            }
        )
    )


if __name__ == "__main__":
    main()
