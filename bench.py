"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR   input folder (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma-separated subset (default: the list below)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from wardline.operators import features as FT  # noqa: E402
from wardline.plans import models as PM  # noqa: E402
from wardline.queries import QUERIES, train_baselines  # noqa: E402
from wardline.session import checkpoint, local_session, use_utc  # noqa: E402
from wardline.sources.access_log import load_log  # noqa: E402

HEADLINE = [
    "access_log_view", "user_baselines", "population_baseline", "window_features", "deviation_features",
    "shared_devices", "rule_summary", "rule_policy_alerts", "risk_scores", "reason_strings",
    "alert_queue_page", "alert_status", "alert_upsert", "alert_timeline", "alert_kpis",
    "drift_users", "drift_users_exact", "drift_population", "drift_feature_report", "drift_lineitem_price",
    "adwin_users", "eval_binary", "eval_multiclass", "eval_one_vs_rest", "smote_balanced", "iforest_scores",
]


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = use_utc(local_session("wardline-bench", cores=cpus, memory="12g"))
    consume(spark.range(1000).repartition(4).groupBy((F.col("id") % 7).alias("k")).count())

    times: dict[str, float] = {}

    def timed(name, fn):
        start = time.perf_counter()
        out = fn()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
        return out

    for name in chosen or HEADLINE:
        timed(name, lambda: consume(QUERIES[name](spark, sf_dir)))

    extra = {}
    if not chosen:
        # The offline job, stage by stage: baselines, features, training, inference, alerts.
        log = load_log(spark, sf_dir)
        events = log.count()
        base = timed("stage_baselines", lambda: train_baselines(log))
        feats = timed("stage_features", lambda: checkpoint(FT.build_features(log, base)))
        table = PM.stratified_split(FT.feature_matrix(feats, keep=("event_id", "label")))
        forest, _ = timed("stage_train_forest", lambda: PM.train_anomaly(table))
        model, _ = timed("stage_train_classes", lambda: PM.train_classes(table, trees=40, depth=8))
        models = PM.Models(base, forest, model)
        timed("stage_inference", lambda: consume(PM.score_features(feats, models, norm="shift")))
        timed("stage_alerts", lambda: consume(PM.SC.alert_rows(PM.score_features(feats, models))))
        extra = {
            "events": events,
            "features_events_per_sec": round(events / times["stage_features"]),
            "inference_events_per_sec": round(events / times["stage_inference"]),
        }
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), **extra}))


if __name__ == "__main__":
    main()
