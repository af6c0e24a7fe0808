"""Command-line jobs, for spark-submit.

    spark-submit wardline/plans/jobs.py train  --log LOG --models DIR
    spark-submit wardline/plans/jobs.py score  --log LOG --models DIR --alerts TABLE
    spark-submit wardline/plans/jobs.py drift  --log LOG --status FILE [--days 30]
    spark-submit wardline/plans/jobs.py explain --log LOG --models DIR
    spark-submit wardline/plans/jobs.py retrain --log LOG --alerts TABLE --feedback TABLE --root DIR
    spark-submit wardline/plans/jobs.py stream --log DIR --models DIR --alerts TABLE --state DIR
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession, functions as F

from wardline.operators import drift as D
from wardline.operators import scoring as SC
from wardline.operators.attribution import with_attributions
from wardline.plans.models import Models, score, train
from wardline.plans.retrain import retrain
from wardline.session import COMMON_CONF, ROCKSDB_PROVIDER
from wardline.sources import stores
from wardline.sources.access_log import read_log

DRIFT_STATUS = (
    "window_days int, users_checked bigint, users_drifted bigint, global_drift_detected boolean, "
    "drifted_users array<struct<user_id:string,feature:string,ks_stat:double,p_value:double>>, "
    "population_drift array<struct<feature:string,ks_stat:double,p_value:double,drifted:boolean>>, "
    "method string, checked_at timestamp")
NO_DRIFT_STATUS = {"global_drift_detected": False, "users_drifted": 0, "users_checked": 0,
                   "checked_at": None, "method": "not_run"}


def train_job(spark, a) -> None:
    models, binary, classes = train(read_log(spark, a.log))
    models.save(a.models)
    stores.write_document(binary, f"{a.models}/metrics/anomaly")
    stores.write_document(classes, f"{a.models}/metrics/classes")


def score_job(spark, a) -> int:
    scored = score(read_log(spark, a.log), Models.load(spark, a.models))
    return stores.append_alerts(SC.alert_rows(scored), a.alerts)


def drift_job(spark, a) -> None:
    stores.write_document(D.drift_status(read_log(spark, a.log), a.days), a.status)


def explain_job(spark, a) -> None:
    models = Models.load(spark, a.models)
    examples = SC.richest_examples(score(read_log(spark, a.log), models))
    with_attributions(examples, models.classifier).select(
        "label", "attack_type", F.round("confidence", 4).alias("confidence"),
        SC.reason_text().alias("reason"), "top_features").show(10, truncate=False)


def retrain_job(spark, a) -> None:
    retrain(read_log(spark, a.log), stores.read_alerts(spark, a.alerts),
            stores.read_feedback(spark, a.feedback), a.root)


def stream_job(spark, a) -> None:
    from wardline.streaming.hot_path import read_events, start_scoring

    start_scoring(read_events(spark, a.log), a.models, a.alerts, a.state).awaitTermination()


def main(argv: list[str] | None = None) -> None:
    jobs = {"train": train_job, "score": score_job, "drift": drift_job, "explain": explain_job,
            "retrain": retrain_job, "stream": stream_job}
    parser = argparse.ArgumentParser()
    parser.add_argument("job", choices=jobs)
    for name in ("log", "models", "alerts", "feedback", "status", "root", "state"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--days", type=int, default=D.WINDOW_DAYS)
    args = parser.parse_args(argv)
    builder = SparkSession.builder.appName(f"wardline-{args.job}").config(
        "spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    for key, value in COMMON_CONF.items():
        builder = builder.config(key, value)
    jobs[args.job](builder.getOrCreate(), args)


if __name__ == "__main__":
    main()
