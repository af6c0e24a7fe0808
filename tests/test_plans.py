"""The physical plans stay the intended ones."""

import pytest

from wardline.operators import baselines as B
from wardline.operators import drift as D
from wardline.operators import features as FT
from wardline.operators import scoring as SC
from wardline.operators.hotkeys import SkewPolicy, hot_keys
from wardline.queries import standin_risk
from wardline.sources.access_log import load_log


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_shuffle_the_log_once(spark, sf_dir, no_broadcast):
    log = load_log(spark, sf_dir)
    base = B.fit_baselines(log)
    text = plan(standin_risk(FT.build_features(log, base)).select("event_id", "risk_score", SC.reason_text()))
    # One exchange of the log and one of the baselines; no Python, no nested loops.
    assert text.count("Exchange hashpartitioning") == 2 and text.count("Exchange") == 2
    assert text.count("Sort [") == 2
    assert "Python" not in text and "NestedLoop" not in text and "CartesianProduct" not in text


def test_columns_are_pruned(spark, sf_dir):
    text = plan(hot_keys(load_log(spark, sf_dir), "user_id", 5))
    scan = text[text.index("FileScan"):]
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in scan
    text = plan(D.split_windows(load_log(spark, sf_dir), 15).select("user_id", "side"))
    assert "props" not in text[text.index("FileScan"):].split("ReadSchema")[1].split("\n")[0]


def test_hot_split_has_no_cross_join(spark, log):
    from wardline.operators.context import context_features

    text = plan(context_features(log, SkewPolicy(hot_rows=20, segment_rows=7, slot_s=1)))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert "WindowGroupLimit" in text      # tails are limited before the shuffle


def test_timelines_shuffle_no_look_backs(spark, log, no_broadcast):
    from pyspark.sql import functions as F

    from wardline.operators.context import timelines

    text = plan(timelines(log, log.filter("NOT success").select("event_id", F.concat(F.lit("al_"), "event_id").alias("id"))))
    assert "Exchange" in text and "Exchange" not in text[:text.index("Window [")]
