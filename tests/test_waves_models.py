import datetime as dt

import pytest
from pyspark.sql import functions as F

from lapsewise.operators import features, models, scoring, waves

T0 = dt.datetime(2026, 9, 1)


def rows(spark, n_waves=14, ids=30):
    data = [("b" if k % 2 else "c", f"p{k}", T0 + dt.timedelta(days=w, minutes=k % 3), w, int((k + w) % 4 == 0), True, float(k), f"x{k % 3}", 0.5) for w in range(n_waves) for k in range(ids)]
    return spark.createDataFrame(data, "source string, source_id string, t timestamp, run_index long, y int, label_observable boolean, age_days double, title string, score double")


def test_waves_merge_within_an_hour(spark):
    df = spark.createDataFrame([(T0,), (T0 + dt.timedelta(hours=1),), (T0 + dt.timedelta(hours=2, seconds=1),)], "t timestamp")
    assert waves.crawl_waves(df).select("wave").distinct().count() == 2


def test_split_orders_blocks_and_refuses_a_cut_inside_a_wave(spark):
    df = rows(spark)
    cut = lambda d: T0 + dt.timedelta(days=d, minutes=2)
    s = waves.temporal_split(df, cut(3), cut(8), 1)
    assert set(s.counts) == {"train", "val", "test"}
    assert s.frame.where("split = 'train' and seen_in_train").isEmpty()
    with pytest.raises(waves.SplitError):
        waves.temporal_split(df, T0 + dt.timedelta(days=3, minutes=30), cut(8), 1)


def test_depth_and_accrual():
    assert waves.rolling_origin_folds(3, 5) == 0
    assert waves.accrual_status(T0, 86400.0, T0 + dt.timedelta(days=3))["stalled"]
    assert waves.projected_clear(T0, 2, 86400.0, False) == T0 + dt.timedelta(days=2)
    with pytest.raises(waves.SplitError):
        waves.embargo_seconds(-1, 0.0)


def test_models_learn_from_train_only(spark):
    df = rows(spark).withColumn("split", F.when(F.col("run_index") < 6, "train").otherwise("val"))
    train = df.where("split = 'train'")
    stats = models.numeric_statistics(train, ["age_days"]).first()
    assert stats["fill"] == pytest.approx(14.5)
    steps = models.rungs(["age_days"], ["title"])
    out = models.ladder(df, {n: steps[n] for n in ("prior", "board_hazard", "logistic")}).collect()
    assert {r["rung"] for r in out} == {"prior", "board_hazard", "logistic"}
    prior = next(r for r in out if r["rung"] == "prior")
    assert prior["pr_auc"] == pytest.approx(prior["positives"] / prior["n"])


def test_selection_prefers_the_simplest_tied(spark):
    c = [models.Candidate("big", 3, False, {0: 0.5, 1: 0.6, 2: 0.52}), models.Candidate("small", 1, False, {0: 0.52, 1: 0.57, 2: 0.51}), models.Candidate("rule", 0, True, {0: 0.1, 1: 0.1, 2: 0.1})]
    assert models.select(c)["selected"] == "small"
    assert models.select(c[:1] + [models.Candidate("rule", 0, True, {0: 0.5, 1: 0.6, 2: 0.52})])["selected"] == "rule"


def test_contract(spark):
    df = spark.createDataFrame([("a", "t", "3"), ("b", "", "3"), ("c", "t", "NaN")], "client_id string, title string, n_offices string")
    assert [r["error_code"] for r in scoring.validate(df).collect()] == ["ok", "missing_title", "bad_n_offices"]
    with pytest.raises(ValueError):
        scoring.validate(df.withColumn("zzz", F.lit(1)))
    with pytest.raises(ValueError):
        features.assert_known(df)


def test_snapshot_context(spark):
    df = spark.createDataFrame([("x", "r1"), ("x", "r2"), ("x", "r3"), ("z", None), ("z", "r3")], "title string, requisition_id string")
    got = sorted((r["title"], r["n_same_title_on_board"], r["n_same_req_on_board"] or 0, r["board_growth"]) for r in scoring.board_context(df, 2).collect())
    assert got == [("x", 3, 1, 3), ("x", 3, 1, 3), ("x", 3, 2, 3), ("z", 2, 0, 3), ("z", 2, 2, 3)]
