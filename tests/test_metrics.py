import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lapsewise.operators import audit, metrics


def frame(spark, pairs, key=None):
    return spark.createDataFrame([("s", f"p{i}", "t", y, x) for i, (y, x) in enumerate(pairs)], "source string, source_id string, t string, y int, score double")


FIVE = [(1, 0.9), (0, 0.8), (1, 0.4), (0, 0.3), (0, 0.1)]


def test_hand_computed(spark):
    df = frame(spark, FIVE)
    r = metrics.ranking(metrics.distinct_scores(df)).first()
    assert r["pr_auc"] == pytest.approx(5 / 6) and r["roc_auc"] == pytest.approx(5 / 6)
    assert metrics.brier(df).first()[0] == pytest.approx(1.11 / 5)
    assert metrics.calibration_error(df).first()[0] == pytest.approx(1.9 / 5)
    c = metrics.confusion_at(df, 0.5).first()
    assert (c["tp"], c["fp"], c["fn"], c["tn"]) == (1, 1, 1, 2)
    b = metrics.budget_thresholds(metrics.distinct_scores(df), budgets=(2,)).first()
    assert b["threshold"] == 0.8


def test_undefined_is_null(spark):
    one = metrics.ranking(metrics.distinct_scores(frame(spark, [(0, 0.1), (0, 0.2)]))).first()
    assert one["pr_auc"] is None and one["roc_auc"] is None
    assert metrics.ranking(metrics.distinct_scores(frame(spark, []))).count() <= 1


def test_ties_against_a_plain_count(spark):
    rng = random.Random(1)
    pairs = [(rng.randint(0, 1), rng.randint(0, 5) / 5) for _ in range(200)]
    got = metrics.ranking(metrics.distinct_scores(frame(spark, pairs))).first()
    pos, neg = [x for y, x in pairs if y], [x for y, x in pairs if not y]
    roc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    ap = last = 0.0
    for s in sorted({x for _, x in pairs}, reverse=True):
        flagged = [y for y, x in pairs if x >= s]
        recall = sum(flagged) / len(pos)
        ap, last = ap + (recall - last) * sum(flagged) / len(flagged), recall
    assert got["roc_auc"] == pytest.approx(roc) and got["pr_auc"] == pytest.approx(ap)


def test_bins_have_closed_end(spark):
    r = {x["bin"]: x["n"] for x in metrics.reliability(frame(spark, [(1, 1.0), (0, 0.3), (0, 0.1)])).collect()}
    assert len(r) == 10 and r[9] == 1 and r[1] == 1 and sum(r.values()) == 3


def test_bootstrap_keeps_postings_whole_and_repeats(spark):
    df = spark.createDataFrame([("s", p, i, int(p == "a"), 0.5) for p in "ab" for i in range(3)], "source string, source_id string, t int, y int, score double")
    a = metrics.bootstrap(df, 20).orderBy("b").collect()
    assert all(r["n"] == 6 and r["positives"] % 3 == 0 for r in a)
    assert a == metrics.bootstrap(df, 20).orderBy("b").collect()


def test_wilson_and_verdicts(spark):
    df = spark.createDataFrame([(0, 0), (5, 10)], "h long, n long")
    a, b = audit.wilson(df, "h", "n").collect()
    assert a["low"] is None and b["low"] == pytest.approx(0.2366, abs=1e-3) and b["high"] == pytest.approx(0.7634, abs=1e-3)
    assert not math.isnan(b["low"])


@pytest.mark.parametrize("keys", [(), ("source",)])
def test_bootstrap_passes_nothing_through_the_driver(spark, keys):
    rows = [(f"s{k % 2}", f"p{k}", d, int((k + d) % 5 == 0), ((k * 7 + d) % 11) / 11) for k in range(40) for d in range(3)]
    df = spark.createDataFrame(rows, "source string, source_id string, t int, y int, score double")
    clusters = metrics.numbered_clusters(df, *keys)
    for table in (metrics.resampled_scores(df, clusters, 20, *keys), metrics.replicates(df, 20, *keys)):
        table.collect()
        assert "Broadcast" not in table._jdf.queryExecution().executedPlan().toString()
    drawn = metrics.replicates(df, 20, *keys).groupBy(*keys, "b").sum("w").collect()
    assert len(drawn) == 20 * (2 if keys else 1) and {r["sum(w)"] for r in drawn} == {20 if keys else 40}
    # the same table by rows copied
    copied = df.withColumn("cluster", F.concat_ws("|", "source", "source_id")).join(metrics.replicates(df, 20, *keys), [*keys, "cluster"]).groupBy(*keys, "b", "score").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("pos"))
    assert sorted(map(tuple, metrics.resampled_scores(df, clusters, 20, *keys).collect())) == sorted(map(tuple, copied.collect()))


def test_draws_are_dealt_and_never_meet_cells_as_rows(spark):
    """A stored table of clusters is one file, whose task must not make all the draws; nor are draws times cells rows."""
    rows = [(f"s{k % 2}", f"p{k}", d, int((k + d) % 5 == 0), ((k * 7 + d) % 11) / 11) for k in range(40) for d in range(3)]
    df = spark.createDataFrame(rows, "source string, source_id string, t int, y int, score double")
    clusters = metrics.numbered_clusters(df, "source").coalesce(1)
    draws = metrics.draws_of(clusters, 20, "source")
    made = {r["task"]: r["count"] for r in draws.select(F.spark_partition_id().alias("task")).groupBy("task").count().collect()}
    assert len(made) > 1 and sum(made.values()) == 800
    plan = metrics.resampled_scores(df, clusters, 20, "source")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(") >= 2 and "MapInArrow" in plan


def test_weighted_sums_handed_on_in_parts(spark, monkeypatch):
    rows = [("s", f"p{k}", d, int((k + d) % 5 == 0), None if k == 3 else ((k * 7 + d) % 11) / 11) for k in range(40) for d in range(3)]
    df = spark.createDataFrame(rows, "source string, source_id string, t int, y int, score double").coalesce(1)
    clusters = metrics.numbered_clusters(df, "source")
    table = lambda: sorted(map(str, metrics.resampled_scores(df, clusters, 20, "source").collect()))
    whole = table()
    found = []
    for held, at_once in ((60, 2_000_000), (60, 100)):
        monkeypatch.setattr(metrics, "HELD", held)
        monkeypatch.setattr(metrics, "AT_ONCE", at_once)
        run = metrics.weighted_sums(("source",), 20, pa.schema([("source", pa.string()), ("b", pa.int64()), ("score", pa.float64()), ("n", pa.int64()), ("pos", pa.int64())]))
        cells = pa.array([[{"score": s, "c": c, "p": 1} for s, c in own] for own in ([(0.5, 2), (None, 3)], [(0.25, 4)], [(0.5, 1)])], pa.list_(pa.struct([("score", pa.float64()), ("c", pa.int64()), ("p", pa.int64())])))
        batch = pa.RecordBatch.from_arrays([pa.array(["x", "x", "y"]), pa.array([[0, 0, 3], [3], [19]], pa.list_(pa.int32())), cells], ["source", "b", "cells"])
        got = {}
        for out in run(iter([batch, batch])):
            for r in out.to_pylist():
                key = (r["source"], r["b"], r["score"])
                got[key] = tuple(map(sum, zip(got.get(key, (0, 0)), (r["n"], r["pos"]), strict=True)))
        found.append(got)
    assert found[0] == found[1] == {("x", 0, 0.5): (8, 4), ("x", 3, 0.5): (4, 2), ("x", 0, None): (12, 4), ("x", 3, None): (6, 2), ("x", 3, 0.25): (8, 2), ("y", 19, 0.5): (2, 2)}
    assert len(whole) == len(set(whole)) and any("score=None" in r for r in whole)
