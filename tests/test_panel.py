"""Presence maps: posting -> runs that saw it."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lapsewise.operators import panel as P

START = dt.datetime(2026, 9, 1, 3, 45)


def crawls(spark, seen, n, source="b", jitter=lambda i: 0):
    at = [START + dt.timedelta(days=i, minutes=jitter(i)) for i in range(n)]
    runs = spark.createDataFrame([(i, source, t, "ok", 2) for i, t in enumerate(at)], "id long, source string, started_at timestamp, status string, rules_version long")
    rows = spark.createDataFrame([(at[i], source, p) for p, own in seen.items() for i in own], "observed_at timestamp, source string, source_id string")
    return runs, rows


def labels(spark, seen, n, horizon, basis="calendar", **kw):
    runs, rows = crawls(spark, seen, n, **kw)
    c = P.complete_runs(runs)
    out = P.with_labels(P.observations(c, rows), c, horizon, basis).collect()
    return {(r["source_id"], r["run_index"]): r["y"] for r in out}


def by_loop(seen, n, horizon):
    out = {}
    for p, own in seen.items():
        gone = next((i for i in range(min(own), n - 1) if i not in own and i + 1 not in own), None)
        for i in own:
            y = None
            if n - 1 >= i + horizon:
                y = 1 if gone is not None and gone <= i + horizon else 0 if max(own) >= i + horizon else None
            out[p, i] = y
    return out


def test_attrition_case(spark):
    got = labels(spark, {"s": range(6), "g2": range(2), "g3": range(3), "g4": range(4), "g5": range(5)}, 6, 1)
    assert {i for (_, i), y in got.items() if y == 1} == {1, 2, 3}
    assert max(i for (_, i), y in got.items() if y is not None) == 4
    assert got["g5", 4] is None


def test_one_absence_is_no_removal_and_two_are_even_after_return(spark):
    got = labels(spark, {"one": [0, 2, 3, 4, 5], "two": [0, 3, 4, 5, 6], "all": range(7)}, 7, 1)
    assert got["one", 0] == 0 and got["one", 2] == 0
    assert got["two", 0] == 1 and got["two", 4] == 1  # gone once counts for later rows as well


def test_random_maps_agree_with_the_loop(spark):
    rng = random.Random(5)
    seen = {f"p{k}": sorted(rng.sample(range(12), rng.randint(1, 11))) for k in range(40)}
    for h in (1, 3):
        assert labels(spark, seen, 12, h) == by_loop({k: list(v) for k, v in seen.items()}, 12, h)


def test_clock_drift_matters_only_on_the_instant_basis(spark):
    seen = {"a": [0, 1, 2, 3], "b": [0, 1]}
    late = lambda i: -30 * i
    assert labels(spark, seen, 4, 1, jitter=late)["a", 2] == 0
    assert labels(spark, seen, 4, 1, "instant", jitter=late)["a", 2] is None


def test_incomplete_and_old_runs_are_left_out(spark):
    rows = [(0, "b", START, "ok", 1), (1, "b", START, "partial", 2), (2, "b", START + dt.timedelta(days=1), "ok", 2)]
    runs = spark.createDataFrame(rows, "id long, source string, started_at timestamp, status string, rules_version long")
    assert [(r["run_id"], r["run_index"]) for r in P.complete_runs(runs).collect()] == [(2, 0)]


def test_guard_refuses_a_log_behind(spark):
    runs, rows = crawls(spark, {"a": [0, 1]}, 3)
    with pytest.raises(P.SnapshotLogBehind):
        P.assemble(runs, rows.withColumn("title", F.lit("x")), None, 1)


def test_nearest_fetch(spark):
    t = START
    rows = spark.createDataFrame([("a", t), ("b", t), ("c", t)], "source_id string, t timestamp")
    m = lambda k: t + dt.timedelta(minutes=k)
    fetched = [("a", m(-15), "edge"), ("a", m(-16), "out"), ("b", m(5), "late"), ("b", m(-5), "early"), ("c", m(20), "far")]
    archive = spark.createDataFrame(fetched, "source_id string, fetched_at timestamp, what string")
    got = {r["source_id"]: r["what"] for r in P.attach_nearest(rows, archive).collect()}
    assert got == {"a": "edge", "b": "early", "c": None}
