import random

import numpy as np
import pytest

from lapsewise.operators import quantiles


def test_quantiles_as_numpy_has_them(spark):
    rng = random.Random(3)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, -0.0, 0.0, 1e-9, -5.5, 7.0, rng.gauss(0, 100), 7.0, float(rng.randint(0, 4))]), float(i)) for i in range(500)] + [("c", 3.0, None)]
    df = spark.createDataFrame(data, "k string, x double, z double")
    at = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r["k"], r["feature"]): r for r in quantiles.exact_quantiles(df, ["x", "z"], at, "k").collect()}
    assert ("c", "z") not in got and got["c", "x"]["q"] == [3.0] * 6
    for key in ("a", "b", None):
        for i, c in ((1, "x"), (2, "z")):
            values = [r[i] for r in data if r[0] == key and r[i] is not None]
            assert got[key, c]["n"] == len(values) and got[key, c]["q"] == pytest.approx(list(np.quantile(values, at)))
    assert quantiles.exact_quantiles(df.limit(0), ["x"], at).count() == 0
    plan = quantiles.exact_quantiles(df, ["x"], at)._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "Cartesian" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_cut_values(spark):
    data = [1.0] * 50 + [2.0] * 10 + [3.0] * 40
    df = spark.createDataFrame([(x, None) for x in data], "x double, none double")
    assert [tuple(r) for r in quantiles.cut_values(df, ["x", "none"], 10).collect()] == [("x", [1.0, 2.0, 3.0])]
    assert quantiles.cut_values(df, ["x"], 2).first()["edges"] == [1.0]
