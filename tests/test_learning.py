"""Fits that SQL states only on one table: checked here by hand, by brute force, or by doing the same in another way."""

import datetime as dt
import random
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapsewise.operators import experiments, folds, isotonic, models, waves
from lapsewise.operators.boosting import BoostedModel, BoostedTrees
from lapsewise.operators.logistic import ExactLogistic

T0 = dt.datetime(2026, 9, 1)
DAY = 86_400.0


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(11)
    data = []
    for w in range(12):
        for k in range(40):
            age, title = float(rng.randint(0, 60)), f"t{rng.randint(0, 3)}"
            p = 0.15 + 0.5 * (age > 30) + (0.2 if title == "t1" else 0.0)
            y = 0 if w < 2 else int(rng.random() < p)
            data.append((f"b{k % 4}", f"p{k}", T0 + dt.timedelta(days=w), w, y, True, age if k % 9 else None, title, w % 3 == 0, "train" if w < 7 else "val" if w < 10 else "test", float(k % 5)))
    out = spark.createDataFrame(data, "source string, source_id string, t timestamp, run_index long, y int, label_observable boolean, age_days double, title string, seen_in_train boolean, split string, board_size_at_t double")
    return out.cache()


def age_rates():
    return models.QuantileRates("age_days", 4)


# ---- folds --------------------------------------------------------------------------------------------------------


def test_folds_by_hand_and_a_fold_of_one_class(rows):
    table = waves.fold_table(rows, DAY)
    got = {r["fold"]: r for r in models.cross_validate(rows, table, DAY, {"ages": age_rates}).collect()}
    assert len(got) == 10
    # the first two waves have no positives: nothing to learn
    assert got[0]["pr_auc"] is None and got[1]["pr_auc"] is None and got[0]["train_positives"] == 0
    for fold in (2, 7):
        end = T0 + dt.timedelta(days=fold)
        train, val = rows.where(F.col("t") <= F.lit(end)), rows.where(F.col("t") == F.lit(end + dt.timedelta(days=2)))
        by_hand = experiments.score_of(age_rates().fit(train), val)
        assert got[fold]["pr_auc"] == pytest.approx(by_hand) and got[fold]["train_rows"] == 40 * (fold + 1) and got[fold]["val_rows"] == 40


def test_jobs_run_side_by_side(spark):
    under_way, most, lock = [0], [0], threading.Lock()

    def job():
        with lock:
            under_way[0] += 1
            most[0] = max(most[0], under_way[0])
        time.sleep(0.4)
        n = spark.range(1000).count()
        with lock:
            under_way[0] -= 1
        return n, spark.sparkContext.getLocalProperty("spark.scheduler.pool")

    began = time.time()
    done = folds.side_by_side(spark, {k: job for k in range(8)}, at_once=4)
    assert [done[k] for k in range(8)] == [(1000, str(k)) for k in range(8)] and most[0] == 4 and time.time() - began < 8 * 0.4 + 4
    with pytest.raises(ZeroDivisionError):
        folds.side_by_side(spark, {"bad": lambda: 1 // 0})


def test_bounds_reach_the_scan(spark, rows, tmp_path):
    rows.write.parquet(str(tmp_path / "rows"))
    plan = spark.read.parquet(str(tmp_path / "rows")).where(folds.within(1e9, 2e9))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(t," in plan and "LessThanOrEqual(t," in plan


def test_context_folds_share_a_fit(rows):
    fits = []

    class Counting(models.GroupRates):
        def fit(self, df):
            fits.append(1)
            return super().fit(df)

    table = waves.fold_table(rows, DAY)
    out = experiments.board_context_folds(rows, table, DAY, lambda: Counting(F.col("board_size_at_t"))).collect()
    scored = [r for r in out if r["with_context"] is not None]
    assert len(fits) == len(scored) == 8 and all(r["difference"] == pytest.approx(r["with_context"] - r["context_nulled"]) for r in scored)


def test_tuning_and_selection_from_a_fold_table(spark, rows):
    table = waves.fold_table(rows, DAY)
    grid = {f"{n}": lambda n=n: models.QuantileRates("age_days", n) for n in (2, 4)}
    got = experiments.tune(rows, table, DAY, grid).collect()
    assert [r["scored"] for r in got] == [8, 8] and got[0]["mean"] >= got[1]["mean"]
    steps = {"prior": models.Rung(0, True, lambda: models.GroupRates(F.lit(1))), "ages": models.Rung(2, False, age_rates)}
    found = models.chosen(models.cross_validate(rows, table, DAY, {n: s.build for n, s in steps.items()}), steps)
    assert found["selected"] == "ages"


def test_folds_of_baselines_read_counts(spark, rows):
    read = []

    class Ages(models.QuantileRates):
        def fit(self, df):
            read.append((set(df.columns), df.count()))
            return super().fit(df)

    class Titles(models.GroupRates):
        def fit(self, df):
            read.append((set(df.columns), df.count()))
            return super().fit(df)

    many = rows.unionByName(rows).unionByName(rows)  # three of each row: the counts stay as many
    table = waves.fold_table(many, DAY).where("fold % 3 = 0")
    builds = {"4": lambda: Ages("age_days", 4), "titles": lambda: Titles(F.col("title"))}
    got = models.cross_validate(many, table, DAY, builds, at_once=2).orderBy("candidate", "fold").collect()
    assert read and all("_weight" in columns and "source_id" not in columns for columns, _ in read)
    assert max(n for _, n in read) <= rows.count()
    # the same figures from the rows themselves, which a view asks for
    plain = models.cross_validate(many, table, DAY, builds, {"as it is": lambda df: df}, at_once=2).orderBy("candidate", "fold").collect()
    assert [tuple(r)[:-2] for r in got] == [tuple(r)[:-2] for r in plain] and len(got) == 2 * len({r["fold"] for r in got})
    for a, b in zip(got, plain):
        for c in ("pr_auc", "roc_auc"):
            assert a[c] is None and b[c] is None or a[c] == pytest.approx(b[c], abs=1e-12)


def test_compare_fits_once_on_the_counts_of_the_folds(spark, rows):
    read = []

    class Ages(models.QuantileRates):
        def fit(self, df):
            read.append(("_weight" in df.columns, df.count()))
            return super().fit(df)

    class Titles(models.GroupRates):
        def fit(self, df):
            read.append(("_weight" in df.columns, df.count()))
            return super().fit(df)

    unknown = rows.where("split = 'val' and age_days > 40").withColumn("label_observable", F.lit(False)).withColumn("y", F.lit(None).cast("int"))
    many = rows.unionByName(rows).unionByName(rows).unionByName(unknown)
    table = waves.fold_table(rows, DAY).where("fold % 4 = 0")
    builds = {"4": lambda: Ages("age_days", 4), "titles": lambda: Titles(F.col("title"))}
    got = {r["candidate"]: r for r in models.compare(many, table, DAY, builds, at_once=2).collect()}
    assert len(read) > 2 and all(weighed for weighed, _ in read) and max(n for _, n in read) <= rows.count()
    # the same figures from the rows themselves
    plain = {r["rung"]: r for r in models.ladder(many, {n: models.Rung(0, False, b) for n, b in builds.items()}).collect()}
    folded = models.cross_validate(many, table, DAY, builds, {"as it is": lambda df: df}, at_once=2).groupBy("candidate").agg(F.avg("pr_auc").alias("mean"), F.count("pr_auc").alias("scored")).collect()
    assert set(got) == set(plain) == {r["candidate"] for r in folded}
    for r in folded:
        a = got[r["candidate"]]
        assert a["scored"] == r["scored"] and a["mean"] == pytest.approx(r["mean"], abs=1e-12)
        for c in ("pr_auc", "roc_auc"):
            assert a[c] == pytest.approx(plain[r["candidate"]][c], abs=1e-12)


# ---- logistic regression ------------------------------------------------------------------------------------------


def test_logistic_is_the_optimum_whatever_the_partitions(rows):
    train = models.target(rows.where("split = 'train'"))
    ready = models.Prepare(["age_days"], ["title"]).fit(train)
    fit = lambda df, **s: ExactLogistic(**s).fit(ready.transform(df))
    a, b = fit(train), fit(train.repartition(7))
    assert np.abs(np.array(a.weights) - np.array(b.weights)).max() < 1e-9
    from pyspark.ml.functions import vector_to_array

    got = ready.transform(train).select(vector_to_array("features").alias("x"), "y").collect()
    x, y, w = np.array([[1.0, *r["x"]] for r in got]), np.array([r["y"] for r in got]), np.array(a.weights)
    assert x.shape[1] == ready.width + 1
    p = 1 / (1 + np.exp(-x @ w))
    slope = x.T @ (p - y) / len(y) + 0.01 * np.concatenate([[0], w[1:]])
    assert np.abs(slope).max() < 1e-10
    heavy = fit(train, balanced=True)
    mean = models.predict(models.PipelineModel([ready, heavy]), train).agg(F.avg("score")).first()[0]
    assert 0.35 < mean < 0.65


def test_unseen_and_rare_levels(spark, rows):
    train = models.target(rows.where("split = 'train'")).unionByName(models.target(rows.limit(1)).withColumn("title", F.lit("once")))
    ready = models.Prepare(["age_days"], ["title", "source"]).fit(train)
    assert ready.levels["title"] == ["t0", "t1", "t2", "t3"] and ready.rare == {"title": True, "source": False}
    from pyspark.ml.functions import vector_to_array

    odd = rows.limit(1).select("age_days", F.lit("never seen").alias("title"), F.lit("never seen").alias("source"))
    assert ready.transform(odd).select(vector_to_array("features").alias("x")).first()["x"][1:] == [0.0, 0.0, 0.0, 0.0, 1.0] + [0.0] * 4
    plan = ready.transform(rows)._jdf.queryExecution().executedPlan().toString()
    assert "never" not in plan and plan.count("CASE WHEN") < 12  # levels are rows of a table, not expressions


# ---- boosted trees ------------------------------------------------------------------------------------------------


def boosted(df, **settings):
    return BoostedTrees(["age_days"], ["title"], **({"rounds": 12, "depth": 3, "rate": 0.3, "bins": 16, "every": 5} | settings)).fit(df)


def test_boosting_is_deterministic_and_learns(rows):
    train = models.target(rows.where("split = 'train'"))
    a, b = boosted(train), boosted(train.repartition(9))
    assert a.to_json() == b.to_json() and a.to_json() != boosted(train, seed=1).to_json()
    val = rows.where("split = 'val'")
    assert experiments.score_of(models.PipelineModel([a]), val) > 1.2 * experiments.score_of(models.GroupRates(F.lit(1)).fit(train), val)
    assert BoostedModel.from_json(a.to_json()).trees == a.trees


def test_boosting_on_levels_never_seen_and_nulls(spark, rows):
    model = models.PipelineModel([boosted(models.target(rows.where("split = 'train'")))])
    odd = spark.createDataFrame([(50.0, "never"), (50.0, "also never"), (None, "t1"), (float("nan"), "t1"), (None, None)], "age_days double, title string")
    scores = [r["score"] for r in models.predict(model, odd).collect()]
    assert scores[0] == scores[1] and scores[2] == scores[3] and all(0 < s < 1 for s in scores)


def test_boosting_refuses_one_class(rows):
    with pytest.raises(ValueError):
        boosted(models.target(rows.where("y = 0")))


def test_newton_leaf_by_hand(spark):
    df = spark.createDataFrame([("a", str(i), 0.0, "x", float(i < 3)) for i in range(10)], "source string, source_id string, age_days double, title string, y double").withColumn("t", F.lit(T0))
    model = boosted(df, rounds=1, subsample=1.0, positive_weight=1.0, rate=0.5)
    # one value of each feature: a single leaf, at which gradient is nought, as the base is the log odds
    assert model.base == pytest.approx(np.log(3 / 7)) and not model.trees[0].splits and model.trees[0].leaves[1] == pytest.approx(0, abs=1e-5)


# ---- isotonic fit -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [3, 8, 100_000])
def test_isotonic_by_the_max_min_formula(spark, size):
    rng = random.Random(size)
    data = [(rng.choice([-0.5, 0.0, rng.random(), rng.randint(0, 30) / 30]), int(rng.random() < 0.4)) for _ in range(200)] + [(0.9 + k / 1000, 0) for k in range(30)]
    df = spark.createDataFrame(data, "score double, y int")
    blocks = isotonic.fit(df, size).orderBy("lo").collect()
    x = sorted({s for s, _ in data})
    n, p = [sum(s == v for s, _ in data) for v in x], [sum(y for s, y in data if s == v) for v in x]
    cn, cp = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(p)])
    want = [max(min((cp[b + 1] - cp[a]) / (cn[b + 1] - cn[a]) for b in range(i, len(x))) for a in range(i + 1)) for i in range(len(x))]
    value = lambda v: next(b["value"] for b in blocks if b["lo"] <= v <= b["hi"])
    assert [value(v) for v in x] == pytest.approx(want)
    asked = [-9.0, 9.0, 0.123456, 0.5, x[0], x[-1]] + [rng.random() for _ in range(40)]
    got = isotonic.calibrated(isotonic.fit(df, size), spark.createDataFrame([(v,) for v in asked] + [(None,)], "score double")).collect()
    ends = sorted((b[c], b["value"]) for b in blocks for c in ("lo", "hi"))
    assert [r["calibrated"] for r in got if r["score"] is not None] == pytest.approx([float(np.interp(r["score"], [e[0] for e in ends], [e[1] for e in ends])) for r in got if r["score"] is not None])
    assert len(got) == len(asked) + 1 and [r for r in got if r["score"] is None][0]["calibrated"] is None


# ---- transfer, ablation, runs, saving -----------------------------------------------------------------------------


def test_transfer_by_subtraction_is_a_fit_for_each_board(rows):
    build = lambda: models.GroupRates(F.col("title"))
    one_pass = {r["board"]: r for r in models.group_rates_transfer(rows, "source", F.col("title"), 3).collect()}
    each = {r["board"]: r for r in models.leave_one_group_out(rows, "source", build, 3).collect()}
    assert set(one_pass) == set(each) and any(r["transfer_pr_auc"] is not None for r in each.values())
    for b, r in each.items():
        for c in ("eval_rows", "eval_positives", "train_share", "transfer_pr_auc", "ceiling_pr_auc"):
            assert one_pass[b][c] == pytest.approx(r[c]), (b, c)
    refused = models.group_rates_transfer(rows, "source", F.col("title"), 10**6).collect()
    assert {r["transfer_pr_auc"] for r in refused} == {None}


def test_ablation_by_groups(rows):
    got = {r["dropped"]: r for r in models.ablate(rows, ["age_days", "board_size_at_t"], ["title"], {"age": ["age_days"], "the rest": ["board_size_at_t", "title"]}).collect()}
    assert set(got) == {None, "age", "the rest"} and got[None]["delta"] == 0 and got["age"]["delta"] < -0.01 and got["age"]["reading"] == "carries signal"
    alone = models.ablate(rows, ["age_days"], ["title"])
    assert {r["dropped"] for r in alone.collect()} == {None, "age_days", "title"}


def test_replay_finds_other_rows_and_other_figures(spark, rows):
    specs = experiments.leak_specs(experiments.RunSpec("ages", "bins", ("age_days",), parameters=(("bins", 4.0),)))
    record = experiments.execute(rows, specs)
    assert [experiments.RunSpec.read(r["spec"]) for r in record.orderBy("run").collect()] == sorted(specs, key=lambda s: s.name)
    assert {r["replayed"] for r in experiments.replay(rows.repartition(5), record).collect()} == {True}
    fewer = experiments.replay(rows.where("source_id <> 'p3'"), record).collect()
    assert {(r["same_data"], r["replayed"]) for r in fewer} == {(False, False)}
    off = experiments.replay(rows, record.withColumn("pr_auc", F.col("pr_auc") + 0.01)).collect()
    assert {(r["same_data"], r["replayed"]) for r in off} == {(True, False)}
    delta = experiments.leak_delta(record).first()
    assert delta["honest"] == delta["after_removal"] and delta["inflation"] == pytest.approx(delta["restored"])


def test_frozen_evaluation_decides_and_slices(rows):
    build = lambda: models.pipeline(["age_days"], [], models.logistic())
    f = experiments.freeze(rows, build, resamples=5)
    assert isinstance(f.recalibrated, bool) and {r["slice"] for r in f.slices.collect()} == {"carry_over"}
    both = f.slices.agg(F.sum("n"), F.sum("tp"), F.sum("fp")).first()
    whole = f.overall.first()
    assert both[0] == 80 and (both[1], both[2]) == (whole["tp"], whole["fp"])
    assert experiments.freeze(rows, build, resamples=5, recalibrate=True).recalibrated
    with pytest.raises(ValueError):
        experiments.freeze(rows.withColumn("n_observations_total", F.lit(1)), build)


def test_saved_pipelines_score_alike(spark, rows, tmp_path):
    train, val = models.target(rows.where("split = 'train'")), rows.where("split = 'val'")
    built = {"logistic": models.pipeline(["age_days"], ["title"], models.logistic()), "tree": models.pipeline(["age_days"], ["title"], models.tree()), "boosted": models.boosted_pipeline(["age_days"], ["title"], rounds=2)}
    for name, one in built.items():
        model = one.fit(train)
        models.save(model, str(tmp_path / name))
        again = models.load(spark, str(tmp_path / name))
        key = lambda m: {(r["source"], r["source_id"], r["t"]): r["score"] for r in models.predict(m, val).collect()}
        assert key(model) == pytest.approx(key(again))


def test_ten_rungs(rows):
    steps = models.rungs(["age_days"], ["title"], trees=5, rounds=3)
    got = {r["rung"]: r for r in models.ladder(rows, steps).collect()}
    assert len(got) == 10 and got["prior"]["pr_auc"] == pytest.approx(got["prior"]["positives"] / got["prior"]["n"]) and got["boosted"]["pr_auc"] > got["prior"]["pr_auc"]
