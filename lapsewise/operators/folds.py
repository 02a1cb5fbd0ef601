"""Candidates fitted on folds side by side.

Fold membership is a table of intervals of instants: a fold trains on rows up to train_end and validates on those after
val_after and up to val_until. No row is copied into a fold; each fold reads its rows with two bounds on t, which reach
the scan of a stored table. Each (candidate, fold) is an independent job with a fair-scheduler pool of its own name, so
that the tail of one fold's stages leaves no core idle while others wait; a pool of threads in the driver submits them.
(Pools share cores in turn where the context was started with spark.scheduler.mode=FAIR; otherwise they fill what the
first leaves free.) What comes back to the driver is one row for each candidate and fold.

Baselines that look at the rows by one column alone say so (counted_by): the rows are counted by instant, that column
and y, once for all folds and all candidates on it, and the folds read the counts (Counts). So can fits beside the folds.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewise.operators import metrics, waves
from lapsewise.sources.working import Working

#: Jobs that are under way at once.
AT_ONCE = 8
View = Callable[[DataFrame], DataFrame]
#: How many rows a counted row stands for.
WEIGHT = "_weight"


def side_by_side(spark: SparkSession, jobs: Mapping[Any, Callable[[], Any]], at_once: int = AT_ONCE) -> dict[Any, Any]:
    """The results of jobs by name, run at most at_once at a time, each in a scheduler pool of its own. The first failure is raised."""
    sc = spark.sparkContext

    def run(name: Any) -> Any:
        found: list[Any] = []

        def job() -> None:
            sc.setLocalProperty("spark.scheduler.pool", str(name))
            try:
                found.append((jobs[name](), None))
            except BaseException as e:  # handed to the caller's thread
                found.append((None, e))

        thread = InheritableThread(target=job)
        thread.start()
        thread.join()
        out, failure = found[0]
        if failure is not None:
            raise failure
        return out

    with ThreadPoolExecutor(max(1, at_once)) as pool:
        return dict(zip(jobs, pool.map(run, jobs), strict=True))


def membership(rows: DataFrame, folds: DataFrame, embargo: float) -> DataFrame:
    """fold, train_end, val_after, val_until, and rows and positives of both parts: one row for each fold, few as crawls are.

    Counts come from the rows of each instant, which are summed up to each bound.
    """
    at = waves.instants(rows).select(waves.seconds("t").alias("at"), "n", "pos")
    bounds = folds.select("fold", waves.seconds("train_end").alias("train_end"), (waves.seconds("train_end") + embargo).alias("val_after"), waves.seconds("val_start").alias("val_until"))
    asked = bounds.select("fold", F.explode(F.array(*[F.struct(F.lit(name).alias("bound"), F.col(name).alias("until")) for name in ("train_end", "val_after", "val_until")])).alias("x")).select("fold", "x.*")
    sums = waves.sums_up_to(at, asked)
    at_bound = lambda name, what: F.max(F.when(F.col("bound") == name, F.col(what)))
    wide = sums.groupBy("fold").agg(*[at_bound(name, what).alias(f"{name}_{what}") for name in ("train_end", "val_after", "val_until") for what in ("n", "pos")])
    out = bounds.join(wide, "fold")
    for what, name in (("n", "rows"), ("pos", "positives")):
        out = out.withColumn(f"train_{name}", F.col(f"train_end_{what}")).withColumn(f"val_{name}", F.col(f"val_until_{what}") - F.col(f"val_after_{what}"))
    return out.select("fold", "train_end", "val_after", "val_until", "train_rows", "train_positives", "val_rows", "val_positives")


def within(after: float | None, until: float) -> Column:
    """t in (after, until], with bounds in seconds, as comparisons of t itself, so that they reach the scan."""
    moment = lambda x: F.lit(None).cast("timestamp") if x is None else F.timestamp_micros(F.lit(round(x * 1_000_000)))
    upto = F.col("t") <= moment(until)
    return upto if after is None else (F.col("t") > moment(after)) & upto


def counted(rows: DataFrame, name: str, by: Column, *keep: str) -> DataFrame:
    """keep (t at least), name, y and how many rows have them."""
    return rows.groupBy("t", *keep, by.alias(name), "y").agg(F.count("*").alias(WEIGHT))


class Counts:
    """The rows of a job counted for each column that its candidates go by, once and when first asked for; keep are columns wanted besides t and y."""

    def __init__(self, rows: DataFrame, *keep: str):
        self.rows, self.keep, self.work = rows, keep, Working(rows.sparkSession, "counted")
        self.tables: dict[tuple[str, str], DataFrame] = {}

    def source(self, build: Callable[[], Any]) -> tuple[DataFrame, Callable[[], Any], str | None]:
        """What a candidate reads, what it fits, and the column of weights: the rows themselves, unless it goes by one column."""
        model = build()
        if not hasattr(model, "counted_by"):
            return self.rows, build, None
        name, by = model.counted_by()
        if (name, str(by)) not in self.tables:
            self.tables[name, str(by)] = self.work.table(counted(self.rows, name, by, *self.keep))
        return self.tables[name, str(by)], lambda: build().on_counts(), WEIGHT

    def drop(self) -> None:
        self.work.drop_all_but()


def cross_validate(rows: DataFrame, folds: DataFrame, embargo: float, candidates: Mapping[str, Callable[[], Any]], score: Callable[[Any, DataFrame], DataFrame], views: Mapping[str, View] | None = None, at_once: int = AT_ONCE, counts: Counts | None = None) -> DataFrame:
    """candidate, fold, view, rows and positives of both parts, pr_auc and roc_auc: each candidate is fitted once on each fold.

    candidates build something whose fit(training rows) gives a model, score adds the score of a model to rows. views
    are what is done to the validation rows before they are scored (by default nothing): all views share one fit. A
    fold whose training rows are of one class, or which has no validation rows, is not fitted and has null figures.
    rows are read once for every fold: give a stored table. Without views, candidates with counted_by read the counts:
    those given, which keep label_observable and which the caller drops, or the job's own.
    """
    plain = not views
    views = views or {"as it is": lambda df: df}
    labelled = rows.where("label_observable")
    plan = [r.asDict() for r in membership(labelled, folds, embargo).orderBy("fold").collect()]
    kept = {r["fold"]: r for r in plan}

    own = Counts(labelled) if plain and counts is None else None

    def source(build: Callable[[], Any]) -> tuple[DataFrame, Callable[[], Any], str | None]:
        if not plain:
            return labelled, build, None
        base, fitted, weight = (own or counts).source(build)
        return base if own else base.where("label_observable"), fitted, weight

    def job(base: DataFrame, build: Callable[[], Any], weight: str | None, f: dict[str, Any]) -> Callable[[], dict[str, tuple[float | None, float | None]]]:
        def run() -> dict[str, tuple[float | None, float | None]]:
            model = build().fit(base.where(within(None, f["train_end"])).drop("score"))
            val = base.where(within(f["val_after"], f["val_until"]))
            tagged = [metrics.distinct_scores(score(model, view(val)), weight=weight).withColumn("view", F.lit(name)) for name, view in views.items()]
            table = tagged[0]
            for other in tagged[1:]:
                table = table.unionByName(other)
            return {r["view"]: (r["pr_auc"], r["roc_auc"]) for r in metrics.ranking(table, "view").collect()}

        return run

    fit = [f for f in plan if 0 < f["train_positives"] < f["train_rows"] and f["val_rows"]]
    read = {name: source(build) for name, build in candidates.items()} if fit else {}
    done = side_by_side(rows.sparkSession, {(name, f["fold"]): job(*read[name], f) for name in read for f in fit}, at_once)
    if own:
        own.drop()
    out = []
    for name in candidates:
        for f in kept.values():
            got = done.get((name, f["fold"]), {})
            out += [(name, f["fold"], view, f["train_rows"], f["train_positives"], f["val_rows"], f["val_positives"], *got.get(view, (None, None))) for view in views]
    return rows.sparkSession.createDataFrame(out, "candidate string, fold long, view string, train_rows long, train_positives long, val_rows long, val_positives long, pr_auc double, roc_auc double")
