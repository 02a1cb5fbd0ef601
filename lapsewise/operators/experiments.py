"""Age ranks, verdicts, serve-time regimes, tuning, run registry and the frozen evaluation."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewise.operators import features, isotonic, metrics, models, waves
from lapsewise.operators.folds import AT_ONCE, side_by_side
from lapsewise.sources.crawls import content_hash
from lapsewise.sources.working import Working

LEAK_FEATURES = ("n_observations_total", "days_on_board_total")


# ---- age as a ranking ---------------------------------------------------------------------------------------------


def by_age(rows: DataFrame, oldest_first: bool) -> DataFrame:
    """rows with score: age, or its negative; an unknown age is the oldest."""
    age = F.coalesce(F.col("age_days"), F.lit(float("inf")))
    return rows.withColumn("score", age if oldest_first else -age)


def age_rank(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, n, positives, base_rate, and average precision of ranking by age both ways."""
    old = metrics.ranking(metrics.distinct_scores(by_age(rows, True), *keys), *keys)
    young = metrics.ranking(metrics.distinct_scores(by_age(rows, False), *keys), *keys).select(*keys, F.col("pr_auc").alias("youngest_first"))
    out = old.select(*keys, "n", "positives", "base_rate", F.col("pr_auc").alias("oldest_first"))
    return out.join(young, list(keys)) if keys else out.join(F.broadcast(young), F.lit(True))


def rolling_age_rank(rows: DataFrame, embargo: float) -> DataFrame:
    """Age rank of the validation block of the latest legal cut of each val_end."""
    cuts = Working(rows.sparkSession, "cuts").table(waves.latest_cut_per_val_end(waves.feasible_cuts(rows, embargo)))  # few rows, asked for twice
    at = waves.seconds("t")
    labelled = rows.where("label_observable")
    # instants are matched with cuts, both few; the rows, summed by instant and age, then join by their instant
    inside = labelled.select("t").distinct().join(cuts, (at > waves.seconds("train_end") + embargo) & (at <= waves.seconds("val_end"))).select("t", "val_end")
    return age_rank(labelled.select("t", "age_days", "y").join(inside, "t"), "val_end")


def rank_verdict(ranks: DataFrame) -> DataFrame:
    """ranks plus status: whether either direction beats the base rate by more than 0.01 and more than the rate itself."""
    lift = F.greatest("oldest_first", "youngest_first") - F.col("base_rate")
    return ranks.withColumn("lift", lift).withColumn("status", F.when(F.col("lift").isNull(), "undefined").when(F.col("lift") < F.greatest(F.lit(0.01), F.col("base_rate")), "no rank").otherwise("age ranks"))


def cohort_verdict(rates: DataFrame) -> DataFrame:
    """One row from rates by cohort (cohort, rows, positives, rate): ratio of entrants to incumbents and status."""
    pick = lambda cohort, c: F.max(F.when(F.col("cohort") == cohort, F.col(c)))
    out = rates.agg(pick("entrant", "rate").alias("entrant_rate"), pick("incumbent", "rate").alias("incumbent_rate"), F.try_divide(pick("entrant", "positives").cast("double"), F.sum("positives")).alias("entrant_share"))
    out = out.withColumn("ratio", F.try_divide("entrant_rate", "incumbent_rate"))
    apart = (F.col("ratio") >= 10) | ((F.col("entrant_share") >= 0.9) & (F.col("incumbent_rate") <= 0.1))
    return out.withColumn("status", F.when(F.coalesce(apart, F.lit(False)), "cohorts differ").otherwise("cohorts alike"))


def lifespan_caveat(verdict: DataFrame) -> DataFrame:
    return verdict.withColumn("caveat", F.coalesce(F.col("brief_rate") >= 10 * F.col("settled_rate"), F.lit(False)))


# ---- folds and regimes --------------------------------------------------------------------------------------------


def unseen_fold_rows(rows: DataFrame, folds: DataFrame, embargo: float) -> DataFrame:
    """Validation rows of each fold whose posting has no training row in that fold."""
    val = rows.join(waves.fold_instants(rows, folds, embargo).where("part = 'val'"), "t")
    first = rows.groupBy("source", "source_id").agg(F.min("t").alias("_first"))
    return val.join(first, ["source", "source_id"]).where("_first > train_end").drop("_first")


def score_of(model: PipelineModel, rows: DataFrame) -> float | None:
    return metrics.ranking(metrics.distinct_scores(models.scored(model, rows))).first()["pr_auc"]


def serve_time_regime(rows: DataFrame, build: Callable[[], Pipeline]) -> dict[str, float | None]:
    """PR-AUC on validation with board context, and with it nulled at scoring."""
    model, val = models.fit_on_training(rows, build()), rows.where("split = 'val'")
    return {"with_context": score_of(model, val), "context_nulled": score_of(model, features.without_board_context(val))}


def ship_without_context(imputed: float, fold_sd: float, without: float) -> bool:
    """A refit without context ships only if it beats the imputed model by more than the spread of the folds."""
    return imputed + fold_sd < without


def tune(rows: DataFrame, folds: DataFrame, embargo: float, grid: dict[str, Callable[[], object]], at_once: int = AT_ONCE) -> DataFrame:
    """setting, folds, scored, mean, sd over the folds; the first row is the best. All settings and folds are fitted side by side."""
    out = metrics.fold_summary(models.cross_validate(rows, folds, embargo, grid, at_once=at_once), "candidate")
    return out.withColumnRenamed("candidate", "setting").orderBy(F.desc_nulls_last("mean"), "setting")


@dataclass(frozen=True)
class RunSpec:
    """All that a fit follows from, in plain values: it can be written down and fitted again."""

    name: str
    learner: str
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    #: What the learner is set to, by name.
    parameters: tuple[tuple[str, float], ...] = ()
    #: Whether the rows get the lifetime columns, which look ahead.
    leaky: bool = False
    #: Whether this is the run after such a column was taken out again.
    removed: bool = False

    def canonical(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def read(text: str) -> RunSpec:
        found = json.loads(text)
        return RunSpec(**found | {"numeric": tuple(found["numeric"]), "categorical": tuple(found["categorical"]), "parameters": tuple((k, v) for k, v in found["parameters"])})

    def build(self) -> object:
        return LEARNERS[self.learner](self, dict(self.parameters))

    def rows(self, rows: DataFrame) -> DataFrame:
        return models.with_lifetime_probe(rows) if self.leaky else rows


#: What a specification can name; each takes the specification and its parameters.
LEARNERS: dict[str, Callable[[RunSpec, dict[str, float]], object]] = {
    "rates": lambda s, p: models.GroupRates(F.col(s.categorical[0])),
    "bins": lambda s, p: models.QuantileRates(s.numeric[0], int(p.get("bins", 10))),
    "logistic": lambda s, p: models.pipeline(list(s.numeric), list(s.categorical), models.ExactLogistic(p.get("ridge", 0.01), bool(p.get("balanced", 0)))),
    "tree": lambda s, p: models.pipeline(list(s.numeric), list(s.categorical), models.tree()),
    "forest": lambda s, p: models.pipeline(list(s.numeric), list(s.categorical), models.forest(int(p.get("trees", 300)))),
    "boosted": lambda s, p: models.boosted_pipeline(list(s.numeric), list(s.categorical), rounds=int(p.get("rounds", 400))),
}


def execute(rows: DataFrame, specs: list[RunSpec], at_once: int = AT_ONCE) -> DataFrame:
    """run, spec, data_hash, leaky, removed, n, positives, pr_auc, roc_auc of each specification, fitted on train and scored on val, side by side.

    spec is the specification as canonical text, data_hash a hash of the contents of the rows that it was fitted and
    scored on: together they say all that replay needs. Give a stored table.
    """

    def job(spec: RunSpec) -> Callable[[], tuple]:
        def run() -> tuple:
            own = spec.rows(rows.drop("score"))
            used = [c for c in (*spec.numeric, *spec.categorical) if c in own.columns]
            found = content_hash(own.where("split in ('train', 'val')").select("split", "source", "source_id", "t", "y", *used)).first()["content_hash"]
            model = spec.build().fit(models.target(own.where("split = 'train'")))
            ap = metrics.ranking(metrics.distinct_scores(models.scored(model, own.where("split = 'val'")))).first()
            return spec.name, spec.canonical(), str(found), spec.leaky, spec.removed, ap["n"], ap["positives"], ap["pr_auc"], ap["roc_auc"]

        return run

    done = side_by_side(rows.sparkSession, {s.name: job(s) for s in specs}, at_once)
    return rows.sparkSession.createDataFrame(list(done.values()), "run string, spec string, data_hash string, leaky boolean, removed boolean, n long, positives long, pr_auc double, roc_auc double")


def replay(rows: DataFrame, recorded: DataFrame, within: float = 1e-9, at_once: int = AT_ONCE) -> DataFrame:
    """run, same_data, pr_auc as recorded and as replayed, and replayed: each recorded run fitted again from its written specification alone.

    replayed is false where the rows are not those of the record, or the figure is off by more than within.
    """
    specs = [RunSpec.read(r["spec"]) for r in recorded.select("spec").collect()]  # a row for each run of an experiment
    again = execute(rows, specs, at_once).select("run", F.col("data_hash").alias("_hash"), F.col("pr_auc").alias("replayed_pr_auc"))
    met = recorded.join(again, "run", "left")
    same = F.col("data_hash") == F.col("_hash")
    close = (F.abs(F.col("pr_auc") - F.col("replayed_pr_auc")) <= within) | (F.col("pr_auc").isNull() & F.col("replayed_pr_auc").isNull())
    return met.select("run", same.alias("same_data"), "pr_auc", "replayed_pr_auc", (same & F.coalesce(close, F.lit(False))).alias("replayed"))


def leak_specs(honest: RunSpec, probe: str = LEAK_FEATURES[0]) -> list[RunSpec]:
    """The leak off, on and off again: honest, the same learner on a lifetime column, and honest once more after its removal."""
    leaked = replace(honest, name=f"{honest.name} leaked", numeric=(probe, *honest.numeric[1:]), leaky=True)
    return [honest, leaked, replace(honest, name=f"{honest.name} removed", removed=True)]


def leak_delta(runs: DataFrame) -> DataFrame:
    """honest, leaked and inflation; with a column removed (the leak taken out again), also that figure and what it restored."""
    removed = F.col("removed") if "removed" in runs.columns else F.lit(False)
    mean = lambda on: F.avg(F.when(on, F.col("pr_auc")))
    out = runs.agg(mean(~F.col("leaky") & ~removed).alias("honest"), mean(F.col("leaky")).alias("leaked"), mean(~F.col("leaky") & removed).alias("after_removal"))
    return out.withColumn("inflation", F.col("leaked") - F.col("honest")).withColumn("restored", F.col("leaked") - F.col("after_removal"))


def margin_over_heuristics(results: DataFrame, heuristics: list[str]) -> DataFrame:
    """best fitted rung, best heuristic and the margin between them, from (rung, pr_auc)."""
    simple: Column = F.col("rung").isin(*heuristics)
    pick = lambda on: F.max_by(F.when(on, F.col("rung")), F.when(on, F.col("pr_auc")))
    best = lambda on: F.max(F.when(on, F.col("pr_auc")))
    out = results.agg(pick(~simple).alias("best_fitted"), best(~simple).alias("fitted_pr_auc"), pick(simple).alias("best_heuristic"), best(simple).alias("heuristic_pr_auc"))
    return out.withColumn("margin", F.col("fitted_pr_auc") - F.col("heuristic_pr_auc"))


def complexity_reading(results: DataFrame, heuristics: list[str], complexity: dict[str, int], spread: float) -> DataFrame:
    """margin_over_heuristics plus the simplest fitted rung within spread of the best, and what that says."""
    level = F.create_map(*[F.lit(x) for name, n in complexity.items() for x in (name, n)])
    best = margin_over_heuristics(results, heuristics)
    near = results.where(~F.col("rung").isin(*heuristics)).join(best, F.col("pr_auc") >= F.col("fitted_pr_auc") - spread)
    simplest = near.agg(F.min_by("rung", F.struct(level[F.col("rung")], F.col("rung"))).alias("simplest"))
    status = F.when(F.col("margin") <= spread, "heuristics suffice").when(F.col("simplest") == F.col("best_fitted"), "complexity pays").otherwise("simpler model suffices")
    return best.join(simplest, F.lit(True)).withColumn("status", status)


def board_context_folds(rows: DataFrame, folds: DataFrame, embargo: float, build: Callable[[], object], at_once: int = AT_ONCE) -> DataFrame:
    """fold, with_context, context_nulled, difference: PR-AUC of one fit a fold, scored on rows as they are and without board context."""
    views = {"with_context": lambda df: df, "context_nulled": features.without_board_context}
    long = models.cross_validate(rows, folds, embargo, {"": build}, views, at_once)
    out = long.groupBy("fold").agg(*[F.max(F.when(F.col("view") == v, F.col("pr_auc"))).alias(v) for v in views])
    return out.withColumn("difference", F.col("with_context") - F.col("context_nulled"))


# ---- frozen evaluation --------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Frozen:
    model: object
    threshold: float
    recalibrated: bool
    overall: DataFrame
    by_source: DataFrame
    intervals: DataFrame
    slices: DataFrame


#: Slices of the test block by columns that the rows may carry.
SLICES = {"carry_over": "seen_in_train", "cohort": "cohort", "first_observation": "first_observation"}


def sliced(rows: DataFrame, threshold: float) -> DataFrame:
    """slice, value, n, positives, base_rate, pr_auc, roc_auc, tp, fp of the scored rows by each slice there is: one pass over the rows for all."""
    each = [F.struct(F.lit(name).alias("slice"), F.col(c).cast("string").alias("value")) for name, c in SLICES.items() if c in rows.columns]
    if not each:
        return rows.sparkSession.createDataFrame([], "slice string, value string, n long, positives long, base_rate double, pr_auc double, roc_auc double, tp long, fp long")
    table = metrics.distinct_scores(rows.select("y", "score", F.explode(F.array(*each)).alias("x")).select("y", "score", "x.*"), "slice", "value")
    on = F.col("score") >= threshold
    hit = table.groupBy("slice", "value").agg(F.sum(F.when(on, F.col("pos")).otherwise(0)).cast("long").alias("tp"), F.sum(F.when(on, F.col("n") - F.col("pos")).otherwise(0)).cast("long").alias("fp"))
    return metrics.ranking(table, "slice", "value").join(hit, ["slice", "value"]).select("slice", "value", "n", "positives", "base_rate", "pr_auc", "roc_auc", "tp", "fp")


def freeze(rows: DataFrame, build: Callable[[], object], budget: int = 20, days: int = 1, resamples: int = 500, blocks: tuple[str, ...] = ("train",), recalibrate: bool | None = None) -> Frozen:
    """Fits on the blocks (train, or train and val), recalibrates and sets the threshold on val, then scores the test block once. Refuses leaky columns.

    recalibrate: whether to; by default as the validation block asks for.
    """
    if leaky := sorted(set(LEAK_FEATURES) & set(rows.columns)):
        raise ValueError(f"leaky columns in a frozen evaluation: {leaky}")
    model = build().fit(models.target(rows.where(F.col("split").isin(*blocks)).drop("score")))
    val, test = (models.scored(model, rows.where(f"split = '{s}'")) for s in ("val", "test"))
    if recalibrate is None:
        figures = metrics.ranking(metrics.distinct_scores(val)).first()
        recalibrate = models.needs_recalibration(figures["positives"], metrics.calibration_error(val).first()["ece"], figures["base_rate"])
    if recalibrate:
        blocks_of = isotonic.fit(val)
        val, test = (isotonic.calibrated(blocks_of, x).drop("score").withColumnRenamed("calibrated", "score") for x in (val, test))
    threshold = metrics.budget_thresholds(metrics.distinct_scores(val), budgets=(budget,), days=days).first()["threshold"]
    boot = metrics.bootstrap(test, resamples, threshold=threshold)
    ci = metrics.intervals(boot, list(metrics.STATISTICS))
    return Frozen(model, threshold, recalibrate, metrics.confusion_at(test, threshold), metrics.evaluate_with_evidence(test, "source", resamples), ci, sliced(test, threshold))
