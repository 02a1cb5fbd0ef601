"""Fold-fitted preprocessing, baselines, a ladder of pyspark.ml models, selection, transfer and recalibration."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable
from copy import copy
from dataclasses import dataclass

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewise.functions.derive import older_than_thirty_days, posted_this_week
from lapsewise.operators import folds as folding
from lapsewise.operators import isotonic, metrics, quantiles
from lapsewise.operators.boosting import BoostedModel, BoostedTrees
from lapsewise.operators.features import without_board_context
from lapsewise.operators.logistic import ExactLogistic, LogisticModel

MIN_FREQUENCY = 5
MISSING = "__missing__"
#: Recalibrate from this many positives, if the error exceeds this share of the base rate.
LEAST_POSITIVES, ERROR_SHARE = 30, 0.25


# ---- baselines ----------------------------------------------------------------------------------------------------


def mean_y(rows: DataFrame) -> Column:
    """Mean of y; of counted rows, each as often as it stands for."""
    if folding.WEIGHT not in rows.columns:
        return F.avg(F.col("y").cast("double"))
    w = F.when(F.col("y").isNotNull(), F.col(folding.WEIGHT))
    return F.try_divide(F.sum(F.col("y") * w).cast("double"), F.sum(w))


class GroupRates:
    """Mean of y by a column expression on the training rows, the pooled mean elsewhere."""

    def __init__(self, key: Column):
        self.key = key

    def counted_by(self) -> tuple[str, Column]:
        return "_key", self.key

    def on_counts(self) -> GroupRates:
        out = copy(self)
        out.key = F.col("_key")
        return out

    def fit(self, rows: DataFrame) -> GroupRates:
        self.rates = rows.groupBy(self.key.alias("_k")).agg(mean_y(rows).alias("_rate"))
        self.pooled = rows.agg(mean_y(rows).alias("_pooled"))
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        out = rows.drop("score").withColumn("_k", self.key).join(F.broadcast(self.pooled), F.lit(True)).join(self.rates, "_k", "left")
        return out.withColumn("score", F.coalesce("_rate", "_pooled")).drop("_k", "_rate", "_pooled")


class QuantileRates:
    """Rates in ten quantile bins of one feature, outer bins open, nulls a bin of their own."""

    def __init__(self, column: str, bins: int = 10):
        self.column, self.bins = column, bins

    def counted_by(self) -> tuple[str, Column]:
        return self.column, F.col(f"`{self.column}`")

    def on_counts(self) -> QuantileRates:
        return self

    def fit(self, rows: DataFrame) -> QuantileRates:
        weight = folding.WEIGHT if folding.WEIGHT in rows.columns else None
        found = quantiles.exact_quantiles(rows, [self.column], [i / self.bins for i in range(1, self.bins)], weight=weight).first()
        self.edges = sorted(set(found["q"])) if found else []
        c = F.col(self.column)
        self.inner = GroupRates(F.when(c.isNull(), -1).otherwise(sum((F.when(c > e, 1).otherwise(0) for e in self.edges), F.lit(0)))).fit(rows)
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        return self.inner.predict(rows)


def company_volume(train: DataFrame) -> DataFrame:
    """company, volume: distinct postings by company, each counted under its first company."""
    one = train.groupBy("source", "source_id").agg(F.min("company").alias("company"))
    return one.groupBy("company").agg(F.count("*").alias("volume"))


def with_company_volume(rows: DataFrame, volume: DataFrame) -> DataFrame:
    out = rows.join(volume, "company", "left")
    return out.withColumn("company_posting_volume", F.coalesce("volume", F.lit(0)).cast("double")).drop("volume")


def with_lifetime_probe(panel: DataFrame) -> DataFrame:
    """Counts over the whole life of a posting: a leak by design, for probes only."""
    per = panel.groupBy("source", "source_id").agg(F.count("*").alias("n_observations_total"), ((F.unix_micros(F.max("t")) - F.unix_micros(F.min("t"))) / 86_400_000_000).alias("days_on_board_total"))
    return panel.join(per, ["source", "source_id"])


# ---- preprocessing ------------------------------------------------------------------------------------------------


def numeric_statistics(train: DataFrame, columns: list[str], fills: dict[str, float] | None = None) -> DataFrame:
    """feature, fill, mean, sd: exact median (0 if all null), mean and population deviation after filling (1 if zero).

    The median comes by rank search; what filling does to mean and deviation follows from the counts, without another
    pass over filled rows.
    """
    given = F.create_map(*[F.lit(x) for c, v in (fills or {}).items() for x in (c, float(v))]) if fills else None
    each = [F.struct(F.lit(c).alias("feature"), F.count(c).alias("n"), F.avg(F.col(c).cast("double")).alias("m"), F.var_pop(F.col(c).cast("double")).alias("v")) for c in columns]
    wide = train.agg(F.count("*").alias("rows"), F.array(*each).alias("s"))
    stats = wide.select("rows", F.explode("s").alias("s")).select("rows", "s.*")
    median = quantiles.exact_quantiles(train, columns, [0.5]).select("feature", F.get("q", F.lit(0)).alias("median"))
    out = stats.join(median, "feature", "left")
    fill = F.coalesce(*([given[F.col("feature")]] if fills else []), F.col("median"), F.lit(0.0))
    none = F.col("rows") - F.col("n")
    out = out.select("feature", fill.alias("fill"), "rows", "n", none.alias("none"), F.coalesce("m", F.lit(0.0)).alias("m"), F.coalesce("v", F.lit(0.0)).alias("v"))
    out = out.withColumn("mean", (F.col("n") * F.col("m") + F.col("none") * F.col("fill")) / F.col("rows"))
    off = lambda c: (F.col(c) - F.col("mean")) * (F.col(c) - F.col("mean"))
    sd = F.sqrt((F.col("n") * (F.col("v") + off("m")) + F.col("none") * off("fill")) / F.col("rows"))
    return out.select("feature", "fill", "mean", F.when(sd > 0, sd).otherwise(1.0).alias("sd"))


def one_hot(place: Column, slots: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.when(i == place, 1.0).otherwise(0.0))


class PrepareModel(Model):
    """Fills, standardises and one-hot encodes with what the training rows taught.

    Levels are joined as a dictionary, one join a column however many there are; the place found is spread into the
    slots of the column by one expression.
    """

    def __init__(self, numeric: dict[str, tuple[float, float, float]], levels: dict[str, list[str]], rare: dict[str, bool]):
        super().__init__()
        self.numeric, self.levels, self.rare = numeric, levels, rare

    @property
    def width(self) -> int:
        return len(self.numeric) + sum(len(x) + self.rare[c] for c, x in self.levels.items())

    def _transform(self, df: DataFrame) -> DataFrame:
        parts = [F.array(*[((F.coalesce(F.col(c).cast("double"), F.lit(fill)) - mean) / sd).cast("double") for c, (fill, mean, sd) in self.numeric.items()]).cast("array<double>")]
        out, added = df, []
        for k, (c, levels) in enumerate(self.levels.items()):
            slots = len(levels) + self.rare[c]
            if not slots:
                continue
            place = F.lit(len(levels))  # the shared bucket, if there is one
            if levels:
                words = df.sparkSession.createDataFrame([(x, i) for i, x in enumerate(levels)], f"_level{k} string, _place{k} int")
                out = out.withColumn(f"_level{k}", F.coalesce(F.col(c).cast("string"), F.lit(MISSING))).join(words, f"_level{k}", "left")
                added += [f"_level{k}", f"_place{k}"]
                place = F.coalesce(f"_place{k}", place)
            parts.append(one_hot(place, slots))
        return out.withColumn("features", array_to_vector(F.concat(*parts))).drop(*added)

    def learned(self) -> dict[str, float]:
        return {c: v[0] for c, v in self.numeric.items()}


class Prepare(Estimator):
    """Learns fills, means, deviations and levels (those seen MIN_FREQUENCY times; the rest share a bucket if there is any).

    The levels of a column come to the driver: as many as the vector that is asked for has slots.
    """

    def __init__(self, numeric: list[str], categorical: list[str], fills: dict[str, float] | None = None):
        super().__init__()
        self.numeric, self.categorical, self.fills = numeric, categorical, fills or {}

    def _fit(self, df: DataFrame) -> PrepareModel:
        stats = {r["feature"]: (r["fill"], r["mean"], r["sd"]) for r in numeric_statistics(df, self.numeric, self.fills).collect()} if self.numeric else {}
        levels, rare = {c: [] for c in self.categorical}, dict.fromkeys(self.categorical, False)
        if self.categorical:  # all columns in one pass
            each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("v")) for c in self.categorical]))
            counts = df.select(each.alias("x")).groupBy("x.c", "x.v").agg(F.count("*").alias("n"))
            kept = F.when(F.col("n") >= MIN_FREQUENCY, F.col("v"))
            for r in counts.groupBy("c").agg(F.sort_array(F.collect_set(kept)).alias("levels"), F.count_if(F.col("n") < MIN_FREQUENCY).alias("rare")).collect():
                levels[r["c"]], rare[r["c"]] = list(r["levels"]), r["rare"] > 0
        return PrepareModel({c: stats[c] for c in self.numeric}, levels, rare)


class Derive(Transformer):
    """A row-local transformer from any DataFrame function."""

    def __init__(self, f: Callable[[DataFrame], DataFrame]):
        super().__init__()
        self.f = f

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.f(df)


class RoundedModel(Model):
    def __init__(self, inner: Model, digits: int):
        super().__init__()
        self.inner, self.digits = inner, digits

    def _transform(self, df: DataFrame) -> DataFrame:
        p = F.round(F.get(vector_to_array("probability"), F.lit(1)), self.digits)
        return self.inner.transform(df).withColumn("probability", array_to_vector(F.array(1 - p, p)))


class Rounded(Estimator):
    """Another estimator, its probabilities rounded: rows that differ by the order of a sum stay tied."""

    def __init__(self, inner: Estimator, digits: int = 12):
        super().__init__()
        self.inner, self.digits = inner, digits

    def _fit(self, df: DataFrame) -> RoundedModel:
        return RoundedModel(self.inner.fit(df), self.digits)


def pipeline(numeric: list[str], categorical: list[str], model: Estimator, derive: Callable[[DataFrame], DataFrame] | None = None) -> Pipeline:
    return Pipeline(stages=[*([Derive(derive)] if derive else []), Prepare(numeric, categorical), model])


def logistic() -> Estimator:
    """Ridge logistic regression to exact convergence."""
    return ExactLogistic()


def tree() -> Estimator:
    return DecisionTreeClassifier(labelCol="y", maxDepth=5, minInstancesPerNode=20, seed=0)


def forest(trees: int = 300) -> Estimator:
    return RandomForestClassifier(labelCol="y", numTrees=trees, minInstancesPerNode=5, seed=0)


def target(rows: DataFrame) -> DataFrame:
    """rows with y as double; refuses rows without a label."""
    if not rows.where("y is null").isEmpty():
        raise ValueError("rows without a label cannot be a target")
    return rows.withColumn("y", F.col("y").cast("double"))


def fit_on_training(rows: DataFrame, built: Pipeline, blocks: tuple[str, ...] = ("train",)) -> PipelineModel:
    """Fits on the training block, which it picks itself, or on the union of several blocks."""
    return built.fit(target(rows.where(F.col("split").isin(*blocks)).drop("score")))


def fit_and_score(rows: DataFrame, built: Pipeline, budget: int = 20, days: int = 1) -> DataFrame:
    """split, the whole record of the fit on train and on val, and gap: train's PR-AUC over val's."""
    model = fit_on_training(rows, built)
    out = metrics.evaluate(predict(model, rows.where("split in ('train', 'val')")), "split", budget=budget, days=days)
    gap = out.agg((F.max(F.when(F.col("split") == "train", F.col("pr_auc"))) - F.max(F.when(F.col("split") == "val", F.col("pr_auc")))).alias("gap"))
    return out.join(gap, F.lit(True))


#: Fitted stages that are written as JSON.
OWN = {"logistic": LogisticModel, "boosted": BoostedModel}


def save(model: PipelineModel, path: str) -> None:
    """Stages in order, each in a folder of its own; those of this library as JSON lines, others by their own writers. A Derive holds code and is not saved."""
    spark = SparkSession.active()
    kept = [s for s in model.stages if not isinstance(s, Derive)]
    names = {kind: name for name, kind in OWN.items()}
    kinds = [(i, "prepare" if isinstance(s, PrepareModel) else names.get(type(s)) or f"{type(s).__module__}.{type(s).__name__}") for i, s in enumerate(kept)]
    spark.createDataFrame(kinds, "place int, kind string").coalesce(1).write.mode("overwrite").json(f"{path}/stages")
    for i, s in enumerate(kept):
        text = json.dumps({"numeric": s.numeric, "levels": s.levels, "rare": s.rare}) if isinstance(s, PrepareModel) else s.to_json() if type(s) in names else None
        if text is None:
            s.write().overwrite().save(f"{path}/stage-{i}")
        else:
            spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/stage-{i}")


def load(spark: SparkSession, path: str, derive: Callable[[DataFrame], DataFrame] | None = None) -> PipelineModel:
    """What save wrote, behind derive if one is given: ready for predict in any session."""
    stages: list = [Derive(derive)] if derive else []
    for r in spark.read.schema("place int, kind string").json(f"{path}/stages").orderBy("place").collect():
        at = f"{path}/stage-{r['place']}"
        if r["kind"] == "prepare":
            found = json.loads(spark.read.text(at).first()[0])
            stages.append(PrepareModel({c: tuple(v) for c, v in found["numeric"].items()}, found["levels"], found["rare"]))
        elif r["kind"] in OWN:
            stages.append(OWN[r["kind"]].from_json(spark.read.text(at).first()[0]))
        else:
            module, _, name = r["kind"].rpartition(".")
            stages.append(getattr(importlib.import_module(module), name).load(at))
    return PipelineModel(stages)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    out = model.transform(rows.drop("score"))
    return out.withColumn("score", F.get(vector_to_array("probability"), F.lit(1))).drop("features", "rawPrediction", "probability", "prediction")


def scored(model: object, rows: DataFrame) -> DataFrame:
    """rows with the score of a fitted pipeline, or of a baseline, which brings its own predict."""
    return predict(model, rows) if isinstance(model, PipelineModel) else model.predict(rows)


@dataclass(frozen=True)
class Rung:
    """One step of the ladder: what it fits, and how complex it is; heuristics are rates of the training rows."""

    complexity: int
    heuristic: bool
    build: Callable[[], object]


def boosted_pipeline(numeric: list[str], categorical: list[str], **settings: object) -> Pipeline:
    """Boosted trees bin the columns themselves: no fills, no one-hot slots."""
    return Pipeline(stages=[BoostedTrees(numeric, categorical, **settings)])


def rungs(numeric: list[str], categorical: list[str], age: str = "age_days", board: str = "source", trees: int = 300, rounds: int = 400) -> dict[str, Rung]:
    """The ten rungs, from the base rate up."""
    fitted = lambda model, n=numeric, c=categorical: lambda: pipeline(n, c, model())
    return {
        "prior": Rung(0, True, lambda: GroupRates(F.lit(1))),
        "rule_old": Rung(1, True, lambda: GroupRates(older_than_thirty_days(F.col(age)))),
        "rule_fresh": Rung(1, True, lambda: GroupRates(posted_this_week(F.col(age)))),
        "age_ceiling": Rung(2, True, lambda: QuantileRates(age)),
        "board_hazard": Rung(2, True, lambda: GroupRates(F.col(board))),
        "age_logistic": Rung(3, False, fitted(logistic, [age], [])),
        "logistic": Rung(4, False, fitted(logistic)),
        "tree": Rung(5, False, fitted(tree)),
        "forest": Rung(6, False, fitted(lambda: forest(trees))),
        "boosted": Rung(7, False, lambda: boosted_pipeline(numeric, categorical, rounds=rounds)),
    }


def ladder(rows: DataFrame, steps: dict[str, Rung], at_once: int = folding.AT_ONCE, counts: folding.Counts | None = None) -> DataFrame:
    """rung, n, positives, pr_auc, roc_auc on the validation block, the rungs fitted side by side. Give a stored table.

    Rungs that go by one column read the counts of the rows, if there are any (with split kept).
    """

    def blocks(base: DataFrame) -> tuple[DataFrame, DataFrame]:
        return base.where("split = 'val'"), target(base.where("split = 'train'").drop("score"))

    def job(val: DataFrame, train: DataFrame, build: Callable[[], object], weight: str | None) -> Callable[[], tuple]:
        def run() -> tuple:
            found = metrics.ranking(metrics.distinct_scores(scored(build().fit(train), val), weight=weight)).first()
            return found["n"], found["positives"], found["pr_auc"], found["roc_auc"]

        return run

    read = {name: counts.source(step.build) if counts else (rows, step.build, None) for name, step in steps.items()}
    cut: dict[int, tuple[DataFrame, DataFrame]] = {}
    for base, _, _ in read.values():
        if id(base) not in cut:
            cut[id(base)] = blocks(base)
    done = folding.side_by_side(rows.sparkSession, {name: job(*cut[id(base)], build, weight) for name, (base, build, weight) in read.items()}, at_once)
    return rows.sparkSession.createDataFrame([(name, *x) for name, x in done.items()], "rung string, n long, positives long, pr_auc double, roc_auc double")


# ---- cross-validation and selection -------------------------------------------------------------------------------


def cross_validate(rows: DataFrame, folds: DataFrame, embargo: float, candidates: dict[str, Callable[[], object]], views: dict[str, Callable[[DataFrame], DataFrame]] | None = None, at_once: int = folding.AT_ONCE, counts: folding.Counts | None = None) -> DataFrame:
    """candidate, fold, view, sizes, pr_auc and roc_auc of each candidate on each fold: see folds.cross_validate."""
    return folding.cross_validate(rows, folds, embargo, candidates, scored, views, at_once, counts)


def compare(rows: DataFrame, folds: DataFrame, embargo: float, candidates: dict[str, Callable[[], object]], at_once: int = folding.AT_ONCE) -> DataFrame:
    """candidate, folds, scored, mean, sd over the folds, and pr_auc and roc_auc of one fit on train, scored on val. rows carry split.

    Folds and the one fit read the same counts.
    """
    counts = folding.Counts(rows, "split", "label_observable")
    over = metrics.fold_summary(cross_validate(rows, folds, embargo, candidates, at_once=at_once, counts=counts), "candidate")
    once = ladder(rows, {name: Rung(0, False, build) for name, build in candidates.items()}, at_once, counts)
    counts.drop()
    return over.join(once.select(F.col("rung").alias("candidate"), "pr_auc", "roc_auc"), "candidate")


@dataclass(frozen=True)
class Candidate:
    name: str
    complexity: int
    heuristic: bool
    scores: dict[int, float | None]


def select(candidates: list[Candidate], least_folds: int = 3) -> dict[str, object]:
    """The simplest candidate tied with the leader, if it clears the best heuristic by more than the spread; else the heuristic."""
    import statistics

    def usable(c: Candidate) -> list[float]:
        return [v for v in c.scores.values() if v is not None]

    def paired(a: Candidate, b: Candidate) -> tuple[float, float]:
        d = [a.scores[f] - b.scores[f] for f in a.scores if a.scores[f] is not None and b.scores.get(f) is not None]
        return (statistics.fmean(d), statistics.stdev(d) if len(d) > 1 else 0.0) if d else (0.0, 0.0)

    fitted = [c for c in candidates if not c.heuristic and len(usable(c)) >= least_folds]
    heuristics = [c for c in candidates if c.heuristic and len(usable(c)) >= least_folds]
    if not fitted:
        return {"selected": None, "reason": "too few folds"}
    leader = max(fitted, key=lambda c: statistics.fmean(usable(c)))
    tied = [c for c in fitted if c is leader or abs(paired(leader, c)[0]) <= paired(leader, c)[1]]
    simplest = min(tied, key=lambda c: (c.complexity, c.name))
    if heuristics:
        floor = max(heuristics, key=lambda c: statistics.fmean(usable(c)))
        mean, sd = paired(simplest, floor)
        if mean <= sd:
            return {"selected": floor.name, "reason": "no model clears the best heuristic", "leader": leader.name}
    return {"selected": simplest.name, "reason": "simplest of those tied with the leader", "leader": leader.name}


def chosen(per_fold: DataFrame, steps: dict[str, Rung], least_folds: int = 3) -> dict[str, object]:
    """What select says of a table (candidate, fold, pr_auc), which has a row for each candidate and fold."""
    found: dict[str, dict[int, float | None]] = {name: {} for name in steps}
    for r in per_fold.where(F.col("candidate").isin(*steps)).select("candidate", "fold", "pr_auc").collect():
        found[r["candidate"]][r["fold"]] = r["pr_auc"]
    return select([Candidate(name, s.complexity, s.heuristic, found[name]) for name, s in steps.items()], least_folds)


def ablate(rows: DataFrame, numeric: list[str], categorical: list[str], groups: dict[str, list[str]] | None = None, build: Callable[[], Estimator] = logistic, at_once: int = folding.AT_ONCE) -> DataFrame:
    """dropped, pr_auc, delta against all features, and reading, of a fit without each group (by default each feature alone), side by side.

    A group whose loss is hardly felt (a delta under 0.001 either way) is redundant: the others say the same.
    """
    parts = groups or {x: [x] for x in numeric + categorical}
    without = lambda gone: ([f for f in numeric if f not in gone], [f for f in categorical if f not in gone])
    steps = {name: Rung(0, False, lambda n=n, c=c: pipeline(n, c, build())) for name, (n, c) in {"": (numeric, categorical), **{name: without(gone) for name, gone in parts.items()}}.items() if n or c}
    found = ladder(rows, steps, at_once)
    full = found.where("rung = ''").select(F.col("pr_auc").alias("_full"))
    delta = F.col("pr_auc") - F.col("_full")
    reading = F.when(F.col("rung") == "", "all features").when(delta.isNull(), "undefined").when(F.abs(delta) < 0.001, "redundant").when(delta < 0, "carries signal").otherwise("costs precision")
    return found.join(F.broadcast(full), F.lit(True)).select(F.when(F.col("rung") != "", F.col("rung")).alias("dropped"), "pr_auc", delta.alias("delta"), reading.alias("reading"))


def sweep(rows: DataFrame, settings: dict[str, Callable[[], object]], at_once: int = folding.AT_ONCE) -> DataFrame:
    """setting, train_pr_auc, val_pr_auc, gap of one fit for each setting, side by side."""
    train = target(rows.where("split = 'train'").drop("score"))

    def job(build: Callable[[], object]) -> Callable[[], dict[str, float | None]]:
        def run() -> dict[str, float | None]:
            found = scored(build().fit(train), rows.where("split in ('train', 'val')"))
            return {r["split"]: r["pr_auc"] for r in metrics.ranking(metrics.distinct_scores(found, "split"), "split").collect()}

        return run

    done = folding.side_by_side(rows.sparkSession, {name: job(build) for name, build in settings.items()}, at_once)
    out = rows.sparkSession.createDataFrame([(name, x.get("train"), x.get("val")) for name, x in done.items()], "setting string, train_pr_auc double, val_pr_auc double")
    return out.withColumn("gap", F.col("train_pr_auc") - F.col("val_pr_auc"))


def transfer_sizes(rows: DataFrame, key: str, least_positives: int, least_share: float) -> DataFrame:
    """board, eval_rows, eval_positives, train_share and fit: whether a board has enough positives, leaves enough behind and is in both blocks."""
    val, train, hit = F.col("split") == "val", F.col("split") == "train", F.col("y") == 1
    sizes = rows.groupBy(F.col(key).alias("board")).agg(F.count_if(val).alias("eval_rows"), F.count_if(val & hit).alias("eval_positives"), F.count_if(train).alias("_rows"), F.count_if(train & hit).alias("_own"))
    all_ = sizes.agg(F.sum("_own").alias("_all"))
    out = sizes.join(F.broadcast(all_), F.lit(True)).withColumn("train_share", F.coalesce(F.try_divide((F.col("_all") - F.col("_own")).cast("double"), "_all"), F.lit(0.0)))
    fit = (F.col("eval_positives") >= least_positives) & (F.col("train_share") >= least_share) & (F.col("eval_rows") > 0) & (F.col("_rows") > 0)
    return out.select("board", "eval_rows", "eval_positives", "train_share", fit.alias("fit"))


def leave_one_group_out(rows: DataFrame, key: str, build: Callable[[], object], least_positives: int = 10, least_share: float = 0.6, serve_time: bool = False, at_once: int = folding.AT_ONCE) -> DataFrame:
    """Per board with enough positives: PR-AUC of a model that never saw it (transfer) and of one that did (ceiling), for any model.

    A fit for each board, side by side; where the model is a table of rates, group_rates_transfer needs one pass for
    all. serve_time has the transfer model score without board context, as a new board would be served.
    """
    sizes = transfer_sizes(rows, key, least_positives, least_share)
    boards = [r["board"] for r in sizes.where("fit").orderBy("board").collect()]
    train = lambda df: target(df.where("split = 'train'").drop("score"))
    full = build().fit(train(rows)) if boards else None

    def job(board: object) -> Callable[[], tuple]:
        def run() -> tuple:
            own = rows.where((F.col(key) == board) & (F.col("split") == "val"))
            ap = lambda m, on: metrics.ranking(metrics.distinct_scores(scored(m, on))).first()["pr_auc"]
            return ap(build().fit(train(rows.where(F.col(key) != board))), without_board_context(own) if serve_time else own), ap(full, own)

        return run

    done = folding.side_by_side(rows.sparkSession, {b: job(b) for b in boards}, at_once)
    table = rows.sparkSession.createDataFrame([(b, *x) for b, x in done.items()], f"board {rows.schema[key].dataType.simpleString()}, transfer_pr_auc double, ceiling_pr_auc double")
    return sizes.drop("fit").join(table, "board", "left")


def group_rates_transfer(rows: DataFrame, key: str, by: Column, least_positives: int = 10, least_share: float = 0.6) -> DataFrame:
    """The same table for rates by any expression: what a board leaves behind is the total minus its own, so one pass fits all boards.

    The sums of (group, board) are the whole fit; validation rows, too, count only by group, as rows of a group share
    a score. No board is fitted by itself, and no row is read twice.
    """
    sums = rows.where("split in ('train', 'val')").groupBy("split", F.col(key).alias("board"), by.alias("g")).agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("p"))
    train, val = (sums.where(F.col("split") == s).drop("split") for s in ("train", "val"))
    groups = train.groupBy("g").agg(F.sum("n").alias("gn"), F.sum("p").alias("gp"))
    whole = train.agg(F.sum("n").alias("an"), F.sum("p").alias("ap"))
    boards = train.groupBy("board").agg(F.sum("n").alias("bn"), F.sum("p").alias("bp"))
    same = lambda other, *keys: [F.col(k).eqNullSafe(F.col(f"{other}_{k}")) for k in keys]
    named = lambda df, other, *keys: df.withColumnsRenamed({k: f"{other}_{k}" for k in keys})
    own = named(train.withColumnsRenamed({"n": "on", "p": "op"}), "own", "board", "g")
    met = val.join(named(groups, "all", "g"), same("all", "g"), "left").join(own, same("own", "board", "g"), "left").join(named(boards, "b", "board"), same("b", "board"), "left").join(F.broadcast(whole), F.lit(True))
    none = F.lit(0).cast("long")
    less = lambda total, part: F.coalesce(F.col(total), none) - F.coalesce(F.col(part), none)
    rate = lambda p, n: F.try_divide(p.cast("double"), n)
    transfer = F.coalesce(rate(less("gp", "op"), less("gn", "on")), rate(less("ap", "bp"), less("an", "bn")))
    ceiling = F.coalesce(rate(F.col("gp"), F.col("gn")), rate(F.col("ap"), F.col("an")))
    both = F.explode(F.array(F.struct(F.lit("transfer").alias("kind"), transfer.alias("score")), F.struct(F.lit("ceiling").alias("kind"), ceiling.alias("score"))))
    table = met.select("board", "n", "p", both.alias("x")).groupBy("board", "x.kind", "x.score").agg(F.sum("n").alias("n"), F.sum("p").alias("pos"))
    ap = metrics.ranking(table, "board", "kind").groupBy("board").agg(*[F.max(F.when(F.col("kind") == k, F.col("pr_auc"))).alias(f"{k}_pr_auc") for k in ("transfer", "ceiling")])
    sizes = transfer_sizes(rows, key, least_positives, least_share)
    only = lambda c: F.when(F.col("fit"), F.col(c)).alias(c)
    return sizes.join(ap, "board", "left").select("board", "eval_rows", "eval_positives", "train_share", only("transfer_pr_auc"), only("ceiling_pr_auc"))


def assess_transfer(folds: DataFrame) -> DataFrame:
    """boards, mean_gap, sd_gap, mean_lift, status of a transfer table."""
    scored = folds.where("transfer_pr_auc is not null").withColumn("gap", F.col("ceiling_pr_auc") - F.col("transfer_pr_auc")).withColumn("lift", F.col("transfer_pr_auc") - F.col("eval_positives") / F.col("eval_rows"))
    out = scored.agg(F.count("*").alias("boards"), F.avg("gap").alias("mean_gap"), F.stddev_samp("gap").alias("sd_gap"), F.avg("lift").alias("mean_lift"))
    status = F.when(F.col("boards") < 2, "unmeasured").when(F.col("mean_lift") <= 0, "collapsed").when(F.abs("mean_gap") <= F.col("sd_gap"), "intact").when(F.col("mean_gap") > 0, "board-specific").otherwise("reversed")
    return out.withColumn("status", status)


# ---- calibration --------------------------------------------------------------------------------------------------


def needs_recalibration(positives: int, error: float | None, base_rate: float | None) -> bool:
    return positives >= LEAST_POSITIVES and error is not None and base_rate is not None and error > ERROR_SHARE * base_rate


def recalibrate(validation: DataFrame, rows: DataFrame) -> DataFrame:
    """rows plus calibrated: isotonic regression of y on score, fitted on the validation block."""
    return isotonic.calibrated(isotonic.fit(validation), rows)


def recalibrated_if_needed(validation: DataFrame, rows: DataFrame) -> tuple[DataFrame, bool]:
    """rows with calibrated, which is the score itself where the validation block does not ask for more, and whether it did."""
    figures = metrics.ranking(metrics.distinct_scores(validation)).first()
    needed = needs_recalibration(figures["positives"] or 0, metrics.calibration_error(validation).first()["ece"], figures["base_rate"])
    return (recalibrate(validation, rows) if needed else rows.withColumn("calibrated", F.col("score"))), needed


def fingerprint(rows: DataFrame, numeric: list[str], categorical: list[str], target: str = "source") -> DataFrame:
    """accuracy and macro_f1 of predicting the board from the features, fitted on train, scored on val."""
    labels = [r[0] for r in rows.select(target).distinct().orderBy(target).collect()]
    index = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(target)).cast("double") - 1
    marked = rows.drop("score").withColumn("y", index)
    model = Pipeline(stages=[Prepare(numeric, categorical), RandomForestClassifier(labelCol="y", numTrees=50, seed=0)]).fit(marked.where("split = 'train'"))
    out = model.transform(marked.where("split = 'val'"))
    return metrics.class_scores(out.select(F.col("y").alias("actual"), F.col("prediction").alias("predicted")))
