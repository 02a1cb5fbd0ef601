"""Ranking, calibration and budget metrics per group, with clustered bootstrap intervals.

Everything works on the table of distinct scores (group, score, n, pos): rows are aggregated once, and cumulative sums
run over that table within a group. An undefined figure is null, never 0. Weighted tables (n and pos as weights) give
bootstrap replicates without copying rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from lapsewise.operators.quantiles import value_part
from lapsewise.sources.working import Working

BUDGETS = (5, 10, 20, 50, 100)
FRAGILE = 30
#: Inner edges of ten equal bins.
EDGES = tuple(i * 0.1 for i in range(1, 10))


def distinct_scores(rows: DataFrame, *keys: str, weight: str | None = None) -> DataFrame:
    w = F.col(weight) if weight else F.lit(1)
    return rows.groupBy(*keys, "score").agg(F.sum(w).cast("long").alias("n"), F.sum(F.col("y") * w).cast("long").alias("pos"))


def cumulated(table: DataFrame, *keys: str) -> DataFrame:
    """table plus running n and pos from the highest score down, and totals.

    Running sums are taken within parts of the score range and over the sums of the parts, which are few, so that no
    task sorts all scores of a group, or of an ungrouped table.
    """
    table = table.withColumn("_part", value_part(F.col("score")))
    per = table.groupBy(*keys, "_part").agg(F.sum("n").alias("_n"), F.sum("pos").alias("_pos"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    above = w.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    sums = {f"_above_{c}": F.coalesce(F.sum(f"_{c}").over(above), F.lit(0)) for c in ("n", "pos")} | {f"all_{c}": F.sum(f"_{c}").over(w) for c in ("n", "pos")}
    per = per.withColumns(sums).drop("_n", "_pos")
    inside = Window.partitionBy(*keys, "_part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    out = table.withColumns({"cum_n": F.sum("n").over(inside), "cum_pos": F.sum("pos").over(inside)}).join(per, [*keys, "_part"])
    return out.withColumns({"cum_n": F.col("cum_n") + F.col("_above_n"), "cum_pos": F.col("cum_pos") + F.col("_above_pos")}).drop("_part", "_above_n", "_above_pos")


def ranking(table: DataFrame, *keys: str) -> DataFrame:
    """n, positives, base_rate, pr_auc and roc_auc of each group; ties share a step."""
    c = cumulated(table, *keys)
    step = F.try_divide(F.col("pos").cast("double"), "all_pos") * F.try_divide(F.col("cum_pos").cast("double"), "cum_n")
    neg, all_neg = F.col("n") - F.col("pos"), F.col("all_n") - F.col("all_pos")
    # pairs won: each negative loses to the positives above it and shares with those on its score
    won = neg * (F.col("cum_pos") - F.col("pos") + 0.5 * F.col("pos"))
    out = c.withColumn("_ap", step).withColumn("_won", won).withColumn("_neg", all_neg)
    out = out.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("pos").alias("positives"), F.sum("_ap").alias("pr_auc"), F.try_divide(F.sum("_won"), F.max("all_pos") * F.max("_neg")).alias("roc_auc"))
    return out.withColumn("base_rate", F.try_divide(F.col("positives").cast("double"), "n")).withColumn("pr_auc", F.when(F.col("positives") > 0, F.col("pr_auc")))


def brier(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg(F.pow(F.col("score") - F.col("y"), F.lit(2.0))).alias("brier"))


def score_bin(score: Column) -> Column:
    """0 to 9; right-open, the last bin closed."""
    return sum((F.when(score >= e, 1).otherwise(0) for e in EDGES), F.lit(0)).cast("long")


def reliability(rows: DataFrame, *keys: str) -> DataFrame:
    """All ten bins of each group: n, mean score and observed rate (null in an empty bin)."""
    found = rows.groupBy(*keys, score_bin(F.col("score")).alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("predicted"), F.avg(F.col("y").cast("double")).alias("observed"))
    spark = rows.sparkSession
    bins = spark.range(10).select(F.col("id").alias("bin"))
    grid = rows.select(*keys).distinct().join(F.broadcast(bins), F.lit(True)) if keys else bins
    return grid.join(found, [*keys, "bin"], "left").na.fill(0, ["n"])


def calibration_error(rows: DataFrame, *keys: str) -> DataFrame:
    per = rows.groupBy(*keys, score_bin(F.col("score")).alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("p"), F.avg(F.col("y").cast("double")).alias("o"))
    return per.groupBy(*keys).agg((F.sum(F.abs(F.col("p") - F.col("o")) * F.col("n")) / F.sum("n")).alias("ece"))


def calibration_summary(rows: DataFrame, *keys: str) -> DataFrame:
    out = rows.groupBy(*keys).agg(F.avg("score").alias("mean_predicted"), F.avg(F.col("y").cast("double")).alias("observed"))
    out = out.withColumn("gap", F.col("mean_predicted") - F.col("observed"))
    ece = calibration_error(rows, *keys)
    return out.join(ece, list(keys)) if keys else out.join(F.broadcast(ece), F.lit(True))


def alert_budget(n: Column, per_day: Column | int, days: Column | int) -> Column:
    one = F.lit(1)
    day = F.greatest(one, F.lit(days) if isinstance(days, int) else days)
    per = F.lit(per_day) if isinstance(per_day, int) else per_day
    return F.least(n, F.greatest(one, per * day))


def budget_thresholds(table: DataFrame, *keys: str, budgets: tuple[int, ...] = BUDGETS, days: int = 1) -> DataFrame:
    """Threshold and confusion of each budget: the largest score down to which at least k rows lie."""
    spark = table.sparkSession
    asked = spark.createDataFrame([(b,) for b in budgets], "budget long")
    c = cumulated(table, *keys).join(F.broadcast(asked), F.lit(True))
    k = alert_budget(F.col("all_n"), F.col("budget"), days)
    reach = c.where(F.col("cum_n") >= k)
    first = reach.groupBy(*keys, "budget").agg(F.max_by(F.struct("score", "cum_n", "cum_pos", "all_n", "all_pos"), "score").alias("s"))
    return first.select(*keys, "budget", F.col("s.score").alias("threshold"), *_confusion(F.col("s.cum_pos"), F.col("s.cum_n"), F.col("s.all_pos"), F.col("s.all_n")))


def _confusion(hit: Column, flagged: Column, pos: Column, n: Column) -> list[Column]:
    precision, recall = F.try_divide(hit.cast("double"), flagged), F.try_divide(hit.cast("double"), pos)
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return [hit.alias("tp"), (flagged - hit).alias("fp"), (pos - hit).alias("fn"), (n - pos - flagged + hit).alias("tn"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1")]


def confusion_at(rows: DataFrame, threshold: Column | float, *keys: str) -> DataFrame:
    on = F.col("score") >= threshold
    c = rows.groupBy(*keys).agg(F.coalesce(F.sum(F.when(on, F.col("y"))), F.lit(0)).cast("long").alias("h"), F.count_if(on).alias("f"), F.sum("y").cast("long").alias("p"), F.count("*").alias("n"))
    return c.select(*keys, *_confusion(F.col("h"), F.col("f"), F.col("p"), F.col("n")))


def at_budget(rows: DataFrame, *keys: str, budget: int = 20, days: int = 1, tie: tuple[str, ...] = ("source", "source_id", "t")) -> DataFrame:
    """Confusion at the budget's threshold, captured and false alarms a day, lift, NDCG of the flagged rows."""
    table = distinct_scores(rows, *keys)
    at = budget_thresholds(table, *keys, budgets=(budget,), days=days)
    whole = table.groupBy(*keys).agg(F.try_divide(F.sum("pos").cast("double"), F.sum("n")).alias("base_rate"))
    on = list(keys) if keys else F.lit(True)
    one = (lambda df: df) if keys else F.broadcast  # without keys there is one row
    flagged = rows.join(one(at.select(*keys, "threshold")), on).where("score >= threshold")
    place = F.row_number().over((Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(F.desc("score"), *tie))
    gain = flagged.withColumn("_d", 1 / F.log2(place + 1.0)).groupBy(*keys).agg(F.sum(F.col("_d") * F.col("y")).alias("_dcg"), F.sum("y").alias("_hits"))
    ideal = F.aggregate(F.when(F.col("_hits") > 0, F.sequence(F.lit(1), F.col("_hits").cast("int"))), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 1.0))
    gain = gain.select(*keys, F.when(F.col("_hits") > 0, F.col("_dcg") / ideal).alias("ndcg"))
    out = at.join(one(whole), on).join(one(gain), on)
    return out.withColumns({"captured_per_day": F.col("tp") / F.lit(float(max(1, days))), "false_alarms_per_day": F.col("fp") / F.lit(float(max(1, days))), "lift": F.try_divide("precision", "base_rate")})


def evaluate(rows: DataFrame, *keys: str, budget: int = 20, days: int = 1) -> DataFrame:
    """The whole record of each group; the threshold is found inside the group."""
    on = list(keys) if keys else F.lit(True)
    a = ranking(distinct_scores(rows, *keys), *keys).drop("base_rate")
    return a.join(brier(rows, *keys), on).join(at_budget(rows, *keys, budget=budget, days=days), on)


def score_resolution(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count_distinct("score").alias("distinct_scores"))


def numbered_clusters(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, cluster, i (from 0), m: the distinct postings of each group, numbered, and how many there are.

    Clusters are numbered in the order of the first four hex digits of their md5 and then their name: within these
    parts, and over the counts of the parts.
    """
    clusters = rows.select(*keys, F.concat_ws("|", "source", "source_id").alias("cluster")).distinct().withColumn("_part", F.substring(F.md5("cluster"), 1, 4))
    per = clusters.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("_before", before).withColumn("m", F.sum("_n").over(w)).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("cluster")).cast("long") - 1
    clusters = clusters.withColumn("_in", inside).join(per.hint("merge"), [*keys, "_part"])
    return clusters.select(*keys, "cluster", (F.col("_in") + F.col("_before")).alias("i"), "m")


def draws_of(clusters: DataFrame, resamples: int, *keys: str, seed: str = "b") -> DataFrame:
    """keys, b, i: the cluster of every draw of every resample, from md5.

    A stored table of clusters is so small that one task would read it and make all the draws, resamples times as many
    rows; the clusters are dealt out before they draw.
    """
    spark = clusters.sparkSession
    dealt = clusters.select(*keys, F.col("i").alias("draw"), "m").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys, "draw")
    draws = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(resamples - 1).cast("long"))).alias("b"))
    number = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *keys, F.col("b").cast("string"), F.col("draw").cast("string"))), 1, 8), 16, 10).cast("long")
    return draws.select(*keys, "b", F.pmod(number, F.col("m")).alias("i"))


def drawn_clusters(clusters: DataFrame, resamples: int, *keys: str, seed: str = "b") -> DataFrame:
    """keys, b, i, w: how often each numbered cluster is drawn in each resample of its group; draws come from md5.

    There are as many draws as clusters in every resample, so they are dealt by cluster, once, for the count and for the
    join that follows.
    """
    return draws_of(clusters, resamples, *keys, seed=seed).repartition(*keys, "i").groupBy(*keys, "b", "i").agg(F.count("*").alias("w"))


def replicates(rows: DataFrame, resamples: int, *keys: str, seed: str = "b") -> DataFrame:
    """b, cluster, w: how often each posting is drawn in each resample of its group. No row is copied."""
    clusters = numbered_clusters(rows, *keys)
    drawn = drawn_clusters(clusters, resamples, *keys, seed=seed)
    return drawn.join(clusters.select(*keys, "i", "cluster").hint("merge"), [*keys, "i"]).drop("i")


#: Sums that a task holds before it hands them on, and products that it works out at once.
HELD, AT_ONCE = 2_000_000, 2_000_000


def weighted_sums(keys: tuple[str, ...], resamples: int, schema: pa.Schema):
    """Sums of n and pos by group, resample and score of clusters with their draws (b) and their cells (score, c, p).

    A cluster's cells times its draws are added as rows of a matrix with a column for each resample.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[tuple, int] = {}
        sums = np.zeros((2, 0, resamples), np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            names = list(place)
            at, b = np.nonzero(sums[0, : len(names)])
            for i in range(0, len(at), 100_000):
                rows, own = at[i : i + 100_000], b[i : i + 100_000]
                columns = [pa.array([name[j] for name in names], schema.field(c).type).take(pa.array(rows)) for j, c in enumerate((*keys, "score"))]
                yield pa.RecordBatch.from_arrays([*columns[:-1], pa.array(own.astype(np.int64)), columns[-1], pa.array(sums[0, rows, own]), pa.array(sums[1, rows, own])], schema=schema)

        for whole in batches:
            for i in range(0, len(whole), max(1, AT_ONCE // resamples)):
                part = whole.slice(i, max(1, AT_ONCE // resamples))
                drawn, cells = part.column("b"), part.column("cells")
                sizes = lambda x: np.diff(x.offsets.to_numpy())
                weight = np.bincount(np.repeat(np.arange(len(part)), sizes(drawn)) * resamples + drawn.flatten().to_numpy(), minlength=len(part) * resamples).reshape(-1, resamples)
                owner, cell = np.repeat(np.arange(len(part)), sizes(cells)), cells.flatten()
                score = cell.field("score").dictionary_encode("encode")
                group, values = score.indices.to_numpy().astype(np.int64), [score.dictionary.to_pylist()]
                for key in reversed(keys):
                    of = part.column(key).dictionary_encode("encode")
                    group += of.indices.to_numpy()[owner] * math.prod(map(len, values))
                    values.insert(0, of.dictionary.to_pylist())
                order = np.argsort(group, kind="stable")
                group, owner, count = group[order], owner[order], np.stack([cell.field(c).to_numpy()[order] for c in "cp"])
                for j in range(0, len(group), max(1, AT_ONCE // resamples)):
                    some = slice(j, j + max(1, AT_ONCE // resamples))
                    first = np.flatnonzero(np.concatenate([[True], group[some][1:] != group[some][:-1]]))
                    found = [tuple(v[k] for v, k in zip(values, at, strict=True)) for at in zip(*np.unravel_index(group[some][first], [len(v) for v in values]), strict=True)]
                    if place and (len(place) + len(found)) * resamples > HELD:
                        yield from flush()
                        place.clear()
                        sums[:] = 0
                    rows = [place.setdefault(name, len(place)) for name in found]
                    if len(place) > sums.shape[1]:
                        sums = np.concatenate([sums, np.zeros((2, 2 * len(place) - sums.shape[1], resamples), np.int64)], axis=1)
                    for k in (0, 1):
                        np.add.at(sums[k], rows, np.add.reduceat(weight[owner[some]] * count[k, some][:, None], first))
        if place:
            yield from flush()

    return run


def resampled_scores(rows: DataFrame, clusters: DataFrame, resamples: int, *keys: str, seed: str = "b") -> DataFrame:
    """keys, b, score, n, pos: the table of distinct scores of every resample; clusters as numbered from rows.

    A cluster's draws, about one for each resample, and its cells meet in one row, and tasks add up their products:
    draws times cells are never rows. Merge joins are asked for: draws and clusters grow with the rows, but a stored
    panel is packed so well, and resamples multiply it so unseen, that the planner takes them for tables small enough to
    pass through the driver.
    """
    tagged = rows.withColumn("cluster", F.concat_ws("|", "source", "source_id")).groupBy(*keys, "cluster", "score").agg(F.count("*").alias("c"), F.sum("y").cast("long").alias("p"))
    cells = tagged.join(clusters.select(*keys, "cluster", "i").hint("merge"), [*keys, "cluster"])
    cells = cells.groupBy(*keys, "i").agg(F.collect_list(F.struct("score", "c", F.coalesce("p", F.lit(0).cast("long")).alias("p"))).alias("cells"))
    drawn = draws_of(clusters, resamples, *keys, seed=seed).groupBy(*keys, "i").agg(F.collect_list(F.col("b").cast("int")).alias("b"))
    met = drawn.join(cells.hint("merge"), [*keys, "i"]).select(*keys, "b", "cells")
    kinds = StructType([*(rows.schema[k] for k in keys), StructField("b", LongType()), rows.schema["score"], StructField("n", LongType()), StructField("pos", LongType())])
    kinds = StructType([StructField(f.name, f.dataType) for f in kinds])
    run = weighted_sums(keys, resamples, to_arrow_schema(kinds))
    return met.mapInArrow(run, kinds).groupBy(*keys, "b", "score").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))


#: What bootstrap returns with a fixed threshold.
STATISTICS = ("pr_auc", "roc_auc", "brier", "ece", "precision", "recall", "f1", "lift")
Statistic = Callable[[DataFrame, list[str]], DataFrame]


def weighted_calibration_error(table: DataFrame, by: list[str]) -> DataFrame:
    """ece of a table of distinct scores with weights."""
    per = table.groupBy(*by, score_bin(F.col("score")).alias("bin")).agg(F.sum("n").alias("w"), F.sum(F.col("n") * F.col("score")).alias("p"), F.sum("pos").alias("o"))
    return per.groupBy(*by).agg((F.sum(F.abs(F.col("p") - F.col("o"))) / F.sum("w")).alias("ece"))


def bootstrap(rows: DataFrame, resamples: int, *keys: str, threshold: float | None = None, seed: str = "b", statistic: Statistic | None = None) -> DataFrame:
    """Per resample: pr_auc, roc_auc, brier, ece and, with a fixed threshold, precision, recall, f1 and lift; resamples without positives go.

    statistic: a function of the table of distinct scores (n and pos are weights) and its grouping columns, whose
    columns are added.
    """
    work = Working(rows.sparkSession, "bootstrap")
    clusters = work.table(numbered_clusters(rows, *keys))  # drawn from, and joined
    table = work.table(resampled_scores(rows, clusters, resamples, *keys, seed=seed))  # every figure below reads this one table
    work.drop_all_but(1)
    out = ranking(table, *keys, "b").where("positives > 0").select(*keys, "b", "n", "positives", "base_rate", "pr_auc", "roc_auc")
    miss = F.sum((F.col("n") - F.col("pos")) * F.pow("score", F.lit(2.0)) + F.col("pos") * F.pow(1 - F.col("score"), F.lit(2.0))) / F.sum("n")
    extra = [miss.alias("brier")]
    if threshold is not None:
        on = F.col("score") >= threshold
        hit, flagged = F.sum(F.when(on, F.col("pos")).otherwise(0)), F.sum(F.when(on, F.col("n")).otherwise(0))
        extra += [F.try_divide(hit.cast("double"), flagged).alias("precision"), F.try_divide(hit.cast("double"), F.sum("pos")).alias("recall")]
    by = [*keys, "b"]
    out = out.join(table.groupBy(*by).agg(*extra), by).join(weighted_calibration_error(table, by), by)
    if threshold is not None:
        p, q = F.col("precision"), F.col("recall")
        out = out.withColumn("f1", F.coalesce(F.try_divide(2 * p * q, p + q), F.lit(0.0))).withColumn("lift", F.try_divide(p, "base_rate"))
    if statistic:
        out = out.join(statistic(table, by), by)
    return out.drop("base_rate")


def fragility_note(rows: DataFrame) -> DataFrame:
    """rows (with positives) plus note: a warning where a figure rests on fewer than FRAGILE positives."""
    text = F.concat(F.lit("rests on "), F.col("positives").cast("string"), F.lit(" positives"))
    return rows.withColumn("note", F.when(F.col("positives") < FRAGILE, text))


def intervals(boot: DataFrame, metrics: list[str], *keys: str, level: float = 0.95) -> DataFrame:
    """metric, low, high, resamples: linear-interpolated percentiles of the defined values."""
    long = boot.unpivot(list(keys), metrics, "metric", "value")
    tail = (1 - level) / 2
    q = F.percentile("value", F.array(F.lit(tail), F.lit(1 - tail)))
    out = long.where("value is not null").groupBy(*keys, "metric").agg(q.alias("_q"), F.count("*").alias("resamples"))
    return out.select(*keys, "metric", F.get("_q", F.lit(0)).alias("low"), F.get("_q", F.lit(1)).alias("high"), "resamples")


def evaluate_with_evidence(rows: DataFrame, key: str, resamples: int = 500, budget: int = 20) -> DataFrame:
    """Group metrics with postings, fragility and the interval of pr_auc."""
    a = ranking(distinct_scores(rows, key), key)
    n = rows.groupBy(key).agg(F.count_distinct(F.concat_ws("|", "source", "source_id")).alias("postings"))
    ci = intervals(bootstrap(rows, resamples, key), ["pr_auc"], key).drop("metric")
    return a.join(n, key).join(ci, key, "left").withColumn("fragile", F.col("positives") < FRAGILE)


def fold_summary(per_fold: DataFrame, *keys: str) -> DataFrame:
    return per_fold.groupBy(*keys).agg(F.count("*").alias("folds"), F.count("pr_auc").alias("scored"), F.avg("pr_auc").alias("mean"), F.stddev_samp("pr_auc").alias("sd"))


def paired_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """folds both scored, mean and sample deviation of a - b, wins of a."""
    met = a.select("fold", F.col("pr_auc").alias("x")).join(b.select("fold", F.col("pr_auc").alias("z")), "fold").where("x is not null and z is not null").withColumn("d", F.col("x") - F.col("z"))
    return met.agg(F.count("*").alias("folds"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd_diff"), F.count_if(F.col("d") > 0).alias("wins"))


def class_scores(pairs: DataFrame) -> DataFrame:
    """accuracy, macro_f1 (0 where undefined) of (actual, predicted)."""
    counts = pairs.groupBy("actual", "predicted").agg(F.count("*").alias("n"))
    a = counts.groupBy(F.col("actual").alias("label")).agg(F.sum("n").alias("actual_n"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    p = counts.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("predicted_n"))
    both = a.join(p, "label", "full").na.fill(0)
    f1 = F.coalesce(F.try_divide(2.0 * F.col("hit"), F.col("actual_n") + F.col("predicted_n")), F.lit(0.0))
    return both.agg((F.sum("hit") / F.sum("actual_n")).alias("accuracy"), F.avg(f1).alias("macro_f1"))


def majority(pairs: DataFrame) -> DataFrame:
    """Commonest class, ties to the smaller, and its share."""
    c = pairs.groupBy("actual").agg(F.count("*").alias("n"))
    return c.agg(F.max_by("actual", F.struct("n", F.lit(0))).alias("_any"), F.max("n").alias("top"), F.sum("n").alias("all_n")).join(F.broadcast(c), F.col("n") == F.col("top")).groupBy("top", "all_n").agg(F.min("actual").alias("commonest")).select("commonest", (F.col("top") / F.col("all_n")).alias("share"))


def constant_reference(rows: DataFrame) -> DataFrame:
    p = F.avg(F.col("y").cast("double"))
    out = rows.agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("positives"), p.alias("base_rate"))
    return out.withColumns({"pr_auc": F.col("base_rate"), "roc_auc": F.lit(0.5), "brier": F.col("base_rate") * (1 - F.col("base_rate"))})


def class_weight(rows: DataFrame) -> DataFrame:
    return rows.agg(F.coalesce(F.try_divide(F.count_if(F.col("y") == 0).cast("double"), F.count_if(F.col("y") == 1)), F.lit(1.0)).alias("scale_pos_weight"))


def user_reading(at: DataFrame, days: int) -> DataFrame:
    """What a user of the budget gets a day."""
    d = F.lit(float(max(1, days)))
    flagged, pos, n = F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    unaided = flagged * F.try_divide(pos.cast("double"), n)
    return at.select("budget", (flagged / d).alias("alerts_per_day"), (F.col("tp") / d).alias("caught_per_day"), (F.col("fp") / d).alias("false_alarms_per_day"), (F.col("fn") / d).alias("missed_per_day"), F.try_divide(F.col("tp").cast("double"), pos).alias("share_caught"), (unaided / d).alias("unaided_per_day"), F.try_divide(F.col("tp").cast("double"), unaided).alias("lift"))


def rank_board(rows: DataFrame, board: str, budget: int | None = None, threshold: float | None = None, tie: str = "client_id") -> DataFrame:
    """rows plus place, threshold and watch: the top of a budget, or all from a frozen threshold up."""
    place = F.row_number().over(Window.partitionBy(board).orderBy(F.desc("score"), tie))
    out = rows.withColumn("place", place.cast("long"))
    if budget is not None:
        last = F.min(F.when(F.col("place") <= budget, F.col("score"))).over(Window.partitionBy(board))
        return out.withColumn("threshold", last).withColumn("watch", F.col("place") <= budget)
    return out.withColumn("threshold", F.lit(threshold)).withColumn("watch", F.col("score") >= F.lit(threshold))
