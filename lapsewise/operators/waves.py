"""Crawl waves, temporal splits with an embargo, rolling folds and readiness.

Rows are compressed to one row per instant before any cut is searched; cuts, waves and folds are small tables.
"""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapsewise.sources.working import Working

HOUR = 3600
#: A moment after all others, in seconds.
LATEST = 1e11
TARGETS = (0.6, 0.2, 0.2)


class SplitError(ValueError):
    pass


def seconds(c: Column | str) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp")) / 1_000_000


def crawl_waves(rows: DataFrame) -> DataFrame:
    """t, wave, wave_t: instants more than an hour after the one before begin a new wave, named by its last instant.

    Breaks are found within days; only the ends of days, one row each, are put in one order.
    """
    none = F.lit(0).cast("long")
    later = lambda a, b: F.coalesce((seconds(a) - seconds(b) > HOUR).cast("long"), none)
    times = rows.select("t").distinct().withColumn("_day", F.floor(seconds("t") / 86_400))
    inside = Window.partitionBy("_day").orderBy("t")
    times = times.withColumn("_fresh", later("t", F.lag("t").over(inside))).withColumn("_in", F.sum("_fresh").over(inside))
    days = times.groupBy("_day").agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"), F.sum("_fresh").alias("_k"))
    order = Window.orderBy("_day")
    days = days.withColumn("_first", later("_lo", F.lag("_hi").over(order)))
    before = F.coalesce(F.sum(F.col("_first") + F.col("_k")).over(order.rowsBetween(Window.unboundedPreceding, -1)), none) + F.col("_first")
    marked = times.join(days.select("_day", before.alias("_before")), "_day").select("t", (F.col("_in") + F.col("_before")).alias("wave"))
    return marked.join(marked.groupBy("wave").agg(F.max("t").alias("wave_t")), "wave").select("t", "wave", "wave_t")


def max_run_gap(rows: DataFrame) -> DataFrame:
    """gap_seconds: the widest gap between consecutive instants of any source."""
    times = rows.select("source", "t").distinct()
    gap = seconds("t") - seconds(F.lag("t").over(Window.partitionBy("source").orderBy("t")))
    return times.withColumn("gap", gap).agg(F.coalesce(F.max("gap"), F.lit(0.0)).alias("gap_seconds"))


def embargo_seconds(horizon_days: int, gap_seconds: float, corroboration: int = 1) -> float:
    if horizon_days < 0 or gap_seconds < 0 or corroboration < 0:
        raise SplitError("negative width")
    return horizon_days * 86_400.0 + corroboration * gap_seconds


def split_column(train_end: Column, val_end: Column, embargo: float, t: str = "t") -> Column:
    """train, val, test or embargo. Later blocks take over where they overlap."""
    at = seconds(t)
    a, b = seconds(train_end), seconds(val_end)
    return F.when(at > b + embargo, "test").when((at > a + embargo) & (at <= b), "val").when(at <= a, "train").otherwise("embargo")


def with_seen_in_train(rows: DataFrame) -> DataFrame:
    """rows plus seen_in_train: whether the posting has training rows (false on those themselves)."""
    seen = rows.where("split = 'train'").select("source", "source_id").distinct().withColumn("_seen", F.lit(True))
    out = rows.join(seen, ["source", "source_id"], "left")
    return out.withColumn("seen_in_train", F.coalesce("_seen", F.lit(False)) & (F.col("split") != "train")).drop("_seen")


@dataclass(frozen=True)
class SplitResult:
    frame: DataFrame
    embargo: float
    counts: dict[str, tuple[int, int]]


def temporal_split(rows: DataFrame, train_end: dt.datetime, val_end: dt.datetime, horizon_days: int) -> SplitResult:
    """Labelled rows outside the embargo with split and seen_in_train; refuses cuts inside a wave and unusable blocks."""
    waves = [r[0] for r in crawl_waves(rows).select("wave_t").distinct().orderBy("wave_t").collect()]
    for cut in (train_end, val_end):
        for w in waves:
            if cut != w and abs((cut - w).total_seconds()) <= HOUR:
                raise SplitError(f"cut {cut} lies inside the wave of {w}")
    if not train_end < val_end:
        raise SplitError("cuts out of order")
    embargo = embargo_seconds(horizon_days, max_run_gap(rows).first()[0])
    out = rows.where("label_observable").withColumn("split", split_column(F.lit(train_end), F.lit(val_end), embargo)).where("split <> 'embargo'")
    out = with_seen_in_train(out)
    found = {r["split"]: r for r in out.groupBy("split").agg(F.count("*").alias("n"), F.sum("y").alias("p"), F.min("t").alias("lo"), F.max("t").alias("hi")).collect()}
    for name in ("train", "val", "test"):
        if name not in found:
            raise SplitError(f"{name} is empty")
        if name != "train" and not 0 < found[name]["p"] < found[name]["n"]:
            raise SplitError(f"{name} has one class")
    for a, b in (("train", "val"), ("val", "test")):
        if (found[b]["lo"] - found[a]["hi"]).total_seconds() <= embargo:
            raise SplitError(f"{a} and {b} are not apart")
    return SplitResult(out, embargo, {k: (r["n"], r["p"]) for k, r in found.items()})


def split_report(rows: DataFrame) -> DataFrame:
    """Per block, over all rows and by seen_in_train: rows, postings, positives, rate."""
    out = rows.withColumn("_key", F.concat_ws("|", "source", "source_id"))
    agg = (F.count("*").alias("rows"), F.count_distinct("_key").alias("postings"), F.sum("y").cast("long").alias("positives"), F.avg(F.col("y").cast("double")).alias("rate"))
    whole = out.groupBy("split").agg(*agg).withColumn("part", F.lit("all"))
    parts = out.groupBy("split", F.when(F.col("seen_in_train"), "carried over").otherwise("unseen").alias("part")).agg(*agg)
    return whole.unionByName(parts)


def instants(rows: DataFrame) -> DataFrame:
    """t, n, pos of labelled rows: what every cut search works on."""
    return rows.where("label_observable").groupBy("t").agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("pos"))


def sums_up_to(at: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (with until, in seconds) plus n and pos of all rows of at (at, n, pos) up to there.

    Both are dealt into parts of a day; a bound takes the sum of the parts before its own and, by an equality join on
    parts, what its own part holds up to it. Neither side is compared with all of the other.
    """
    day = lambda c: F.floor(F.col(c) / 86_400)
    both = at.select(day("at").alias("part"), F.col("at").alias("moment"), "n", "pos", F.lit(None).cast(asked.select(F.struct("*")).schema[0].dataType).alias("own"))
    both = both.unionByName(asked.select(day("until").alias("part"), F.col("until").alias("moment"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("pos"), F.struct("*").alias("own")))
    inside = Window.partitionBy("part").orderBy("moment")  # by range: rows of the same instant count
    parts = both.groupBy("part").agg(F.sum("n").alias("_n"), F.sum("pos").alias("_pos"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each day
    parts = parts.select("part", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in ("n", "pos")])
    met = both.withColumns({c: F.sum(c).over(inside) for c in ("n", "pos")}).where("own is not null").join(parts, "part")
    return met.select("own.*", *[(F.col(c) + F.col(f"_{c}")).cast("long").alias(c) for c in ("n", "pos")])


def feasible_cuts(rows: DataFrame, embargo: float) -> DataFrame:
    """Every pair of waves as cuts: rows and positives of each block, embargoed rows, valid, reason.

    Sums up to each wave, up to the end of its embargo and over all are taken once; a cut is then arithmetic on two
    waves. The table of sums has a row for each wave and meets itself, as there is a result for every pair.
    """
    at = instants(rows).select(seconds("t").alias("at"), "n", "pos")
    waves = crawl_waves(rows.where("label_observable")).select("wave_t").distinct()
    ends = [F.struct(F.lit(x).alias("end"), until.cast("double").alias("until")) for x, until in (("at", seconds("wave_t")), ("past", seconds("wave_t") + embargo), ("all", F.lit(LATEST)))]
    found = sums_up_to(at, waves.select("wave_t", F.explode(F.array(*ends)).alias("x")).select("wave_t", "x.*"))
    pick = lambda x, c: F.max(F.when(F.col("end") == x, F.col(c))).alias(f"{x}_{c}")
    sums = found.groupBy("wave_t").agg(*[pick(x, c) for x in ("at", "past", "all") for c in ("n", "pos")])
    a, b = (sums.select(*[F.col(c).alias(f"{s}_{c}") for c in sums.columns]) for s in "ab")
    cuts = a.join(b, F.col("a_wave_t") < F.col("b_wave_t"))
    figures = {}
    for c, name in (("n", "rows"), ("pos", "positives")):
        figures |= {f"train_{name}": F.col(f"a_at_{c}"), f"val_{name}": F.greatest(F.lit(0), F.col(f"b_at_{c}") - F.col(f"a_past_{c}")), f"test_{name}": F.col(f"b_all_{c}") - F.col(f"b_past_{c}")}
    out = cuts.select(F.col("a_wave_t").alias("train_end"), F.col("b_wave_t").alias("val_end"), *[figures[f"{b}_{x}"].cast("long").alias(f"{b}_{x}") for b in ("train", "val", "test") for x in ("rows", "positives")], F.col("a_all_n").alias("_all"))
    out = out.withColumn("embargoed", F.col("_all") - F.col("train_rows") - F.col("val_rows") - F.col("test_rows")).drop("_all")
    reason = F.when(F.col("train_rows") == 0, "train is empty").when(F.col("val_rows") == 0, "val is empty").when(F.col("test_rows") == 0, "test is empty")
    for b in ("val", "test"):
        reason = reason.when((F.col(f"{b}_positives") == 0) | (F.col(f"{b}_positives") == F.col(f"{b}_rows")), f"{b} has one class")
    out = out.withColumn("reason", reason.otherwise("ok"))
    return out.withColumn("valid", F.col("reason") == "ok")


def first_beyond(waves: DataFrame, width: float) -> DataFrame:
    """a, b: each wave with the first wave later than width after it, where there is one. One pass in order over the waves, one row a crawl."""
    at = waves.select(seconds("wave_t").alias("moment"), F.col("wave_t").alias("wave"), F.lit(None).cast("timestamp").alias("a"), F.lit(1).alias("kind"))
    ask = waves.select((seconds("wave_t") + width).alias("moment"), F.lit(None).cast("timestamp").alias("wave"), F.col("wave_t").cast("timestamp").alias("a"), F.lit(0).alias("kind"))
    later = Window.orderBy(F.desc("moment"), "kind").rowsBetween(Window.unboundedPreceding, -1)  # a wave just at the bound is not beyond it
    return at.unionByName(ask).withColumn("b", F.min("wave").over(later)).where("a is not null and b is not null").select("a", "b")


def fold_table(rows: DataFrame, embargo: float, until: Column | None = None) -> DataFrame:
    """fold, train_end, val_start: each wave but the last trains on all up to it and validates on the first wave beyond the embargo."""
    waves = crawl_waves(rows).select("wave_t").distinct()
    if until is not None:
        waves = waves.where(F.col("wave_t") <= until)
    first = first_beyond(waves, embargo).select(F.col("a").alias("train_end"), F.col("b").alias("val_start"))
    return first.withColumn("fold", F.row_number().over(Window.orderBy("train_end")).cast("long") - 1)


def fold_rows(rows: DataFrame, folds: DataFrame, embargo: float) -> DataFrame:
    """rows of each fold with part: train, or val for those after the embargo and up to val_start.

    Instants are matched with folds (both few); the rows then join by their instant.
    """
    return rows.join(fold_instants(rows, folds, embargo), "t")


def fold_instants(rows: DataFrame, folds: DataFrame, embargo: float) -> DataFrame:
    """t with the columns of each fold it belongs to, and part."""
    at = seconds("t")
    train, val = at <= seconds("train_end"), (at > seconds("train_end") + embargo) & (at <= seconds("val_start"))
    return rows.select("t").distinct().join(folds, train | val).withColumn("part", F.when(train, "train").otherwise("val"))


def fold_sizes(rows: DataFrame, embargo: float) -> DataFrame:
    """fold, train_rows, val_rows, val_positives, from sums up to the bounds of each fold."""
    folds = fold_table(rows.where("label_observable"), embargo)
    at = instants(rows).select(seconds("t").alias("at"), "n", "pos")
    ends = F.array(*[F.struct(F.lit(x).alias("end"), until.cast("double").alias("until")) for x, until in (("train", seconds("train_end")), ("after", seconds("train_end") + embargo), ("until", seconds("val_start")))])
    found = sums_up_to(at, folds.select("fold", F.explode(ends).alias("x")).select("fold", "x.*"))
    pick = lambda x, c: F.max(F.when(F.col("end") == x, F.col(c)))
    return found.groupBy("fold").agg(pick("train", "n").alias("train_rows"), (pick("until", "n") - pick("after", "n")).alias("val_rows"), (pick("until", "pos") - pick("after", "pos")).alias("val_positives"))


def rolling_origin_folds(train_waves: int, burnt: int) -> int:
    return max(0, train_waves - burnt)


def fold_census(rows: DataFrame, embargo: float) -> DataFrame:
    """Each legal cut with the number of folds its training block gives: those that validate up to its end, a running count over waves."""
    waves = crawl_waves(rows.where("label_observable")).select("wave_t").distinct()
    found = first_beyond(waves, embargo).select(seconds("b").alias("at"), F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("pos"))
    counts = sums_up_to(found, waves.select(F.col("wave_t").alias("train_end"), seconds("wave_t").alias("until"))).select("train_end", F.col("n").alias("folds"))
    cuts = Working(rows.sparkSession, "cuts").table(feasible_cuts(rows, embargo).where("valid"))
    return cuts.join(counts, "train_end")


def best_cut(rows: DataFrame, embargo: float, least_folds: int = 3) -> DataFrame:
    """The legal cut nearest to 60/20/20 among those with enough folds, else the deepest."""
    census = fold_census(rows, embargo)
    total = F.col("train_rows") + F.col("val_rows") + F.col("test_rows")
    off = sum((F.abs(F.col(f"{b}_rows") / total - F.lit(x)) for b, x in zip(("train", "val", "test"), TARGETS, strict=True)), F.lit(0.0))
    enough = F.col("folds") >= least_folds
    return census.withColumn("imbalance", F.round(off, 9)).orderBy(F.desc(enough.cast("int")), F.when(enough, F.col("imbalance")), F.desc("folds"), "train_end", "val_end").limit(1)


def latest_cut_per_val_end(cuts: DataFrame) -> DataFrame:
    return cuts.where("valid").groupBy("val_end").agg(F.max("train_end").alias("train_end"))


def depth(rows: DataFrame, horizon_days: int, target_folds: int = 3) -> dict[str, float]:
    """Waves there, their median spacing, waves burnt by the embargo, waves needed for a split and for the folds."""
    embargo = embargo_seconds(horizon_days, max_run_gap(rows).first()[0])
    all_waves = crawl_waves(rows).select("wave_t").distinct()
    gap = seconds("wave_t") - seconds(F.lag("wave_t").over(Window.orderBy("wave_t")))
    spacing = all_waves.withColumn("gap", gap).agg(F.median("gap")).first()[0] or 0.0
    have = crawl_waves(rows.where("label_observable")).select("wave_t").distinct().count()
    burnt = math.floor(embargo / spacing) + 1 if spacing else 0
    needed = 1 + 2 * burnt + 1
    folds = needed + burnt + (target_folds - 1)
    return {"waves": have, "spacing_seconds": spacing, "burnt": burnt, "needed": needed, "needed_for_folds": folds, "short": max(0, needed - have), "short_for_folds": max(0, folds - have)}


def accrual_status(newest: dt.datetime, spacing_seconds: float, now: dt.datetime) -> dict[str, object]:
    """Stalled if the newest wave is more than two spacings old."""
    age = (now - newest).total_seconds()
    return {"stalled": bool(spacing_seconds) and age > 2 * spacing_seconds, "missed": max(0, int(age // spacing_seconds) if spacing_seconds else 0)}


def projected_clear(newest: dt.datetime, shortfall: int, spacing_seconds: float, stalled: bool) -> dt.datetime | None:
    """When the shortfall will be made up: None when stalled or not short."""
    return None if stalled or shortfall <= 0 else newest + dt.timedelta(seconds=shortfall * spacing_seconds)


def readiness(rows: DataFrame, horizon_days: int, now: dt.datetime, least_folds: int = 3) -> str:
    """stalled, too shallow, no legal cut, no folds or ready."""
    d = depth(rows, horizon_days, least_folds)
    newest = rows.agg(F.max("t")).first()[0]
    if newest is None or accrual_status(newest, d["spacing_seconds"], now)["stalled"]:
        return "stalled"
    if d["short"]:
        return "too shallow"
    census = fold_census(rows, embargo_seconds(horizon_days, max_run_gap(rows).first()[0])).agg(F.count("*").alias("cuts"), F.max("folds").alias("folds")).first()
    if not census["cuts"]:
        return "no legal cut"
    return "ready" if census["folds"] >= least_folds else "no folds"
