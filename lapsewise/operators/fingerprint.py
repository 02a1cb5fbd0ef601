"""Which columns give a board away: tables that all come from one contingency pass over (feature, bin, board).

Numbers are binned at quantile edges of the training rows, categories by value; null is a bin. Counts of (feature, bin,
board) on the training rows are the whole fit. One feature alone predicts the commonest board of its bin. All together
they predict by adding up log shares (naive Bayes, with ALPHA added to each count), so leaving one out, or the board
context, is a subtraction from a row's sum and no further fit; null masks alone are the same counts with all values of
a feature taken as one. Ties go to the first board by name.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewise.operators import quantiles
from lapsewise.operators.features import BOARD_CONTEXT
from lapsewise.sources.working import Working

ALPHA, BINS = 1.0, 16
NULL = "null"
ALL, NO_CONTEXT, NULLS, WITHOUT = "all", "without board context", "nulls alone", "without "


@dataclass(frozen=True)
class Fingerprint:
    #: variant, rows, accuracy, macro_f1
    scores: DataFrame
    #: feature, rows, accuracy, macro_f1
    stumps: DataFrame
    #: removed, accuracy_without, drop
    drop_one: DataFrame
    #: actual, predicted, n with all features
    confusion: DataFrame
    #: board, rows, recall
    recall: DataFrame


def binned(rows: DataFrame, edges: dict[str, list[float]], categorical: Sequence[str], target: str) -> DataFrame:
    """row, board and cells: the bin of each feature."""
    def below(x: Column, own: list[float]) -> Column:
        return F.size(F.filter(F.lit(own).cast("array<double>"), lambda e: x > e))

    cells = []
    for c, own in edges.items():
        x = F.col(c).cast("double")
        cells.append(F.struct(F.lit(c).alias("feature"), F.when(x.isNull() | F.isnan(x), NULL).otherwise(F.concat(F.lit("b"), below(x, own).cast("string"))).alias("bin")))
    for c in categorical:
        cells.append(F.struct(F.lit(c).alias("feature"), F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit(NULL)).alias("bin")))
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col(target).cast("string").alias("board"), F.array(*cells).alias("cells"))


def class_table(counts: DataFrame, *keys: str) -> DataFrame:
    """keys, rows, accuracy and macro_f1 of (keys, actual, predicted, n); a class that is only predicted counts with 0."""
    hit = F.col("actual") == F.col("predicted")
    a = counts.groupBy(*keys, F.col("actual").alias("label")).agg(F.sum("n").alias("a"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("hit"))
    p = counts.groupBy(*keys, F.col("predicted").alias("label")).agg(F.sum("n").alias("p"))
    both = a.join(p, [*keys, "label"], "full").na.fill(0, ["a", "hit", "p"])
    f1 = F.coalesce(F.try_divide(2.0 * F.col("hit"), F.col("a") + F.col("p")), F.lit(0.0))
    return both.groupBy(*keys).agg(F.sum("a").alias("rows"), F.try_divide(F.sum("hit").cast("double"), F.sum("a")).alias("accuracy"), F.avg(f1).alias("macro_f1"))


def fingerprint(train: DataFrame, val: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str = "source", context: Sequence[str] = BOARD_CONTEXT, alpha: float = ALPHA, bins: int = BINS) -> Fingerprint:
    work = Working(train.sparkSession, "fingerprint")
    found = {r["feature"]: list(r["edges"]) for r in quantiles.cut_values(train, numeric, bins).collect()} if numeric else {}
    edges = {c: found.get(c, []) for c in numeric}
    cells = lambda df: binned(df, edges, categorical, target).where("board is not null")
    long = cells(train).select("board", F.explode("cells").alias("x")).select("board", "x.feature", "x.bin")
    counts = work.table(long.groupBy("feature", "bin", "board").agg(F.count("*").alias("n")))  # the one pass over the training rows
    # every row has a cell of every feature: one feature's counts are those of the boards
    first = [*numeric, *categorical][0]
    sizes = {r["board"]: r["n"] for r in counts.where(F.col("feature") == first).groupBy("board").agg(F.sum("n").alias("n")).collect()}  # a row for each board
    boards = sorted(sizes)
    total = sum(sizes.values())
    names, n_of = F.lit(boards).cast("array<string>"), F.lit([float(sizes[b]) for b in boards]).cast("array<double>")
    prior = F.lit([sizes[b] / total for b in boards]).cast("array<double>")

    def shares(df: DataFrame, *keys: str, kinds: Column) -> DataFrame:
        """keys and w: the log share of the cell on each board, in the order of boards."""
        per = df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("board", "n"))).alias("of"), F.max(kinds).alias("kinds"))
        log = F.transform(names, lambda b, i: F.log((F.coalesce(F.try_element_at("of", b), F.lit(0)) + alpha) / (F.get(n_of, i) + alpha * F.col("kinds"))))
        return per.select(*keys, log.alias("w"))

    kinds = counts.groupBy("feature").agg(F.count_distinct("bin").alias("_kinds"))
    w = shares(counts.join(kinds, "feature"), "feature", "bin", kinds=F.col("_kinds"))
    masks = counts.groupBy("feature", (F.col("bin") == NULL).alias("null"), "board").agg(F.sum("n").alias("n"))
    m = shares(masks, "feature", "null", kinds=F.lit(2)).withColumnRenamed("w", "m")
    unseen = kinds.select("feature", F.transform(n_of, lambda n: F.log(alpha / (n + alpha * F.col("_kinds")))).alias("none"))

    rows = work.table(cells(val))
    met = rows.select("row", "board", F.explode("cells").alias("x")).select("row", "board", "x.feature", "x.bin", (F.col("x.bin") == NULL).alias("null"))
    met = met.join(w, ["feature", "bin"], "left").join(m, ["feature", "null"], "left").join(unseen, "feature")
    mask_none = F.transform(n_of, lambda n: F.log(alpha / (n + 2 * alpha)))
    each = F.struct("feature", F.coalesce("w", "none").alias("w"), F.coalesce("m", mask_none).alias("m"))
    per = met.groupBy("row").agg(F.max("board").alias("actual"), F.sort_array(F.collect_list(each)).alias("parts"))  # as many parts as features

    def added(parts: Column, field: str, start: Column) -> Column:
        return F.aggregate(parts, start, lambda acc, x: F.zip_with(acc, x[field], lambda a, b: a + b))

    def best(scores: Column) -> Column:
        even = F.transform(scores, lambda x: F.round(x, 9))
        return F.get(names, (F.array_position(even, F.array_max(even)) - 1).cast("int"))

    start = F.transform(prior, lambda p: F.log(p))
    less = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    per = per.withColumn("sum", added(F.col("parts"), "w", start))
    nothing = F.transform(prior, lambda p: p * 0.0)
    own = F.filter("parts", lambda x: x["feature"].isin(*context)) if context else F.filter("parts", lambda x: F.lit(False))
    variant = lambda name, scores: F.struct(name.alias("variant"), best(scores).alias("predicted"))
    variants = F.concat(
        F.array(variant(F.lit(ALL), F.col("sum")), variant(F.lit(NO_CONTEXT), less(F.col("sum"), added(own, "w", nothing))), variant(F.lit(NULLS), added(F.col("parts"), "m", start))),
        F.transform("parts", lambda x: variant(F.concat(F.lit(WITHOUT), x["feature"]), less(F.col("sum"), x["w"]))),
    )
    said = per.select("actual", F.explode(variants).alias("v")).groupBy("v.variant", "actual", "v.predicted").agg(F.count("*").alias("n"))
    said = work.table(said)

    commonest = F.max_by("board", F.struct("n", F.expr("-rank")))
    ranks = train.sparkSession.createDataFrame([(b, i) for i, b in enumerate(boards)], "board string, rank long")
    alone = counts.join(ranks, "board").groupBy("feature", "bin").agg(commonest.alias("predicted"))
    most = max(boards, key=lambda b: (sizes[b], [-ord(ch) for ch in b])) if boards else None
    seen = rows.select("board", F.explode("cells").alias("x")).groupBy("x.feature", "x.bin", F.col("board").alias("actual")).agg(F.count("*").alias("n"))
    stumps = class_table(seen.join(alone, ["feature", "bin"], "left").withColumn("predicted", F.coalesce("predicted", F.lit(most))), "feature")

    scores = class_table(said, "variant")
    full = scores.where(F.col("variant") == ALL).select(F.col("accuracy").alias("_full"))
    gone = scores.where(F.startswith("variant", F.lit(WITHOUT)) & (F.col("variant") != NO_CONTEXT)).join(F.broadcast(full), F.lit(True))
    gone = gone.select(F.expr(f"substring(variant, {len(WITHOUT) + 1})").alias("removed"), F.col("accuracy").alias("accuracy_without"), (F.col("_full") - F.col("accuracy")).alias("drop"))
    confusion = said.where(F.col("variant") == ALL).drop("variant")
    recall = confusion.groupBy(F.col("actual").alias("board")).agg(F.sum("n").alias("rows"), (F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("recall"))
    return Fingerprint(scores.where((F.col("variant").isin(ALL, NO_CONTEXT, NULLS))), stumps, gone, confusion, recall)
