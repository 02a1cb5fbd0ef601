"""Isotonic regression of y on score that no single task has to fit.

Rows become one block for each distinct score (weight, positives). Neighbouring blocks whose means do not rise are
pooled; the order in which that is done does not matter, so runs of SIZE neighbouring blocks are pooled side by side,
and then again with the bounds of the runs moved by half a run, until no two blocks anywhere are out of order. The
result is the least-squares rising fit itself.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapsewise.operators.quantiles import value_part
from lapsewise.sources.working import Working

#: Blocks that one task pools.
SIZE = 100_000


def pooled(frame: pd.DataFrame) -> pd.DataFrame:
    """Neighbours out of order pooled, in one run through sorted blocks (lo, hi, n, pos)."""
    out: list[list[float]] = []
    for lo, hi, n, pos in frame.sort_values("lo")[["lo", "hi", "n", "pos"]].itertuples(index=False):
        block = [lo, hi, int(n), int(pos)]
        while out and out[-1][3] * block[2] >= block[3] * out[-1][2]:  # whole numbers: means compared without rounding
            before = out.pop()
            block = [before[0], block[1], before[2] + block[2], before[3] + block[3]]
        out.append(block)
    return pd.DataFrame(out, columns=["lo", "hi", "n", "pos"])


def numbered(blocks: DataFrame) -> DataFrame:
    """blocks plus i, their place by lo: within parts of the score range, after the parts before."""
    blocks = blocks.withColumn("_part", value_part(F.col("lo")))
    per = blocks.groupBy("_part").agg(F.count("*").alias("_m"))
    before = F.coalesce(F.sum("_m").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # parts are bounded in number
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("lo")).cast("long") - 1
    return blocks.withColumn("_in", inside).join(per.select("_part", before.alias("_before")), "_part").withColumn("i", F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")


def fit(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """lo, hi, n, pos, value: the blocks of the rising fit of y on score, in a table of their own."""
    working = Working(rows.sparkSession, "isotonic")
    one = rows.where("score is not null").groupBy((F.col("score").cast("double") + 0.0).alias("lo")).agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("pos"))
    blocks = working.table(one.select("lo", F.col("lo").alias("hi"), "n", "pos"))
    moved = 0
    while True:
        runs = numbered(blocks).withColumn("run", F.floor((F.col("i") + moved) / size))
        blocks = working.table(runs.groupBy("run").applyInPandas(lambda f: pooled(f), "lo double, hi double, n long, pos long"))
        working.drop_all_but(1)
        order = Window.partitionBy("_half").orderBy("i")
        # where neighbours are out of order is looked for in runs that overlap by one block
        placed = numbered(blocks).withColumn("_run", F.floor(F.col("i") / size))
        both = F.when((F.col("i") % size == 0) & (F.col("i") > 0), F.array("_run", F.col("_run") - 1)).otherwise(F.array("_run"))
        met = placed.withColumn("_half", F.explode(both)).withColumn("_n", F.lag("n").over(order)).withColumn("_pos", F.lag("pos").over(order))
        if met.where(F.col("_pos") * F.col("n") >= F.col("pos") * F.col("_n")).isEmpty():
            break
        moved = size // 2 - moved
    return blocks.withColumn("value", F.col("pos") / F.col("n"))


def calibrated(blocks: DataFrame, rows: DataFrame) -> DataFrame:
    """rows plus calibrated: the value of the block a score lies in, a straight line between blocks, the end values outside.

    Scores find their blocks part by part of the score range; the last block before a part and the first one behind it
    are handed to it, so that no task holds all blocks. Rows then join by their score.
    """
    part = lambda c: value_part(F.col(c))
    score = F.col("score").cast("double") + 0.0
    asked = rows.where("score is not null").select(score.alias("at")).distinct().withColumn("_part", part("at"))
    ends = blocks.select(F.explode(F.array(*[F.struct(F.col(c).alias("at"), "value") for c in ("lo", "hi")])).alias("x")).select("x.*").distinct()
    ends = ends.withColumn("_part", part("at"))
    edge = lambda pick: pick(F.struct("at", "value"))
    parts = asked.select("_part").union(ends.select("_part")).distinct()
    per = ends.groupBy("_part").agg(edge(F.min).alias("_first"), edge(F.max).alias("_last"))
    by = Window.orderBy("_part")
    per = parts.join(per, "_part", "left").select("_part", F.last("_last", True).over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.first("_first", True).over(by.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    both = asked.select("_part", "at", F.lit(None).cast("double").alias("value"), F.lit(True).alias("_asked")).unionByName(ends.withColumn("_asked", F.lit(False)))
    point = F.when(~F.col("_asked"), F.struct("at", "value"))
    w = Window.partitionBy("_part").orderBy("at")  # by range: an end at the score itself counts on both sides
    met = both.withColumn("_lo", F.last(point, True).over(w.rangeBetween(Window.unboundedPreceding, 0))).withColumn("_hi", F.first(point, True).over(w.rangeBetween(0, Window.unboundedFollowing)))
    met = met.where("_asked").join(per, "_part").withColumn("_lo", F.coalesce("_lo", "_before")).withColumn("_hi", F.coalesce("_hi", "_after"))
    lo, hi = F.coalesce("_lo", "_hi"), F.coalesce("_hi", "_lo")
    along: Column = lo["value"] + (hi["value"] - lo["value"]) * (F.col("at") - lo["at"]) / (hi["at"] - lo["at"])
    fitted = met.select(F.col("at").alias("_at"), F.when(hi["at"] > lo["at"], along).otherwise(lo["value"]).alias("calibrated"))
    return rows.withColumn("_at", score).join(fitted, "_at", "left").drop("_at")
