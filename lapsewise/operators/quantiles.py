"""Exact quantiles by rank search: values are counted, ranks are found in parts of the value range, then inside them.

No task holds all values of a group: the first pass sums counts over parts of the value range (256 for each doubling),
the second orders only the parts in which a wanted rank lies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_part(value: Column) -> Column:
    """A number that never falls as the value grows, with 256 values for each doubling: a bounded number of parts."""
    size = F.floor(F.log2(F.abs(value)) * 256).cast("long")
    return F.coalesce(F.when(value > 0, size + 1_000_000).when(value < 0, -size - 1_000_000).when(value == 0, 0).when(F.isnan(value), 1 << 62), F.lit(-(1 << 62)))


def value_counts(rows: DataFrame, columns: Sequence[str], *keys: str, weight: str | None = None) -> DataFrame:
    """g (the keys as a struct), feature, value, n of the values that are not null; part of the value range. weight: how many rows a row stands for."""
    each = [F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns]
    g = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("_all"))
    n = F.col(weight) if weight else F.lit(1)
    long = rows.select(g.alias("g"), n.alias("w"), F.explode(F.array(*each)).alias("x")).select("g", "w", "x.*").where("value is not null")
    # -0.0 and 0.0 are one value
    return long.groupBy("g", "feature", (F.col("value") + 0.0).alias("value")).agg(F.sum("w").cast("long").alias("n")).withColumn("part", value_part(F.col("value")))


def ranked(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (g, feature, rank from 0, and more) plus the value at that rank."""
    per = counts.groupBy("g", "feature", "part").agg(F.sum("n").alias("m"))
    order = Window.partitionBy("g", "feature").orderBy("part")
    per = per.withColumn("before", F.sum("m").over(order) - F.col("m"))
    at = asked.join(per, ["g", "feature"]).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("m"))).drop("m")
    inside = counts.join(at.select("g", "feature", "part").distinct(), ["g", "feature", "part"], "left_semi")
    upto = F.sum("n").over(Window.partitionBy("g", "feature", "part").orderBy("value"))
    inside = inside.withColumn("upto", upto).select("g", "feature", "part", "value", "upto", (F.col("upto") - F.col("n")).alias("from"))
    met = at.join(inside, ["g", "feature", "part"])
    return met.where((F.col("rank") - F.col("before") >= F.col("from")) & (F.col("rank") - F.col("before") < F.col("upto"))).drop("part", "before", "from", "upto")


def exact_quantiles(rows: DataFrame, columns: Sequence[str], at: Sequence[float], *keys: str, weight: str | None = None) -> DataFrame:
    """keys, feature, n (values that are not null) and q, the quantiles at the given places, interpolated between ranks; features without any value are left out."""
    counts = value_counts(rows, columns, *keys, weight=weight)
    sizes = counts.groupBy("g", "feature").agg(F.sum("n").alias("size"))
    places = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(float(p)).alias("p")) for i, p in enumerate(at)]))
    asked = sizes.select("g", "feature", "size", places.alias("x")).select("g", "feature", "size", "x.k", (F.col("x.p") * (F.col("size") - 1)).alias("position"))
    ends = F.explode(F.array(F.floor("position"), F.ceil("position")))
    found = ranked(counts, asked.select("*", ends.alias("rank")).distinct())
    value = lambda end: F.max(F.when(F.col("rank") == end("position"), F.col("value")))
    pair = found.groupBy("g", "feature", "size", "k", "position").agg(value(F.floor).alias("low"), value(F.ceil).alias("high"))
    mixed = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((F.ceil("position") - F.col("position")) * F.col("low") + (F.col("position") - F.floor("position")) * F.col("high"))
    out = pair.groupBy("g", "feature").agg(F.max("size").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("k", mixed.alias("v")))), lambda x: x["v"]).alias("q"))
    return out.select(*[F.col(f"g.`{k}`").alias(k) for k in keys], "feature", "n", "q")


def cut_values(rows: DataFrame, columns: Sequence[str], bins: int) -> DataFrame:
    """feature and edges: for each of the inner bounds of equal bins the smallest value up to which that share of the rows lies, each once."""
    counts = value_counts(rows, columns)
    sizes = counts.groupBy("g", "feature").agg(F.sum("n").alias("size"))
    # the k-th bound is the value whose rank is the last of the first k / bins of the rows
    rank = F.explode(F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda k: F.ceil(k * F.col("size") / F.lit(float(bins))).cast("long") - 1))
    found = ranked(counts, sizes.select("g", "feature", rank.alias("rank")).distinct())
    return found.groupBy("feature").agg(F.array_sort(F.collect_set("value")).alias("edges"))
