"""Boosted trees with second-order steps, grown level by level from histograms.

Features are binned once: numbers at quantile edges, categories by level. A tree level is one aggregation: every sampled
row adds its gradient and curvature to (node, feature, bin), summed in the tasks before anything is shuffled. What comes
to the driver has a row for each node, feature and bin, so its size follows from depth, features and bins, and not from
the rows. There the best split of each node is chosen; a leaf takes the Newton step -G / (H + l2), times the rate.

Everything is decided by sums of integers: gradients are fixed-point numbers, so that neither the order of rows nor the
dealing of partitions changes a tree. Rows are sampled for a tree by a hash of seed, tree and key, features likewise.
Nulls in a number go with the side that gains more; categories are split one against the rest, so a level that was rare
or never seen in training goes with the rest.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewise.operators import quantiles
from lapsewise.sources.working import Working

#: Units of gradient and curvature.
UNIT = 1 << 20
#: A level of a category is a bin of its own from this many rows.
LEAST_LEVEL = 5
NULL = "__missing__"


@dataclass(frozen=True)
class Split:
    """Left are bins up to at (numbers; nulls too if null_left) or the bin at alone (categories)."""

    feature: int
    at: int
    number: bool
    null_left: bool = False


@dataclass(frozen=True)
class Tree:
    """Nodes are numbered from 1, the children of i being 2i and 2i + 1."""

    splits: dict[int, Split]
    leaves: dict[int, float]


@dataclass(frozen=True)
class Settings:
    rounds: int = 400
    depth: int = 4
    rate: float = 0.05
    subsample: float = 0.8
    columns: float = 0.8
    l2: float = 1.0
    least_weight: float = 1.0
    #: Weight of positive rows; None: as many as there are negatives for each.
    positive_weight: float | None = None
    bins: int = 32
    seed: int = 0
    #: Trees after which margins are written again.
    every: int = 10


def goes_left(split: Split, bins: Column) -> Column:
    b = F.get(bins, F.lit(split.feature))
    if not split.number:
        return b == split.at
    return (b <= split.at) & ((b >= 0) | F.lit(split.null_left))


def node_of(splits: dict[int, Split], bins: Column, at: int = 1) -> Column:
    """The node that a row has come to."""
    if at not in splits:
        return F.lit(at)
    return F.when(goes_left(splits[at], bins), node_of(splits, bins, 2 * at)).otherwise(node_of(splits, bins, 2 * at + 1))


def value_of(tree: Tree, bins: Column, at: int = 1) -> Column:
    if at not in tree.splits:
        return F.lit(float(tree.leaves[at]))
    return F.when(goes_left(tree.splits[at], bins), value_of(tree, bins, 2 * at)).otherwise(value_of(tree, bins, 2 * at + 1))


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long") / float(1 << 32)


def chosen(features: Sequence[str], share: float, seed: int, tree: int) -> list[int]:
    """The features that a tree may use: the first by hash."""
    n = max(1, math.ceil(share * len(features)))
    order = sorted(range(len(features)), key=lambda f: hashlib.md5(f"columns|{seed}|{tree}|{features[f]}".encode()).hexdigest())
    return sorted(order[:n])


def best_split(hist: dict[tuple[int, int], tuple[int, int]], numbers: set[int], features: Sequence[int], total: tuple[int, int], l2: float, least: float) -> tuple[float, Split] | None:
    """The split of a node with the largest gain, from (feature, bin) -> (G, H); ties to the first feature and lowest bin."""
    g, h = total[0] / UNIT, total[1] / UNIT
    best: tuple[float, Split] | None = None

    def offer(left: tuple[int, int], split: Split) -> None:
        nonlocal best
        a, b = left[0] / UNIT, left[1] / UNIT
        if b < least or h - b < least:
            return
        gain = round(a * a / (b + l2) + (g - a) * (g - a) / (h - b + l2) - g * g / (h + l2), 9)
        if gain > 0 and (best is None or gain > best[0]):
            best = (gain, split)

    for f in features:
        own = sorted((b, x) for (k, b), x in hist.items() if k == f)
        if f not in numbers:
            for b, x in own:
                if b >= 0:
                    offer(x, Split(f, b, False))
            continue
        null = next((x for b, x in own if b < 0), (0, 0))
        left = (0, 0)
        for b, x in own:
            if b < 0:
                continue
            left = (left[0] + x[0], left[1] + x[1])
            offer(left, Split(f, b, True, False))
            if null != (0, 0):
                offer((left[0] + null[0], left[1] + null[1]), Split(f, b, True, True))
    return best


def edges_below(x: Column, edges: list[float]) -> Column:
    return F.size(F.filter(F.lit(edges).cast("array<double>"), lambda e: x > e))


class BoostedModel(Model):
    def __init__(self, numeric: dict[str, list[float]], levels: dict[str, list[str]], base: float, trees: list[Tree]):
        super().__init__()
        self.numeric, self.levels, self.base, self.trees = numeric, levels, base, trees

    def bins(self) -> Column:
        """Bin of every feature: below 0 for a null number and for a level that has none."""
        out = []
        for c, edges in self.numeric.items():
            x = F.col(c).cast("double")
            out.append(F.when(x.isNull() | F.isnan(x), -1).otherwise(edges_below(x, edges)))
        for c, levels in self.levels.items():
            x = F.coalesce(F.col(c).cast("string"), F.lit(NULL))
            out.append((F.array_position(F.lit(levels).cast("array<string>"), x) - 1).cast("int") if levels else F.lit(-1))
        return F.array(*out).cast("array<int>")

    def _transform(self, df: DataFrame) -> DataFrame:
        trees, base = self.trees, self.base

        @F.pandas_udf("double")
        def margin(bins: pd.Series) -> pd.Series:
            x = np.stack(bins.to_numpy()) if len(bins) else np.empty((0, 1), np.int32)
            total = np.full(len(x), base)
            for tree in trees:
                node = np.ones(len(x), np.int64)
                while True:
                    before = node.copy()
                    for i, s in tree.splits.items():
                        b = x[:, s.feature]
                        left = ((b <= s.at) & ((b >= 0) | s.null_left)) if s.number else b == s.at
                        node = np.where(before == i, 2 * i + ~left, node)
                    if (node == before).all():
                        break
                total += np.vectorize(tree.leaves.get, otypes=[float])(node)
            return pd.Series(total)

        p = 1 / (1 + F.exp(-F.col("_margin")))
        return df.withColumn("_margin", margin(self.bins())).withColumn("probability", array_to_vector(F.array(1 - p, p))).drop("_margin")

    def to_json(self) -> str:
        trees = [{"splits": {i: asdict(s) for i, s in t.splits.items()}, "leaves": t.leaves} for t in self.trees]
        return json.dumps({"numeric": self.numeric, "levels": self.levels, "base": self.base, "trees": trees})

    @staticmethod
    def from_json(text: str) -> BoostedModel:
        found = json.loads(text)
        trees = [Tree({int(i): Split(**s) for i, s in t["splits"].items()}, {int(i): v for i, v in t["leaves"].items()}) for t in found["trees"]]
        return BoostedModel(found["numeric"], found["levels"], found["base"], trees)


class BoostedTrees(Estimator):
    """Fits y on named numbers and categories. key: columns that name a row, for the sampling of rows."""

    def __init__(self, numeric: Sequence[str], categorical: Sequence[str] = (), key: Sequence[str] = ("source", "source_id", "t"), **settings: object):
        super().__init__()
        self.numeric, self.categorical, self.key, self.settings = list(numeric), list(categorical), list(key), Settings(**settings)

    def learned_bins(self, df: DataFrame) -> tuple[dict[str, list[float]], dict[str, list[str]]]:
        edges = {r["feature"]: list(r["edges"]) for r in quantiles.cut_values(df, self.numeric, self.settings.bins).collect()} if self.numeric else {}
        levels: dict[str, list[str]] = {c: [] for c in self.categorical}
        if self.categorical:
            each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.coalesce(F.col(c).cast("string"), F.lit(NULL)).alias("v")) for c in self.categorical]))
            counts = df.select(each.alias("x")).groupBy("x.c", "x.v").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_LEVEL)
            for c in self.categorical:  # a level each, as many as there are bins at most: the commonest
                levels[c] = [r["v"] for r in counts.where(F.col("c") == c).orderBy(F.desc("n"), "v").limit(self.settings.bins).collect()]
        return {c: edges.get(c, []) for c in self.numeric}, levels

    def _fit(self, df: DataFrame) -> BoostedModel:
        s, features = self.settings, [*self.numeric, *self.categorical]
        model = BoostedModel(*self.learned_bins(df), 0.0, [])
        sizes = df.agg(F.count("*").alias("n"), F.sum(F.col("y").cast("double")).alias("p")).first()
        n, p = sizes["n"], sizes["p"] or 0.0
        if not 0 < p < n:
            raise ValueError("boosting needs rows of both classes")
        up = s.positive_weight if s.positive_weight is not None else (n - p) / p
        model.base = math.log(up * p / (n - p))
        working = Working(df.sparkSession, "boosting")
        weight = F.when(F.col("y") > 0, F.lit(float(up))).otherwise(1.0)
        rows = df.select(model.bins().alias("bins"), F.col("y").cast("double").alias("y"), weight.alias("w"), F.concat_ws("|", *[F.col(c).cast("string") for c in self.key]).alias("key"), F.lit(model.base).alias("margin"))
        rows, since = working.table(rows), 0
        for k in range(s.rounds):
            margin = F.col("margin")
            for tree in model.trees[since:]:
                margin = margin + value_of(tree, F.col("bins"))
            if k - since == s.every:
                rows = working.table(rows.withColumn("margin", margin))
                working.drop_all_but(1)
                since, margin = k, F.col("margin")
            model.trees.append(self.grown(rows, margin, k, features, set(range(len(self.numeric)))))
        working.drop_all_but(0)
        return model

    def grown(self, rows: DataFrame, margin: Column, k: int, features: list[str], numbers: set[int]) -> Tree:
        s = self.settings
        may = chosen(features, s.columns, s.seed, k)
        drawn = rows.where(unit_hash(F.lit("rows"), F.lit(str(s.seed)), F.lit(str(k)), F.col("key")) < s.subsample) if s.subsample < 1 else rows
        p = 1 / (1 + F.exp(-F.col("m")))
        fixed = lambda c: F.floor(c * UNIT + 0.5).cast("long")
        drawn = drawn.withColumn("m", margin).select("bins", fixed(F.col("w") * (p - F.col("y"))).alias("g"), fixed(F.col("w") * p * (1 - p)).alias("h"))
        splits: dict[int, Split] = {}
        totals: dict[int, tuple[int, int]] = {}
        open_: list[int] = [1]
        for level in range(s.depth + 1):
            if not open_:
                break
            at = drawn.withColumn("node", node_of(splits, F.col("bins"))).where(F.col("node").isin(open_))
            which = may if level < s.depth else may[:1]  # the last level only asks for its sums
            each = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.get("bins", F.lit(f)).alias("b")) for f in which]))
            sums = at.select("node", "g", "h", each.alias("x")).groupBy("node", "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            hist: dict[int, dict[tuple[int, int], tuple[int, int]]] = {i: {} for i in open_}
            for r in sums:
                hist[r["node"]][r["f"], r["b"]] = (r["g"], r["h"])
            below: list[int] = []
            for i in open_:
                one = [x for (f, _), x in hist[i].items() if f == which[0]]
                totals[i] = (sum(x[0] for x in one), sum(x[1] for x in one))
                found = best_split(hist[i], numbers, may, totals[i], s.l2, s.least_weight) if level < s.depth else None
                if found:
                    splits[i] = found[1]
                    below += [2 * i, 2 * i + 1]
            open_ = below
        leaves = {i: -s.rate * (g / UNIT) / (h / UNIT + s.l2) for i, (g, h) in totals.items() if i not in splits}
        return Tree(splits, leaves)
