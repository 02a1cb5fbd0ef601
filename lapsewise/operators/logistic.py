"""Logistic regression with a ridge term, by Newton steps on sufficient statistics.

A step is one aggregation: each task sums the gradient and the weighted outer products of its rows, the tasks' sums are
added, and the driver solves one system as wide as the feature vector. Steps go on until the largest change of a
coefficient is below TOLERANCE, halved where they do not lower the loss, so the result is the optimum itself and not a
place on the way to it: sums in another order move it by rounding only.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE, MOST_STEPS = 1e-12, 100


def statistics(weights: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Sums over a task's rows at these weights: loss, count, gradient and curvature, as one flat array."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = len(weights)
        total = np.zeros(2 + d + d * d)
        for frame in frames:
            if not len(frame):
                continue
            x = np.column_stack([np.ones(len(frame)), np.stack(frame["x"].to_numpy())])
            y, w = frame["y"].to_numpy(), frame["w"].to_numpy()
            m = x @ weights
            p = np.exp(-np.logaddexp(0.0, -m))
            total[0] += (w * (np.logaddexp(0.0, m) - y * m)).sum()
            total[1] += w.sum()
            total[2 : 2 + d] += x.T @ (w * (p - y))
            total[2 + d :] += ((x * (w * p * (1 - p))[:, None]).T @ x).ravel()
        yield pd.DataFrame({"sums": [total.tolist()]})

    return run


def newton(rows: DataFrame, width: int, ridge: float) -> np.ndarray:
    """Weights (intercept first) that minimise mean loss + ridge / 2 * squares of all but the intercept, for rows (x, y, w)."""
    penalty = np.full(width + 1, ridge)
    penalty[0] = 0.0

    def at(weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        parts = rows.mapInPandas(statistics(weights), "sums array<double>")
        # the tasks' sums, added place by place: one row for each place, d * d of them
        placed = parts.select(F.posexplode("sums").alias("place", "v")).groupBy("place").agg(F.sum("v").alias("v"))
        found = np.zeros(2 + len(weights) * (len(weights) + 1))
        for r in placed.collect():
            found[r["place"]] = r["v"]
        n, d = max(found[1], 1e-300), len(weights)
        loss = found[0] / n + 0.5 * (penalty * weights**2).sum()
        return loss, found[2 : 2 + d] / n + penalty * weights, found[2 + d :].reshape(d, d) / n + np.diag(penalty)

    weights = np.zeros(width + 1)
    loss, gradient, curvature = at(weights)
    for _ in range(MOST_STEPS):
        step = np.linalg.solve(curvature + 1e-12 * np.eye(width + 1), gradient)
        size = 1.0
        while True:
            new = at(weights - size * step)
            if new[0] <= loss + 1e-15 or size < 1e-6:
                break
            size /= 2
        weights = weights - size * step
        loss, gradient, curvature = new
        if np.abs(size * step).max() < TOLERANCE:
            break
    return weights


class LogisticModel(Model):
    def __init__(self, weights: list[float], features: str = "features"):
        super().__init__()
        self.weights, self.features = list(weights), features

    def _transform(self, df: DataFrame) -> DataFrame:
        terms = F.zip_with(vector_to_array(self.features), F.lit(self.weights[1:]), lambda a, b: a * b)
        margin = F.aggregate(terms, F.lit(float(self.weights[0])), lambda acc, v: acc + v)
        p = 1 / (1 + F.exp(-margin))
        return df.withColumn("probability", array_to_vector(F.array(1 - p, p)))

    def to_json(self) -> str:
        return json.dumps({"weights": self.weights, "features": self.features})

    @staticmethod
    def from_json(text: str) -> LogisticModel:
        return LogisticModel(**json.loads(text))


class ExactLogistic(Estimator):
    """Fits y on the vector column features; balanced weighs both classes alike."""

    def __init__(self, ridge: float = 0.01, balanced: bool = False, features: str = "features"):
        super().__init__()
        self.ridge, self.balanced, self.features = ridge, balanced, features

    def _fit(self, df: DataFrame) -> LogisticModel:
        rows = df.select(vector_to_array(self.features).alias("x"), F.col("y").cast("double").alias("y"))
        sizes = rows.agg(F.count("*").alias("n"), F.sum("y").alias("p"), F.max(F.size("x")).alias("width")).first()
        if not sizes["n"]:
            raise ValueError("no rows to fit")
        n, p = sizes["n"], sizes["p"]
        weight = F.when(F.col("y") > 0, n / (2 * p)).otherwise(n / (2 * (n - p))) if self.balanced and 0 < p < n else F.lit(1.0)
        rows = rows.withColumn("w", weight).persist(StorageLevel.MEMORY_AND_DISK)  # a lost part is read and prepared again
        try:
            return LogisticModel(newton(rows, sizes["width"], self.ridge).tolist(), self.features)
        finally:
            rows.unpersist()
