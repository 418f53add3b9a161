"""Diagonal Gaussian mixtures by relational expectation-maximisation.

Points are rows (key, dim, x), a mixture is a small table (component, dim, mean, var, weight). The E step joins
each number with its dimension's parameters, the M step is a grouped sum; parameters are staged between
rounds, so each round's plan is as long as the first, and no point leaves the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import staged


def log_densities(points: DataFrame, mixture: DataFrame, key: str = "key") -> DataFrame:
    """(key, component, l): the log of each component's weight times its density."""
    term = -0.5 * (F.log(2 * math.pi * F.col("var")) + (F.col("x") - F.col("mean")) * (F.col("x") - F.col("mean")) / F.col("var"))
    return points.join(mixture, "dim").groupBy(key, "component").agg((F.sum(term) + F.log(F.max("weight"))).alias("l"))


def log_likelihoods(points: DataFrame, mixture: DataFrame, key: str = "key") -> DataFrame:
    """(key, log_likelihood) under the whole mixture."""
    l = log_densities(points, mixture, key)  # noqa: E741
    top = l.groupBy(key).agg(F.max("l").alias("top"), F.collect_list("l").alias("all"))  # a number for each component
    return top.select(key, (F.col("top") + F.log(F.aggregate("all", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))).alias("log_likelihood"))


def step(points: DataFrame, mixture: DataFrame, ridge: float, key: str = "key") -> DataFrame:
    """The mixture after one round; variances grow by ``ridge``, a component that no point has goes."""
    l = log_densities(points, mixture, key)  # noqa: E741
    whole = log_likelihoods(points, mixture, key)
    r = l.join(whole, key).select(key, "component", F.exp(F.col("l") - F.col("log_likelihood")).alias("r"))
    sums = points.join(r, key).groupBy("component", "dim").agg(F.sum("r").alias("n"), F.sum(F.col("r") * F.col("x")).alias("sx"), F.sum(F.col("r") * F.col("x") * F.col("x")).alias("sxx"))
    total = r.agg(F.sum("r").alias("total"))
    mean = F.col("sx") / F.col("n")
    return sums.where("n > 1e-12").crossJoin(total).select("component", "dim", mean.alias("mean"), (F.greatest(F.col("sxx") / F.col("n") - mean * mean, F.lit(0.0)) + ridge).alias("var"), (F.col("n") / F.col("total")).alias("weight"))


def fit(points: DataFrame, start: DataFrame, rounds: int = 10, ridge: float = 1e-3, key: str = "key") -> DataFrame:
    """The mixture (component, dim, mean, var, weight) after so many rounds from ``start``."""
    now = staged(start.select("component", "dim", "mean", "var", "weight"), "mixture")
    for _ in range(rounds):
        now = staged(step(points, now, ridge, key), "mixture")
    return now


def log_ratio(points: DataFrame, first: DataFrame, second: DataFrame, clip: float = 10.0, key: str = "key") -> DataFrame:
    """(key, llr): how much likelier the first mixture makes each point, within the clip."""
    a = log_likelihoods(points, first, key)
    b = log_likelihoods(points, second, key).withColumnRenamed("log_likelihood", "other")
    return a.join(b, key).select(key, F.greatest(F.lit(-clip), F.least(F.lit(clip), F.col("log_likelihood") - F.col("other"))).alias("llr"))
