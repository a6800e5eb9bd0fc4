"""Synthetic series as expressions over a range of steps (column ``t``)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def steps(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(0, n).withColumnRenamed("id", "t")


def harmonics(t: Column, n: int, sines: Sequence[tuple[float, float]] = (), cosines: Sequence[tuple[float, float]] = ()) -> Column:
    """Sum of amplitude * sin or cos(2 pi * periods * t / n); pairs are (amplitude, periods)."""
    total = F.lit(0.0)
    for amplitude, periods in sines:
        total = total + F.lit(amplitude) * F.sin(t * F.lit(2 * math.pi * periods / n))
    for amplitude, periods in cosines:
        total = total + F.lit(amplitude) * F.cos(t * F.lit(2 * math.pi * periods / n))
    return total


def power_trend(t: Column, exponent: float, scale: float = 1.0, shift: float = 0.0) -> Column:
    return F.lit(scale) * F.pow(t.cast("double"), F.lit(exponent)) + F.lit(shift)


def log_trend(t: Column, dampening: float = 1.0, shift: float = 0.0) -> Column:
    """dampening * log(t), 0 at step 0."""
    return F.when(t > 0, F.lit(dampening) * F.log(t.cast("double"))).otherwise(0.0) + F.lit(shift)


def negative_exponential_trend(t: Column, dampening: float, scale: float = 1.0, shift: float = 0.0) -> Column:
    return F.lit(scale) * F.exp(-t / F.lit(dampening)) + F.lit(shift)


def noise(std: Column | float, seed: int) -> Column:
    return F.randn(seed) * std


def mask(value: Column, p: float, seed: int) -> Column:
    """Each value kept with probability ``p``, else null."""
    return F.when(F.rand(seed) <= p, value)


def mask_runs(df: DataFrame, start_probability: float, max_run: int, seed: int, value: str = "value", order: str = "t", block: int = 100_000) -> DataFrame:
    """Runs of 1 to ``max_run`` values hidden, each starting at a step with the given probability.

    A step is hidden if a run that starts at most max_run - 1 steps before covers it.
    Blocks of steps are separate windows; a run ends with its block.
    """
    length = F.when(F.rand(seed) < start_probability, F.floor(F.rand(seed + 1) * max_run) + 1).otherwise(0)
    w = Window.partitionBy(F.floor(F.col(order) / block)).orderBy(order).rowsBetween(-(max_run - 1), 0)
    name = "run"
    while name in (c.lower() for c in df.columns):
        name += "_"
    ends = F.max(F.col(order) + F.col(name)).over(w)
    return df.withColumn(name, length).withColumn(value, F.when(ends > F.col(order), None).otherwise(F.col(value))).drop(name)


def arma(spark: SparkSession, n: int, ar: Sequence[float], ma: Sequence[float], std: float, seed: int, series: int = 1) -> DataFrame:
    """series, t, value of ARMA processes: x_t = sum ar_i x_(t-i) + e_t + sum ma_j e_(t-j), i and j from 1.

    Each series is a recursion, so one group; series run side by side.
    """

    def recurse(batch):
        import numpy as np
        import pandas as pd

        s = int(batch["series"].iloc[0])
        e = np.random.default_rng([seed, s]).normal(0, std, n)
        x = np.zeros(n)
        for t in range(n):
            x[t] = e[t] + sum(a * x[t - i] for i, a in enumerate(ar, 1) if i <= t) + sum(b * e[t - j] for j, b in enumerate(ma, 1) if j <= t)
        return pd.DataFrame({"series": s, "t": np.arange(n), "value": x})

    return spark.range(0, series).select(F.col("id").cast("int").alias("series")).groupBy("series").applyInPandas(recurse, "series int, t long, value double")
