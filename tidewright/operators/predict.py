"""Answering from fitted sub-models: imputation, forecasts, confidence bounds."""

from __future__ import annotations

from math import sqrt
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import layout
from . import kernels
from .fit import Fitted


def _estimates(fitted: Fitted, steps: DataFrame, models: F.Column) -> DataFrame:
    """series, t, estimate: the mean over the given sub-models that cover a step of u s v' / p, back in the series' units."""
    info = fitted.part("model").select(
        "model", "series", *(F.element_at("vec", i).cast("long").alias(c) for i, c in ((1, "n_rows"), (3, "segments"), (4, "start"))), F.element_at("vec", 5).alias("mean"), F.element_at("vec", 6).alias("std")
    )
    placed = layout.page(steps.withColumn("model", F.explode(models)).join(info, "model"))
    u = fitted.part("u").select("model", F.col("idx").alias("row"), F.col("vec").alias("u"))
    v = fitted.part("v").select("model", "series", F.col("idx").alias("segment"), F.col("vec").alias("v"))
    s = fitted.part("s").select("model", F.col("vec").alias("s"))
    cells = placed.join(u, ["model", "row"]).join(v, ["model", "series", "segment"]).join(s, "model")
    us = F.zip_with("u", "s", lambda a, b: a * b)
    dot = F.aggregate(F.zip_with(us, F.col("v"), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    value = dot / fitted.observed * F.col("std") + F.col("mean")
    return cells.groupBy("series", "t").agg(F.avg(value).alias("estimate"))


def impute(fitted: Fitted, steps: DataFrame) -> DataFrame:
    """series, t, estimate of modelled steps (``steps``: t)."""
    return _estimates(fitted, steps, layout.serving(F.col("t"), fitted.half, fitted.models - 1))


def denoise(fitted: Fitted, first: int = 0) -> DataFrame:
    """series, t, estimate of the whole series from step ``first``: the mean over all sub-models that cover a step."""
    steps = fitted.parts.sparkSession.range(first, fitted.steps).withColumnRenamed("id", "t")
    return _estimates(fitted, steps, layout.covering(F.col("t"), fitted.half, fitted.models - 1))


def averaged(coefficients: DataFrame, averaging: str = "average") -> tuple[np.ndarray, dict[int, float]]:
    """Weights, the most recent lag first, and biases: as many numbers as a matrix has rows."""
    column = averaging.lower()
    if column not in coefficients.columns:
        raise ValueError(f"no averaging {averaging!r}")
    # A newest sub-model with fewer rows has fewer lags.
    rows = coefficients.select("kind", "series", "idx", F.col(column).alias("x")).where("x is not null").collect()
    weights = sorted((r["idx"], r["x"]) for r in rows if r["kind"] == "weight")
    return np.array([x for _, x in weights]), {r["series"]: r["x"] for r in rows if r["kind"] == "bias"}


def forecast(
    fitted: Fitted, coefficients: DataFrame, lags: DataFrame, first: int, last: int, averaging: str = "average", projected: bool = False, squared: bool = False
) -> DataFrame:
    """series, t, estimate of steps ``first`` .. ``last``, a recursion on the last values of each series.

    ``lags`` (series, t, value) are the steps before the recursion starts; missing
    ones are filled (or zero and scaled, as the index was fitted). It starts after
    their last step, which may be before ``first``. With ``projected``, the lag
    vectors of as many steps as there are lags (those that hold an observed value)
    are projected on the left factors of the last but one sub-model.
    """
    weights, biases = averaged(coefficients, averaging)
    oldest_first = weights[::-1].copy()
    p = fitted.observed
    projection = None
    if projected:
        chosen = max(fitted.models - 2, 0)
        rows = fitted.part("uw").where(F.col("model") == chosen).select("idx", "vec").collect()
        uw = np.array([r["vec"] for r in sorted(rows, key=lambda r: r["idx"])])
        if len(uw) != len(weights):
            raise ValueError("the sub-model before the last has another number of rows than the averaged weights, so lags can't be projected")
        projection = uw @ uw.T

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("t")
        x = batch["value"].astype("float64")
        x = x.fillna(0.0) / p if p < 1 else x.ffill().bfill().fillna(0.0)
        values = x.to_numpy() ** 2 if squared else x.to_numpy()
        if len(values) < len(oldest_first):
            values = np.concatenate([np.full(len(oldest_first) - len(values), values[0] if len(values) else 0.0), values])
        number, end = int(batch["series"].iloc[0]), int(batch["t"].iloc[-1])
        out = kernels.recurse(values, oldest_first, biases.get(number, 0.0), last - end, projection, len(weights))
        return pd.DataFrame({"series": number, "t": np.arange(end + 1, last + 1), "estimate": out})

    # As many rows as lags for each series.
    made = lags.groupBy("series").applyInPandas(run, "series int, t long, estimate double")
    return made.where(F.col("t") >= first)


def width(c: float, method: str = "Gaussian") -> float:
    """Standard deviations on each side for ``c`` percent confidence."""
    if not 0 <= c < 100:
        raise ValueError("c must be at least 0 and below 100")
    if method.lower() == "gaussian":
        return NormalDist().inv_cdf(0.5 + c / 200)
    if method.lower() == "chebyshev":
        return 1 / sqrt(1 - c / 100)
    raise ValueError("the method must be Gaussian or Chebyshev")


def bounded(mean: DataFrame, variance: DataFrame | None, c: float = 95.0, method: str = "Gaussian", direct: bool = True) -> DataFrame:
    """series, t, prediction, lb, ub; without a variance both bounds are the prediction."""
    if variance is None:
        return mean.select("series", "t", F.col("estimate").alias("prediction"), F.col("estimate").alias("lb"), F.col("estimate").alias("ub"))
    alpha = width(c, method)
    both = mean.withColumnRenamed("estimate", "prediction").join(variance.withColumnRenamed("estimate", "var"), ["series", "t"])
    var = F.col("var") if direct else F.col("var") - F.col("prediction") * F.col("prediction")
    deviation = F.sqrt(F.greatest(var, F.lit(0.0))) * alpha
    return both.select("series", "t", "prediction", (F.col("prediction") - deviation).alias("lb"), (F.col("prediction") + deviation).alias("ub"))


__all__ = ["averaged", "bounded", "denoise", "forecast", "impute", "width"]
