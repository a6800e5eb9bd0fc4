"""Error measures as aggregates; rows where either side is null don't count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _both(a: Column, b: Column, x: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), x)


def mse(truth: Column, guess: Column) -> Column:
    return F.avg(_both(truth, guess, (truth - guess) * (truth - guess)))


def rmse(truth: Column, guess: Column) -> Column:
    return F.sqrt(mse(truth, guess))


def rmse_missing(observed: Column, truth: Column, guess: Column) -> Column:
    """RMSE over the steps that were not observed."""
    return F.sqrt(F.avg(F.when(observed.isNull(), (truth - guess) * (truth - guess))))


def r2(truth: Column, guess: Column) -> Column:
    """1 - residual sum of squares / total sum of squares; null if the truth is constant."""
    total = F.var_pop(_both(truth, guess, truth))
    return F.when(total > 0, 1 - mse(truth, guess) / total)


def r2_var(truth: Column, guess: Column, centre: Column) -> Column:
    """Share of squared deviations from ``centre`` that the guess explains."""
    return 1 - F.sum((truth - guess) * (truth - guess)) / F.sum((truth - centre) * (truth - centre))


def wape(truth: Column, guess: Column) -> Column:
    return F.sum(_both(truth, guess, F.abs(truth - guess))) / F.sum(_both(truth, guess, F.abs(truth)))


def symbol_error_rate(a: Column, b: Column) -> Column:
    return F.avg((a != b).cast("double"))
