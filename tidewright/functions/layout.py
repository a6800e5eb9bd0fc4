"""Sub-models and Page matrices as integer arithmetic.

A series of rows is covered by sub-models of ``T`` entries (rows times series)
that overlap by half; each is laid out as an N x M matrix whose column j of a
series holds the rows j * N .. j * N + N - 1 of the sub-model.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dimensions:
    """Rows and columns of a full sub-model, entries in it, and the ratio of columns to rows."""

    rows: int
    columns: int
    entries: int
    ratio: float


def dimensions(entries: int, ratio: float = 10.0, series: int = 1, rows: int | None = None) -> Dimensions:
    """Sizes for about ``entries``: rows from the ratio unless given; columns a multiple of twice the series."""
    if rows is None:
        rows = int(sqrt(entries / ratio))
        if rows < 2:
            raise ValueError("too few entries for two rows")
        columns = int(rows * ratio)
    else:
        if rows < 2:
            raise ValueError("a sub-model needs two rows")
        columns = int(entries / rows)
    if columns % (2 * series):
        columns += 2 * series - columns % (2 * series)
    if columns < series:
        raise ValueError("fewer columns than series")
    return Dimensions(rows, columns, rows * columns, columns / rows)


@dataclass(frozen=True)
class Shape:
    """One sub-model: first step, steps covered, matrix rows, segments (columns of each series)."""

    model: int
    start: int
    steps: int
    rows: int
    segments: int


def shapes(n: int, dims: Dimensions, series: int = 1, fixed_rows: bool = False) -> list[Shape]:
    """The sub-models of ``n`` steps, a closed form: model m covers steps m * h .. m * h + 2h - 1, the last what is left."""
    half = dims.entries // series // 2
    total = n * series
    count = int(max((total - 1) / (half * series) - 1, 0)) + 1 if n else 0
    out = []
    for m in range(count):
        start = m * half
        steps = n - start if m == count - 1 else min(2 * half, n - start)
        size = steps * series
        rows = dims.rows if fixed_rows else int(sqrt(size / dims.ratio + 1e-9))
        rows = max(2, min(rows, steps)) if steps >= 2 else steps
        columns = size // rows if rows else 0
        columns -= columns % series
        if columns < series:
            raise ValueError("a sub-model has fewer columns than series")
        out.append(Shape(m, start, steps, rows, columns // series))
    return out


def shape_table(spark, found: list[Shape]) -> DataFrame:
    """The shapes as a table, one row a sub-model: some millions of steps each, so it stays small."""
    return spark.createDataFrame([(s.model, s.start, s.steps, s.rows, s.segments) for s in found], "model int, start long, steps long, n_rows long, segments long")


def covering(t: Column, half: int, last: int) -> Column:
    """The sub-models that cover a step, as an array: floor(t / h) - 1 and floor(t / h), within 0 .. last."""
    hi = F.least(F.floor(t / half), F.lit(last)).cast("int")
    lo = F.greatest(hi - F.when(F.floor(t / half) > last, 0).otherwise(1), F.lit(0)).cast("int")
    return F.sequence(lo, hi)


def serving(t: Column, half: int, last: int) -> Column:
    """The sub-models that answer for a step: the two that cover it, but from the last but one on only one."""
    m = F.greatest(F.floor(t / half) - 1, F.lit(0)).cast("int")
    return F.when(m < last - 1, F.array(m, m + 1)).otherwise(F.array(F.least(m, F.lit(last))))


def page(df: DataFrame) -> DataFrame:
    """row and segment of each step of a sub-model; ``df`` has t, start, n_rows, segments. Steps beyond the matrix go."""
    x = F.col("t") - F.col("start")
    placed = df.withColumn("row", F.pmod(x, F.col("n_rows"))).withColumn("segment", F.floor(x / F.col("n_rows")))
    return placed.where((F.col("segment") >= 0) & (F.col("segment") < F.col("segments")))
