"""Fitting the sub-models of a series: one group of rows each, independent of one another.

A first build needs no sequential state: steps are dealt to the sub-models that
cover them, normalised and filled by windows inside these, and each sub-model is
decomposed in its own task. Only with an automatic rank does the first sub-model
go ahead, since all share its rank.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import layout, series
from ..session import cut
from . import kernels

SCHEMA = "model int, part string, series int, idx long, vec array<double>, val double"
PARTS = ("u", "uw", "v", "s", "weight", "bias", "model")


@dataclass(frozen=True)
class Options:
    """How to fit: entries in a sub-model, rank (None: automatic), columns to rows, fixed rows, fill or zero missing steps, normalise."""

    entries: int = 100_000
    rank: int | None = None
    ratio: float = 10.0
    rows: int | None = None
    fill: bool = True
    normalise: bool = True


@dataclass(frozen=True)
class Fitted:
    """Factor tables of the sub-models of one index (columns as in ``SCHEMA``), and what is needed to address them."""

    parts: DataFrame
    dims: layout.Dimensions
    series: int
    steps: int
    models: int
    rank: int
    observed: float

    @property
    def half(self) -> int:
        return self.dims.entries // self.series // 2

    def part(self, name: str) -> DataFrame:
        return self.parts.where(F.col("part") == name)

    @property
    def boundary(self) -> int:
        """The last step that the matrices cover."""
        row = self.part("model").agg(F.max(F.element_at("vec", 4) + F.element_at("vec", 1) * F.element_at("vec", 3))).first()
        return int(row[0]) - 1


def dealt(long: DataFrame, shapes: DataFrame, half: int, models: int) -> DataFrame:
    """Steps with each sub-model that covers them, within its matrix: model, series, t, value, row, segment, n_rows, segments, start."""
    covered = long.withColumn("model", F.explode(layout.covering(F.col("t"), half, models - 1)))
    # A few numbers for each sub-model (millions of steps).
    return layout.page(covered.join(F.broadcast(shapes), "model"))


def prepared(placed: DataFrame, options: Options, p: float) -> DataFrame:
    """``placed`` with mean, std and ``x``: normalised, with gaps filled (or zero, scaled by the observed share)."""
    stats = series.moments(placed, ["model", "series"])
    if not options.normalise:
        stats = stats.withColumn("mean", F.lit(0.0)).withColumn("std", F.lit(1.0))
    out = placed.join(stats, ["model", "series"]).withColumn("z", (F.col("value") - F.col("mean")) / F.col("std"))
    if options.fill:
        return series.fill(out, ["model", "series"], value="z", out="x").withColumn("x", F.coalesce("x", F.lit(0.0)))
    return out.withColumn("x", F.coalesce("z", F.lit(0.0)))


def _kernel(rank: int | None, p: float):
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["series", "t"])
        m, n, segments, start = (int(batch[c].iloc[0]) for c in ("model", "n_rows", "segments", "start"))
        names = batch["series"].unique()
        count = len(names)
        # Column segment * series + number, row the step within the segment.
        cube = batch["x"].to_numpy().reshape(count, segments, n)
        page = cube.transpose(2, 1, 0).reshape(n, segments * count)
        raw = batch["z"].to_numpy().reshape(count, segments, n).transpose(2, 1, 0).reshape(n, segments * count)
        k = None if rank is None else min(rank, n - 1, page.shape[1])
        u, s, v, every = kernels.truncated(page, k)
        if k is None:
            k = min(len(s), n - 1)
            u, s, v = u[:, :k], s[:k], v[:, :k]
        w, uw, _, _ = kernels.autoregression(u, s, v, page[-1] / p, p)
        low = (u * s) @ v.T / p
        rows: list[tuple] = [(m, "s", None, 0, s.tolist(), float(every[k]) if k < len(every) else 0.0)]
        rows += [(m, "u", None, i, x.tolist(), None) for i, x in enumerate(u)]
        rows += [(m, "uw", None, i, x.tolist(), None) for i, x in enumerate(uw)]
        rows += [(m, "v", int(names[j % count]), j // count, x.tolist(), None) for j, x in enumerate(v)]
        # Lag 0 is the most recent step.
        rows += [(m, "weight", None, i, None, float(x)) for i, x in enumerate(w[::-1])]
        for c, name in enumerate(names):
            own = batch[batch["series"] == name].iloc[0]
            mean, std = float(own["mean"]), float(own["std"])
            own_raw, own_low = raw[:, c::count], low[:, c::count]
            imputed = kernels.r_squared(own_raw.ravel(), own_low.ravel())
            forecast = kernels.r_squared(page[-1, c::count] / p, own_low[:-1].T @ w)
            rows.append((m, "bias", int(name), 0, None, (1 - float(w.sum())) * mean))
            rows.append((m, "model", int(name), 0, [n, segments * count, segments, start, mean, std, imputed, forecast], None))
        return pd.DataFrame(rows, columns=["model", "part", "series", "idx", "vec", "val"])

    return run


def fit(long: DataFrame, n: int, count: int, options: Options, only: int = 0, rank: int | None = None) -> Fitted:
    """Fit the sub-models from ``only`` on of ``n`` steps of ``count`` series (``long``: series, t, value)."""
    if n < 2:
        raise ValueError("a series needs two steps")
    dims = layout.dimensions(min(options.entries, n * count), options.ratio, count, options.rows)
    found = layout.shapes(n, dims, count, options.rows is not None)
    p = 1.0 if options.fill else float(long.agg(series.observed(long).alias("p")).first()["p"] or 1.0)
    table = layout.shape_table(long.sparkSession, [s for s in found if s.model >= only])
    half = dims.entries // count // 2
    ready = prepared(dealt(long, table, half, len(found)), options, p)
    rank = options.rank if rank is None else rank
    if rank is None:
        first = ready.where(F.col("model") == only).groupBy("model").applyInPandas(_kernel(None, p), SCHEMA)
        rank = first.where("part = 's'").select(F.size("vec").alias("k")).first()["k"]
    parts = cut(ready.groupBy("model").applyInPandas(_kernel(rank, p), SCHEMA))
    return Fitted(parts, dims, count, n, len(found), rank, p)


def scores(fitted: Fitted) -> DataFrame:
    """series, number of sub-models, mean imputation and forecast R2 over them (undefined ones left out)."""
    value = lambda i: F.nanvl(F.element_at("vec", i), F.lit(None))
    return fitted.part("model").groupBy("series").agg(
        F.count(F.lit(1)).alias("models"), F.avg(value(7)).alias("imputation_score"), F.avg(value(8)).alias("forecast_score")
    )


def out_of_sample(fitted: Fitted, long: DataFrame) -> DataFrame:
    """series, test_forecast_score: the weights of sub-model m - 2 on the matrix of m (no shared data), averaged over 1 < m < last."""
    shapes = fitted.part("model").select("model", F.element_at("vec", 1).cast("long").alias("n_rows"), F.element_at("vec", 3).cast("long").alias("segments"), F.element_at("vec", 4).cast("long").alias("start")).distinct()
    moments = fitted.part("model").select("model", "series", F.element_at("vec", 5).alias("mean"), F.element_at("vec", 6).alias("std"))
    placed = dealt(long, shapes, fitted.half, fitted.models).where((F.col("model") > 1) & (F.col("model") < fitted.models - 1))
    z = series.fill(placed.join(moments, ["model", "series"]).withColumn("z", (F.col("value") - F.col("mean")) / F.col("std")), ["model", "series"], value="z", out="x")
    weights = fitted.part("weight").select((F.col("model") + 2).alias("model"), F.col("idx").alias("lag"), F.col("val").alias("w"))
    # Row n - 2 - lag of a column meets weight lag; the last row is the truth.
    lagged = z.withColumn("lag", F.col("n_rows") - 2 - F.col("row"))
    guess = lagged.join(weights, ["model", "lag"]).groupBy("model", "series", "segment").agg(F.sum(F.col("x") * F.col("w")).alias("guess"))
    truth = z.where(F.col("row") == F.col("n_rows") - 1).select("model", "series", "segment", F.col("x").alias("truth"))
    both = truth.join(guess, ["model", "series", "segment"])
    from ..functions import metrics

    each = both.groupBy("model", "series").agg(metrics.r2(F.col("truth"), F.col("guess")).alias("score"))
    return each.groupBy("series").agg(F.avg("score").alias("test_forecast_score"))


def coefficients(fitted: Fitted, windows: tuple[int, ...] = (1, 2, 10, 20, 100)) -> DataFrame:
    """kind (weight or bias), series, idx, average and last<n>: means over all and over the newest sub-models.

    Only sub-models of the largest number of rows count: lags of a shorter last one mean something else.
    """
    shapes = fitted.part("model").select("model", F.element_at("vec", 1).alias("n_rows")).distinct()
    full = shapes.agg(F.max(F.struct("n_rows", "model")).alias("m"), F.max("n_rows").alias("n_rows")).first()
    newest = full["m"]["model"]
    alike = shapes.where(F.col("n_rows") == full["n_rows"]).select("model")
    rows = fitted.parts.where("part in ('weight', 'bias')").join(F.broadcast(alike), "model")
    means = [F.avg(F.when(F.col("model") > newest - w, F.col("val"))).alias(f"last{w}") for w in windows]
    return rows.groupBy(F.col("part").alias("kind"), "series", "idx").agg(F.avg("val").alias("average"), *means)


def residuals(long: DataFrame, denoised: DataFrame, direct: bool = True) -> DataFrame:
    """Observations of the variance: squared residuals (direct) or squared values; series, t, value."""
    if not direct:
        return long.withColumn("value", F.col("value") * F.col("value"))
    both = long.join(denoised, ["series", "t"], "left")
    return both.select("series", "t", F.pow(F.col("value") - F.col("estimate"), 2).alias("value"))


__all__ = ["Fitted", "Options", "coefficients", "dealt", "fit", "out_of_sample", "prepared", "residuals", "scores"]
