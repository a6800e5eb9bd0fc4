"""Robust synthetic control: a treated unit as a combination of donors' denoised series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def panel(df: DataFrame, unit: str, time: str, value: str, units: list | None = None) -> DataFrame:
    """One row a time, one column a unit (averages; null where nothing was observed)."""
    return df.groupBy(time).pivot(unit, units).agg(F.avg(value))


def synthetic_control(
    df: DataFrame, unit: str, time: str, target: str, metrics: dict[str, float], train_until: object, rank: int, donors: list[str] | None = None
) -> DataFrame:
    """metric, time, actual, synthetic, weight-trained on times up to ``train_until``.

    Several metrics are stacked, each scaled by the root of its weight, so all share
    one set of donor weights. Donors are denoised by a truncated SVD over all times.
    Long form in and out; the donors' Gram matrix is summed by Spark, and only it
    (donors x donors) reaches the driver.
    """
    scale = F.coalesce(*(F.when(F.col("metric") == m, float(np.sqrt(w))) for m, w in metrics.items()))
    pairs = ", ".join(f"'{m}', `{m}`" for m in metrics)
    long = df.selectExpr(f"cast(`{unit}` as string) as unit", f"`{time}` as time", f"stack({len(metrics)}, {pairs}) as (metric, value)")
    long = long.groupBy("metric", "time", "unit").agg(F.avg("value").alias("value"))
    if donors is None:
        donors = sorted(r["unit"] for r in long.where(F.col("unit") != target).select("unit").distinct().collect())
    # One row a metric and time: the donors' values in order, missing ones 0 as share-scaled below.
    wide = long.where(F.col("unit").isin([target, *donors])).groupBy("metric", "time").agg(F.map_from_entries(F.collect_list(F.struct("unit", "value"))).alias("m"))
    p = wide.select(F.avg(F.aggregate(F.array(*(F.when(F.element_at("m", d).isNotNull(), 1.0).otherwise(0.0) for d in donors)), F.lit(0.0), lambda a, x: a + x) / len(donors))).first()[0]
    x = F.array(*(F.coalesce(F.try_element_at("m", F.lit(d)), F.lit(0.0)) for d in donors))
    rows = wide.select("metric", "time", F.try_element_at("m", F.lit(target)).alias("actual"), F.transform(x, lambda v: v * scale / p).alias("x"), scale.alias("scale"))
    gram = np.array(_gram(rows.select("x"), len(donors)))
    values, vectors = np.linalg.eigh(gram)
    top = vectors[:, np.argsort(-values)[:rank]]
    # Denoised donors are x projected on the leading directions.
    trained = rows.where((F.col("time") <= F.lit(train_until)) & F.col("actual").isNotNull())
    scores = _project(trained, top)
    d = rank = top.shape[1]
    both = np.array(_gram(scores.select(F.concat(F.col("z"), F.array(F.col("actual") * F.col("scale"))).alias("x")), d + 1))
    beta = np.linalg.pinv(both[:rank, :rank], rcond=1e-10) @ both[:rank, rank]
    z = _project(rows, top)
    dot = F.aggregate(F.zip_with(F.col("z"), F.array(*(F.lit(float(b)) for b in beta)), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    return z.select("metric", "time", "actual", (dot / F.col("scale")).alias("synthetic"))


def _project(rows: DataFrame, directions: np.ndarray) -> DataFrame:
    parts = [
        F.aggregate(F.zip_with(F.col("x"), F.array(*(F.lit(float(v)) for v in column)), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v) for column in directions.T
    ]
    return rows.withColumn("z", F.array(*parts))


def _gram(rows: DataFrame, d: int) -> np.ndarray:
    """Sum of x x' over the rows: each task sums its own, then d x d numbers a task are added up."""
    from collections.abc import Iterator

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((d, d))
        for batch in batches:
            if len(batch):
                x = np.array(batch["x"].tolist(), dtype=float)
                total += x.T @ x
        i, j = np.triu_indices(d)
        yield pd.DataFrame({"i": i, "j": j, "v": total[i, j]})

    sums = rows.mapInPandas(add, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((d, d))
    for r in sums:
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out
