"""Low-rank completion by alternating least squares over observed cells only."""

from __future__ import annotations

from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 11


def complete(cells: DataFrame, rank: int, ridge: float = 0.01, rounds: int = 10, seed: int = SEED, nonnegative: bool = False, clip: bool = True) -> DataFrame:
    """row, col, value, estimate of every cell of the grid; missing cells (null or absent) get estimates.

    Values are centred and scaled before the fit; with ``clip`` estimates stay
    within the observed range.
    """
    seen = cells.where("value is not null")
    stats = seen.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi")).first()
    if stats["m"] is None:
        return cells.select("row", "col", "value", F.lit(None).cast("double").alias("estimate"))
    scale, shift = (stats["s"] or 1.0), (0.0 if nonnegative else stats["m"])
    model = ALS(rank=rank, regParam=ridge, maxIter=rounds, seed=seed, userCol="row", itemCol="col", ratingCol="z", nonnegative=nonnegative, coldStartStrategy="nan").fit(
        seen.withColumn("z", ((F.col("value") - shift) / scale).cast("float"))
    )
    # The grid is what is asked for: every column for every row, a generator over the (few) columns.
    columns = cells.agg(F.array_sort(F.collect_set("col")).alias("cols"))
    grid = cells.select("row").distinct().join(F.broadcast(columns)).select("row", F.explode("cols").alias("col"))
    estimate = F.col("prediction") * scale + shift
    if clip:
        estimate = F.least(F.greatest(estimate, F.lit(stats["lo"])), F.lit(stats["hi"]))
    made = model.transform(grid).select("row", "col", F.nanvl(estimate.cast("double"), F.lit(shift)).alias("estimate"))
    return made.join(cells, ["row", "col"], "left").select("row", "col", "value", "estimate")
