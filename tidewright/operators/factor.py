"""Matrix factorisations of a table of vectors (id, x array<double>), one row a data point.

Rows stay distributed. A step maps over them with the small factor (k vectors of
d numbers) and adds up d x k and k x k sums, so data of any number of rows takes
the same memory; the small factor is all that the driver holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 7
#: A factorisation stops once a round changes the Frobenius error by less than this, over the number of rows.
CHANGE = 1e-8
#: Added to distances before their logs.
LEAST = 1e-8
#: Rows of a bucket of draws, more or less.
BUCKET_ROWS = 10_000


def _sums(rows: DataFrame, step: Callable[[np.ndarray], tuple[np.ndarray, ...]], names: str) -> list[np.ndarray]:
    """Element-wise sums over all rows of the arrays that ``step`` makes of a batch."""
    columns = names.split()

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: list[np.ndarray] | None = None
        for batch in batches:
            if len(batch):
                made = step(np.array(batch["x"].tolist(), dtype=float))
                total = list(made) if total is None else [a + b for a, b in zip(total, made, strict=True)]
        if total is not None:
            for name, array in zip(columns, total, strict=True):
                yield pd.DataFrame({"name": name, "at": np.arange(array.size), "value": array.ravel(), "width": array.shape[-1]})

    found = rows.select("x").mapInPandas(add, "name string, at long, value double, width int").groupBy("name", "at").agg(F.sum("value").alias("v"), F.max("width").alias("w")).collect()
    out = []
    for name in columns:
        own = sorted((r["at"], r["v"], r["w"]) for r in found if r["name"] == name)
        out.append(np.array([v for _, v, _ in own]).reshape(-1, own[0][2]) if own else np.zeros((0, 0)))
    return out


def _map(rows: DataFrame, step: Callable[[np.ndarray], np.ndarray], name: str = "h") -> DataFrame:
    """``rows`` with an array column made of each batch."""

    @F.pandas_udf("array<double>")
    def made(x: pd.Series) -> pd.Series:
        return pd.Series(list(step(np.array(x.tolist(), dtype=float)))) if len(x) else pd.Series([], dtype=object)

    return rows.withColumn(name, made("x"))


def gram_svd(rows: DataFrame, k: int, centre: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Right vectors (d x k), singular values, and the mean: by the eigenvectors of the summed Gram matrix."""
    gram, total, n = _sums(rows, lambda x: (x.T @ x, x.sum(axis=0, keepdims=True), np.array([[float(len(x))]])), "gram total n")
    mean = total[0] / n[0, 0] if centre else np.zeros(gram.shape[0])
    values, vectors = np.linalg.eigh(gram - (n[0, 0] * np.outer(mean, mean) if centre else 0))
    order = np.argsort(-values)[:k]
    v = vectors[:, order]
    sign = np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    return v * sign, np.sqrt(np.maximum(values[order], 0)), mean


def pca(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` with ``h``: coordinates on the k leading directions of the centred data."""
    v, _, mean = gram_svd(rows, k, centre=True)
    return _map(rows, lambda x: (x - mean) @ v)


def pseudo_inverse(rows: DataFrame, k: int | None = None) -> np.ndarray:
    """(X'X)^+ , from which X^+ = (X'X)^+ X' is a projection of the rows."""
    v, s, _ = gram_svd(rows, k or 10**9)
    keep = s > 1e-10 * s.max()
    return (v[:, keep] / s[keep] ** 2) @ v[:, keep].T


def _start(rows: DataFrame, k: int) -> np.ndarray:
    """k rows of the smallest seeded hash of their id, as the first small factor."""
    return np.array([r["x"] for r in rows.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(k).select("x").collect()], dtype=float)


def _settled(errors: list[float], w: np.ndarray, sums: tuple[np.ndarray, ...]) -> bool:
    """Add the Frobenius error of the weights that made the sums (h'x, h'h, squares of x, rows); True if it hardly changed."""
    top, square, norm, n = sums
    if not n.size:
        return True
    errors.append(float(np.sqrt(max(norm[0, 0] - 2 * (top * w).sum() + (square * (w @ w.T)).sum(), 0.0))))
    return len(errors) > 1 and abs(errors[-1] - errors[-2]) / n[0, 0] < CHANGE


def _products(x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    return h.T @ x, h.T @ h, np.array([[(x * x).sum()]]), np.array([[float(len(x))]])


def errors(rows: DataFrame, w: np.ndarray) -> DataFrame:
    """frobenius, residual of factors (rows with x and h, small factor w): the norm of x - h w, and its absolute sum in percent of that of x."""
    zero = F.array_repeat(F.lit(0.0), int(w.shape[1]))
    small = F.array(*(F.array(*(F.lit(float(v)) for v in row)) for row in w))
    made = F.aggregate(F.zip_with("h", small, lambda a, row: F.transform(row, lambda v: v * a)), zero, lambda s, row: F.zip_with(s, row, lambda a, b: a + b))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    apart = rows.select("x", F.zip_with("x", made, lambda a, b: a - b).alias("e"))
    parts = apart.select(add(F.transform("e", lambda v: v * v)).alias("square"), add(F.transform("e", F.abs)).alias("off"), add(F.transform("x", F.abs)).alias("all"))
    return parts.agg(F.sqrt(F.sum("square")).alias("frobenius"), (100 * F.sum("off") / F.sum("all")).alias("residual"))


def _solve_nonnegative(x: np.ndarray, w: np.ndarray, rounds: int = 50, h: np.ndarray | None = None) -> np.ndarray:
    """Non-negative h with h w close to x, by multiplicative steps."""
    h = np.full((len(x), len(w)), 0.5) if h is None else h
    top, square = np.maximum(x @ w.T, 0), w @ w.T
    for _ in range(rounds):
        h *= top / np.maximum(h @ square, 1e-12)
    return h


def nmf(rows: DataFrame, k: int, rounds: int = 20) -> tuple[np.ndarray, DataFrame]:
    """Non-negative factors: the small one (k x d, unit rows) and the rows' weights ``h``; at most ``rounds`` rounds, fewer once the error hardly changes."""
    w = np.maximum(_start(rows, k), 1e-6)
    course: list[float] = []
    for _ in range(rounds):
        w /= np.linalg.norm(w, axis=1, keepdims=True)
        fixed = w.copy()

        def step(x: np.ndarray) -> tuple[np.ndarray, ...]:
            return _products(x, _solve_nonnegative(x, fixed))  # noqa: B023

        sums = _sums(rows, step, "top square norm n")
        if _settled(course, w, sums):
            break
        top, square = sums[:2]
        w = w * np.maximum(top, 0) / np.maximum(square @ w, 1e-12)
    w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-12)
    return w, _map(rows, lambda x: _solve_nonnegative(x, w))


def semi_nmf(rows: DataFrame, k: int, rounds: int = 20) -> tuple[np.ndarray, DataFrame]:
    """A small factor of any sign, and non-negative weights of the rows; stops early as ``nmf`` does."""
    w = _start(rows, k)

    def weights(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        h = np.full((len(x), len(w)), 1.0 / len(w))
        top, square = x @ w.T, w @ w.T
        plus, minus = (np.abs(top) + top) / 2, (np.abs(top) - top) / 2
        splus, sminus = (np.abs(square) + square) / 2, (np.abs(square) - square) / 2
        for _ in range(30):
            h *= np.sqrt((plus + h @ sminus) / np.maximum(minus + h @ splus, 1e-12))
        return h

    course: list[float] = []
    for _ in range(rounds):
        fixed = w.copy()

        def step(x: np.ndarray) -> tuple[np.ndarray, ...]:
            return _products(x, weights(x, fixed))  # noqa: B023

        sums = _sums(rows, step, "top square norm n")
        if _settled(course, w, sums):
            break
        top, square = sums[:2]
        w = np.linalg.pinv(square) @ top
    return w, _map(rows, lambda x: weights(x, w))


def kmeans(rows: DataFrame, k: int, seed: int = SEED) -> DataFrame:
    """``rows`` with ``cluster``."""
    v = rows.withColumn("features", array_to_vector("x"))
    return KMeans(k=k, seed=seed).fit(v).transform(v).withColumn("cluster", F.col("prediction")).drop("features", "prediction")


def kmeans_centres(rows: DataFrame, k: int, seed: int = SEED) -> np.ndarray:
    v = rows.withColumn("features", array_to_vector("x"))
    return np.array(KMeans(k=k, seed=seed).fit(v).clusterCenters())


def cmeans(rows: DataFrame, k: int, exponent: float = 1.75, rounds: int = 15) -> tuple[np.ndarray, DataFrame]:
    """Fuzzy clusters: centres and memberships ``h``."""
    w = _start(rows, k)

    def membership(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        d = np.maximum(((x[:, None, :] - w[None]) ** 2).sum(axis=2), 1e-12) ** (-1 / (exponent - 1))
        return d / d.sum(axis=1, keepdims=True)

    course: list[float] = []
    for _ in range(rounds):
        fixed = w.copy()

        def step(x: np.ndarray) -> tuple[np.ndarray, ...]:
            h = membership(x, fixed)  # noqa: B023
            raised = h**exponent
            return *_products(x, h), raised.T @ x, raised.sum(axis=0)[:, None]

        *sums, top, weight = _sums(rows, step, "cross square norm n top weight")
        if _settled(course, w, sums):
            break
        w = top / np.maximum(weight, 1e-12)
    return w, _map(rows, lambda x: membership(x, w))


def farthest(rows: DataFrame, k: int) -> list[int]:
    """Ids picked farthest-first, from the row farthest from the mean: one pass of an aggregate a pick; ties to the smaller id."""
    mean = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("v")).orderBy("i").collect()
    picked: list[int] = []
    near = F.lit(float("inf"))
    last = [r["v"] for r in mean]
    for step in range(k):
        d = distance(F.col("x"), F.array(*(F.lit(float(v)) for v in last)), "l2")
        near = d if step <= 1 else F.least(near, d)
        best = rows.where(~F.col("id").isin(picked)).agg(F.max_by(F.struct("id", "x"), F.struct(near, -F.col("id"))).alias("b")).first()["b"]
        if best is None:
            break
        picked.append(best["id"])
        last = best["x"]
    return picked


def simplex_rows(rows: DataFrame, k: int, kind: str = "l2") -> list[int]:
    """Ids of ``k`` rows that span a simplex of large volume: one pass of an aggregate a pick; ties to the smaller id.

    The first is found by three jumps to the farthest row, from that of the smallest id
    on. With D the logs of a row's distances to the l picks so far and a the log of the
    last jump, the next pick has the greatest (S^2 - Q) / 2 + a S - l Q / 2, where S is the
    sum of D and Q that of its squares. A table of no rows gives no picks.
    """

    def most(score: Column) -> tuple | None:
        best = rows.agg(F.max(F.struct(score.alias("score"), (-F.col("id")).alias("order"), F.col("id"), F.col("x"))).alias("b")).first()["b"]
        return best and (best["id"], best["x"], best["score"])

    def apart(x: list[float]) -> Column:
        return distance(F.col("x"), F.array(*(F.lit(float(v)) for v in x)), kind)

    at = most(F.lit(0.0))
    for _ in range(3):
        at = at and most(apart(at[1]))
    if not at:
        return []
    a = F.lit(float(np.log(max(at[2], LEAST))))
    picked, total, square = [at[0]], F.lit(0.0), F.lit(0.0)
    for n in range(1, k):
        d = F.log(apart(at[1]) + LEAST)
        total, square = total + d, square + d * d
        at = most((total * total - square) / 2 + a * total - n / 2 * square)
        picked.append(at[0])
    return picked


def cur_columns(rows: DataFrame, c: int, seed: int = SEED, leverage: int | None = None) -> DataFrame:
    """id, copies: exactly ``c`` draws of rows by squared norm, or by leverage on the first ``leverage`` directions; repeats are merged.

    Draws are the positions of c seeded uniform numbers in each row's cumulative share;
    rows without weight are never drawn, and without any weight the result is empty.
    """
    if leverage:
        v, s, _ = gram_svd(rows, leverage)
        weighed = _map(rows, lambda x: ((x @ v / np.maximum(s, 1e-12)) ** 2).sum(axis=1, keepdims=True)).withColumn("weight", F.element_at("h", 1))
    else:
        weighed = rows.withColumn("weight", F.aggregate("x", F.lit(0.0).cast("double"), lambda a, x: a + x * x))
    # The cumulative share in two levels: buckets of rows by hash, then the rows of a bucket in which draws fall.
    weighed = weighed.where("weight > 0")
    buckets = weighed.count() // BUCKET_ROWS + 1
    weighed = weighed.withColumn("bucket", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(buckets)))
    sums = weighed.groupBy("bucket").agg(F.sum("weight").alias("s")).orderBy("bucket").collect()
    ends = np.cumsum([r["s"] for r in sums])
    drawn: dict[int, list[float]] = {}
    for u in np.random.default_rng(seed).random(c) * ends[-1] if sums else ():
        at = min(int(np.searchsorted(ends, u, side="right")), len(sums) - 1)
        drawn.setdefault(sums[at]["bucket"], []).append(float(u - (ends[at - 1] if at else 0.0)))
    draws = rows.sparkSession.createDataFrame(list(drawn.items()), "bucket long, places array<double>")
    w = Window.partitionBy("bucket").orderBy("id")
    end = F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, 0))
    placed = weighed.join(F.broadcast(draws), "bucket").withColumn("end", end)
    placed = placed.withColumn("start", F.lag("end", 1, 0.0).over(w)).withColumn("last", F.lead("end").over(w).isNull())
    # The last row takes what rounding puts past a bucket's end.
    copies = F.size(F.filter("places", lambda u: (u >= F.col("start")) & ((u < F.col("end")) | F.col("last"))))
    return placed.withColumn("copies", copies).where("copies > 0").select("id", "copies")


def distance(a, b, kind: str):
    """l1, l2, cosine, abs_cosine or kl distance of two array columns."""
    add = lambda c: F.aggregate(c, F.lit(0.0).cast("double"), lambda s, v: s + v)
    if kind == "l1":
        return add(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    if kind == "l2":
        return F.sqrt(add(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))
    if kind == "kl":
        return add(F.zip_with(a, b, lambda x, y: F.when((x > 0) & (y > 0), x * F.log(x / y) - x + y).otherwise(y - x)))
    norm = lambda c: F.sqrt(add(F.transform(c, lambda x: x * x)))
    cosine = add(F.zip_with(a, b, lambda x, y: x * y)) / (norm(a) * norm(b))
    if kind == "cosine":
        return 1 - cosine
    if kind == "abs_cosine":
        return 1 - F.abs(cosine)
    raise ValueError(f"no distance {kind!r}")


def assign(rows: DataFrame, centres: list[tuple[int, list[float]]], kind: str = "l2") -> DataFrame:
    """``rows`` with the nearest of a few given centres and its distance; ties to the smaller number."""
    found = F.array_sort(F.array(*(F.struct(distance(F.col("x"), F.array(*(F.lit(float(v)) for v in c)), kind).alias("distance"), F.lit(i).alias("centre")) for i, c in centres)))
    return rows.withColumn("near", F.get(found, 0)).select("*", "near.centre", "near.distance").drop("near")


__all__ = ["assign", "cmeans", "cur_columns", "distance", "errors", "farthest", "gram_svd", "kmeans", "kmeans_centres", "nmf", "pca", "pseudo_inverse", "semi_nmf", "simplex_rows"]
