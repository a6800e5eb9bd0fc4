"""A lower bound on the error of predicting a series' symbols.

The last observations become symbols (SQL), their Lempel-Ziv compression ratio is
turned into an entropy by a line fitted on random sources (one row each, spread
over tasks), and Fano's inequality turns the entropy into an error rate.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

METHODS = ("quantization", "change", "None")
SEED = 1729


def latest(df: DataFrame, time: str, value: str, n: int) -> DataFrame:
    """t and value of the ``n`` last rows."""
    return df.select(F.col(time).alias("t"), F.col(f"`{value}`").cast("double").alias("value")).orderBy(F.desc("t")).limit(n)


def differences(rows: DataFrame) -> DataFrame:
    """t, diff: the step to the next value, of all but the last row. ``rows`` is bounded (``latest``)."""
    step = F.lead("value").over(Window.orderBy("t")) - F.col("value")
    return rows.select("t", step.alias("diff")).where("diff is not null")


def changes(rows: DataFrame) -> DataFrame:
    """t, symbol: 0 for no change, 1 up, 2 down; the first difference is left out."""
    out = differences(rows).withColumn("place", F.row_number().over(Window.orderBy("t")))
    symbol = F.when(F.col("diff") == 0, 0).when(F.col("diff") > 0, 1).otherwise(2)
    return out.where("place > 1").select("t", symbol.alias("symbol"))


def quantised(rows: DataFrame, k: int) -> DataFrame:
    """t, symbol: ``k`` bins of equal width over the differences, closed on the right; the lowest value is in the first."""
    w = Window.partitionBy()
    lo, hi = F.min("diff").over(w), F.max("diff").over(w)
    scaled = F.when(hi > lo, (F.col("diff") - lo) / (hi - lo) * k).otherwise(1)
    return differences(rows).select("t", F.least(F.greatest(F.ceil(scaled) - 1, F.lit(0)), F.lit(k - 1)).cast("int").alias("symbol"))


def compress(symbols: list[int], alphabet: int) -> list[int]:
    """Lempel-Ziv-Welch codes; the table starts with the single symbols."""
    table: dict[tuple[int, int], int] = {}
    size, codes, current = max(256, alphabet), [], None
    for x in symbols:
        if current is None:
            current = x
        elif (current, x) in table:
            current = table[current, x]
        else:
            codes.append(current)
            table[current, x] = size
            size += 1
            current = x
    return codes if current is None else [*codes, current]


def decompress(codes: list[int], alphabet: int) -> list[int]:
    """The symbols of ``compress``'s codes."""
    words = {i: [i] for i in range(max(256, alphabet))}
    out: list[int] = []
    previous: list[int] | None = None
    for code in codes:
        word = words[code] if code in words else [*previous, previous[0]]  # type: ignore[misc]
        if previous is not None:
            words[len(words)] = [*previous, word[0]]
        out += word
        previous = word
    return out


def entropy(p: np.ndarray) -> float:
    p = np.maximum(p, 1e-200)
    return float(-(p * np.log2(p)).sum())


def markov_entropy_rate(transitions: np.ndarray) -> float:
    """Entropy rate of a Markov chain: rows' entropies weighted by the stationary distribution."""
    values, vectors = np.linalg.eig(transitions.T)
    at = np.real(vectors[:, np.argmin(np.abs(values - 1))])
    return float(sum(w * entropy(row) for w, row in zip(at / at.sum(), transitions, strict=True)))


def calibration(spark: SparkSession, alphabet: int, size: int, samples: int, seed: int = SEED) -> DataFrame:
    """slope and intercept of entropy as a line in the compression ratio, over ``samples`` random sources."""

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i in batch["id"]:
                rng = np.random.default_rng([seed, int(i)])
                p = rng.uniform(size=alphabet)
                p /= p.sum()
                rows.append((entropy(p), len(compress(rng.choice(alphabet, size, p=p).tolist(), alphabet)) / size))
            yield pd.DataFrame(rows, columns=["entropy", "ratio"])

    drawn = spark.range(samples).mapInPandas(sample, "entropy double, ratio double")
    return drawn.agg(F.regr_slope("entropy", "ratio").alias("slope"), F.regr_intercept("entropy", "ratio").alias("intercept"))


def fano_error(h: float, alphabet: int) -> float:
    """The smallest error rate p with entropy(p) + p log2(alphabet - 1) >= h, by bisection."""
    extra = log2(alphabet - 1) if alphabet > 1 else 0.0
    lo, hi = 0.0, (alphabet - 1) / alphabet if alphabet > 1 else 0.0
    value = lambda p: entropy(np.array([p, 1 - p])) + p * extra
    if h >= value(hi):
        return hi
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if value(mid) < h else (lo, mid)
    return (lo + hi) / 2


def lower_bound(df: DataFrame, time: str, value: str, n: int = 1000, samples: int = 100, k: int = 3, method: str = "quantization", seed: int = SEED) -> DataFrame:
    """One row: lower_bound, null if any of the last ``n`` observations is missing."""
    if method not in METHODS:
        raise ValueError(f"the method must be one of {METHODS}")
    rows = latest(df, time, value, n)
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("seen"), F.count_distinct("value").alias("kinds")).first()
    spark = df.sparkSession
    if sizes["n"] < 3 or sizes["seen"] < sizes["n"]:
        return spark.createDataFrame([(None,)], "lower_bound double")
    if method == "None":
        alphabet, size = sizes["kinds"], sizes["n"]
        if alphabet > 0.5 * size:
            raise ValueError("the series has too many different values to be discrete")
        symbols = rows.select("t", (F.dense_rank().over(Window.orderBy("value")) - 1).alias("symbol"))
    elif method == "change":
        alphabet, size, symbols = 3, sizes["n"], changes(rows)
    else:
        alphabet, size, symbols = k, sizes["n"] - 1, quantised(rows, k)

    def ratio(batch: pd.DataFrame) -> pd.DataFrame:
        s = batch.sort_values("t")["symbol"].astype(int).tolist()
        return pd.DataFrame({"ratio": [len(compress(s, alphabet)) / len(s)]})

    # At most n rows.
    own = symbols.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(ratio, "ratio double").first()["ratio"]
    line = calibration(spark, alphabet, size, samples, seed).first()
    return spark.createDataFrame([(fano_error(line["slope"] * own + line["intercept"], alphabet),)], "lower_bound double")
