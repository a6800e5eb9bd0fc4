"""Nearest neighbours by multi-index hashing of learned rotated binary codes.

Vectors are centred and rotated, and the signs of the coordinates are a binary
code. The rotation is learned on a bounded sample by iterative quantisation
(alternating sign codes and orthogonal Procrustes), and ``CODES`` such rotations
give a code of several words. Every code is split into substrings of 16 bits and
each substring is indexed. If two codes differ in at most r of the bits of m
substrings, some substring differs in at most r // m bits, so probing every
value within that many bits of each substring of the query's code finds every
code within the radius; candidates within it are reranked on the original vectors.

The radius is learned on the sample too: the ``COVER`` quantile of the distances
at which a sampled query's true neighbours lie. In the whole table neighbours
are nearer than in a sample of it, so the radius holds for it as well. Should
fewer than k codes lie within it, the query scans all rows of its block.

Rows are dealt into blocks of about ``BLOCK`` rows, each with its own index;
queries meet every block, in groups, and a query's k best of each block are
merged by a window over k rows a block.

Defined results: vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part; ids that repeat are rows of
their own but a query skips every row of its own id; a table with fewer rows than
k gives all candidates; ties go to the smaller id; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


SAMPLE = 4096
SAMPLE_QUERIES = 400
CODES = 2
BITS = 16
COVER = 0.95
BLOCK = 65536
QUERY_GROUP = 512


def learn_rotation(x: np.ndarray, seed: int, rounds: int = 30) -> np.ndarray:
    """An orthogonal matrix that brings centred rows near the corners of a cube."""
    r = np.linalg.qr(np.random.default_rng(seed).standard_normal((x.shape[1], x.shape[1])))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(x.T @ np.where(x @ r >= 0, 1.0, -1.0), full_matrices=False)
        r = u @ v
    return r


def encode(x: np.ndarray, mean: np.ndarray, rotations: list[np.ndarray]) -> np.ndarray:
    """Codes as rows of 16-bit substrings."""
    bits = np.concatenate([(x - mean) @ r >= 0 for r in rotations], axis=1)
    spare = -bits.shape[1] % BITS
    bits = np.pad(bits, ((0, 0), (0, spare)))
    return np.packbits(bits, axis=1, bitorder="little").view("<u2")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of code rows."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def fit(sample: np.ndarray, k: int) -> tuple[np.ndarray, list[np.ndarray], int]:
    """Mean, rotations and search radius of a sample."""
    mean = sample.mean(axis=0)
    rotations = [learn_rotation(sample - mean, seed) for seed in range(CODES)]
    codes = encode(sample, mean, rotations)
    seen = []
    for q in range(min(SAMPLE_QUERIES, len(sample))):
        s = sample @ sample[q]
        s[q] = -np.inf
        best = np.argsort(-s, kind="stable")[: min(k, len(sample) - 1)]
        seen.append(distances(codes[best], codes[q]))
    flat = np.concatenate(seen) if seen else np.zeros(1)
    return mean, rotations, int(np.quantile(flat, COVER)) if flat.size else 0


class Index:
    """The substring tables of one block."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.order = [np.argsort(c, kind="stable").astype(np.int32) for c in codes.T]
        self.first = [np.searchsorted(c[o], np.arange((1 << BITS) + 1)) for c, o in zip(codes.T, self.order, strict=True)]
        weight = np.bitwise_count(np.arange(1 << BITS, dtype=np.uint16))
        self.flips = [np.flatnonzero(weight <= r).astype(np.uint16) for r in range(BITS + 1)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code differs in at most ``radius`` bits: pigeonhole probing, then the whole code."""
        flips = self.flips[min(BITS, radius // len(code))]
        hit = np.zeros(len(self.codes), dtype=bool)
        for part, order, first in zip(code, self.order, self.first, strict=True):
            values = part ^ flips
            a, b = first[values], first[values.astype(np.int64) + 1]
            n = b - a
            used = n > 0
            a, n = a[used], n[used]
            ends = np.cumsum(n)
            if ends.size:
                hit[order[np.arange(ends[-1]) + np.repeat(a - ends + n, n)]] = True
        rows = np.flatnonzero(hit)
        return rows[distances(self.codes[rows], code) <= radius]


def search(vectors: DataFrame, queries_divisor: int = 20, k: int = 20, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of every query (ids divisible by ``queries_divisor``)."""
    doubles = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", doubles.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(fine).withColumn("size", F.size("v"))
    usual = rows.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").first()
    if usual is None:
        return vectors.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    rows = rows.where(F.col("size") == usual["size"])
    # A bounded sample: the rows with the smallest hash of their id.
    taken = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()
    mean, rotations, radius = fit(np.array([r["v"] for r in taken]), k)
    n_blocks = max(1, -(-usual["n"] // BLOCK))
    n_groups = max(1, -(-usual["n"] // (queries_divisor * QUERY_GROUP)))
    # Every block meets every group of queries: the larger side is copied the fewer times.
    asked = rows.where(F.col("vec_id") % queries_divisor == 0).withColumn("group", F.pmod(F.xxhash64("vec_id"), F.lit(n_groups)).cast("int"))
    left = rows.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(n_blocks)).cast("int").alias("block"))
    left = left.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))).withColumn("ask", F.lit(False))
    right = asked.select("vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), "group", F.lit(True).alias("ask"))

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        ask = part["ask"].to_numpy()
        x, ids = np.array(part["v"].tolist()), part["vec_id"].to_numpy()
        order = np.argsort(ids[~ask], kind="stable")
        base, base_ids = x[~ask][order], ids[~ask][order]
        out: list[pd.DataFrame] = []
        if len(base):
            index = Index(encode(base, mean, rotations))
            codes = encode(x[ask], mean, rotations) if ask.any() else []
            for q, own, code in zip(x[ask], ids[ask], codes, strict=True):
                near = index.within(code, radius)
                near = near[base_ids[near] != own]
                if len(near) < k:
                    near = np.flatnonzero(base_ids != own)
                s = base[near] @ q
                if len(s) > k:
                    # All rows that tie with the k-th stay until ids decide.
                    keep = s >= np.partition(s, -k)[-k] - 1e-12
                    near, s = near[keep], s[keep]
                # One fixed order of summation, so that equal vectors have equal scores.
                s = np.array([float(np.dot(base[j], q)) for j in near])
                best = np.lexsort((base_ids[near], -s))[:k]
                out.append(pd.DataFrame({"query_id": own, "vec_id": base_ids[near][best], "score": s[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    id_type = vectors.schema["vec_id"].dataType.simpleString()
    found = left.unionByName(right).groupBy("block", "group").applyInPandas(meet, f"query_id {id_type}, vec_id {id_type}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
