"""Toxicity by FTRL-proximal logistic regression over hashed word features.

Features of a text are its distinct words, neighbouring pairs and pairs with one
word between (skip-grams), hashed to ``2**BITS`` coordinates. Per-coordinate
learning rates and the L1 term leave a few non-zero weights, which are what the
scoring tasks receive (at most ``2**BITS`` numbers, in practice some hundreds).

The model is fitted in one task on a bounded sample: the ``max_labelled`` rows
with the smallest hash of their id. Scoring reads every whole text once, without
a shuffle.

Defined results: a null or empty text has no features and gets the score of the
bias alone; rows without a label, or with a null one, are not learned from;
repeated labels of a document count as the largest; repeated documents are each
scored; extra columns pass through, ones named like a result are replaced; an
empty table gives an empty result; with no labelled rows every score is 0.5.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 22
MAX_LABELLED = 16384
EPOCHS = 8
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.1
WORD = re.compile(r"\w+")
#: Odd multipliers of the hash: one for words, two for each kind of pair.
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63))


class _WordHash(dict):
    """Hashes of words, kept until there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = zlib.crc32(word.encode("utf-8", "replace"))
        return value


_HASHES = _WordHash()


def features(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, coordinate) of every feature occurrence in ``texts``."""
    words = [WORD.findall(t.lower()) for t in texts]
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    h = np.fromiter((_HASHES[w] for ws in words for w in ws), dtype=np.uint64, count=int(sizes.sum()))
    row = np.repeat(np.arange(len(words)), sizes)
    shift = np.uint64(64 - bits)
    rows, found = [row], [(h * MIX[0]) >> shift]
    for gap, (a, b) in ((1, MIX[1:3]), (2, MIX[3:5])):
        if h.size > gap:
            same = np.flatnonzero(row[gap:] == row[:-gap])
            # The upper bits of a sum of products alone would nearly repeat for equal sums; fold before the last product.
            x = h[same] * a + h[same + gap] * b
            x ^= x >> np.uint64(29)
            found.append((x * MIX[0]) >> shift)
            rows.append(row[same])
    return np.concatenate(rows), np.concatenate(found).astype(np.int64)


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over the examples in order; the non-zero (coordinate, weight); -1 is the bias."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weight(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        w = -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        w[np.abs(zs) <= L1] = 0.0
        return w

    for _ in range(epochs):
        for at, y in zip(rows, labels, strict=True):
            at = np.append(at, 1 << bits)
            w = weight(at)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            root = np.sqrt(n[at])
            sigma = (np.sqrt(n[at] + g * g) - root) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    at = np.flatnonzero(np.abs(z) > L1)
    w = weight(at)
    return np.where(at == 1 << bits, -1, at), w


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, bits: int = BITS, text: str = "text") -> dict[int, float]:
    """Weights from ``labels`` (doc_id, toxic) joined to ``docs``; a bounded sample in hash order."""
    known = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
        .select(F.col("doc_id").alias("id"), "y", F.xxhash64("doc_id").alias("order"))
    )
    # At most max_labelled ids are broadcast.
    bodies = docs.select("doc_id", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))
    chosen = bodies.join(F.broadcast(known), F.col("doc_id") == F.col("id")).select("id", "order", F.col("y").cast("int").alias("y"), "body")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            row, at = features(batch["body"].tolist(), bits)
            pairs = np.unique(row << bits | at)
            ends = np.searchsorted(pairs >> bits, np.arange(len(batch) + 1))
            own = (pairs & ((1 << bits) - 1)).astype(np.int32)
            yield batch.drop(columns="body").assign(at=[own[a:b] for a, b in zip(ends, ends[1:], strict=False)])

    def learn(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.drop_duplicates("id").sort_values(["order", "id"])
        at, w = fit(list(batch["at"]), batch["y"].to_numpy(), bits)
        return pd.DataFrame({"at": at, "w": w})

    id_type = labels.schema["doc_id"].dataType.simpleString()
    extracted = chosen.mapInPandas(extract, f"id {id_type}, order long, y int, at array<int>")
    # One group, of at most max_labelled documents.
    learned = extracted.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(learn, "at long, w double")
    return {r["at"]: r["w"] for r in learned.collect()}


def score(docs: DataFrame, weights: dict[int, float], bits: int = BITS, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability of label 1."""
    coordinates = np.array([k for k in weights if k >= 0], dtype=np.int64)
    values = np.array([weights[k] for k in weights if k >= 0], dtype=np.float64)
    bias = weights.get(-1, 0.0)
    kept: list[np.ndarray] = []

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if not kept:
            dense = np.zeros(1 << bits, dtype=np.float32)
            dense[coordinates] = values
            kept.append(dense)
        for texts in batches:
            total = np.full(len(texts), bias)
            for k in range(0, len(texts), 256):
                row, at = features(texts.iloc[k : k + 256].tolist(), bits)
                hit = np.flatnonzero(kept[0][at])
                pairs = np.unique(row[hit] << bits | at[hit])
                total[k : k + 256] += np.bincount(pairs >> bits, kept[0][pairs & ((1 << bits) - 1)], minlength=min(256, len(texts) - k))
            yield pd.Series(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))))

    return docs.withColumn("score", probability(F.coalesce(F.col(text).cast("string"), F.lit(""))))
