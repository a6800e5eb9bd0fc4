"""Results that a cut form of an operator would not give."""

import random
import zlib

import pytest
from test_operators import kneser_ney, prose, table

from pyspark.sql import functions as F

from tidewright.llm import quality


def test_thresholds_of_all_trusted_documents(spark):
    """Every trusted document counts, by a model of the other folds, and the threshold is the quantile itself."""
    rng = random.Random(5)
    every = [prose(rng, 30) for _ in range(40)]
    trusted = list(range(30))
    fold = lambda i: zlib.crc32(str(i).encode()) % quality.FOLDS
    want = {i: kneser_ney([every[j] for j in trusted if i >= 30 or fold(j) != fold(i)], [every[i]])[0] for i in range(40)}
    got = quality.classify(table(spark, every), spark.createDataFrame([(i,) for i in trusted], "doc_id long")).collect()
    assert {r["doc_id"]: r["perplexity"] for r in got} == pytest.approx(want, rel=1e-4)
    limits = {"en": max(want[i] for i in trusted if i % 3), None: max(want[i] for i in trusted)}
    assert all(r["threshold"] == pytest.approx(limits[r["lang"]], rel=1e-4) and r["accepted"] == (r["perplexity"] <= r["threshold"]) for r in got)


def test_no_threshold_from_one_fold(spark):
    """A trusted document alone is in no other fold's model."""
    docs = table(spark, ["some plain words", "#%&*"])
    got = quality.classify(docs, spark.createDataFrame([(0,)], "doc_id long")).collect()
    assert all(r["threshold"] is None and r["accepted"] for r in got)


def test_rows_in_any_order(spark, monkeypatch):
    """Rows out of a shuffle, in batches of any size, get the scores of rows from a scan."""
    rng = random.Random(6)
    docs = table(spark, [prose(rng, rng.randrange(5, 60)) for _ in range(600)] + ["", None] * 3)
    trusted = spark.createDataFrame([(i,) for i in range(0, 600, 3)], "doc_id long")

    def score(d):
        rows = quality.classify(d, trusted).collect()
        return {(r["doc_id"], c): r[c] for r in rows for c in ("perplexity", "threshold")}

    want = score(docs)
    assert score(docs.repartition(6).orderBy(F.rand())) == pytest.approx(want)
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(quality, "BROADCAST_GRAMS", 0)
    monkeypatch.setattr(quality, "BLOCK_CHARS", 5000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert score(docs.join(docs.select(F.col("doc_id").alias("other")), F.col("doc_id") == F.col("other"))) == pytest.approx(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
