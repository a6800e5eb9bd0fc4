"""A training-data pipeline: five stages, each one of the operators on all its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet and reads again as the next stage's ``docs``. All but the last
return the columns of ``documents``. The folder is the one that the cluster names
in ``spark.checkpoint.dir``; a stage's rows are removed there once the next one's
are written, the last stage's stay.

Defined results: a null or empty text is kept by the first four stages and packed
as the closing id alone; rows with a null id are kept by the first two, are one
id to the third and are packed each; rows that repeat share their id's fate;
an empty table gives an empty result with the last stage's columns; extra columns
pass through all stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import decontamination, near_duplicates, packing, pii, quality
from tidewright.session import read, shared_folder


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's threshold; trusted text is labelled quality 1."""
    return quality.accept(docs, read(spark, sf_dir, "labels").where("quality = 1"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, Jaccard 0.8)."""
    return near_duplicates.dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (containment 0.8 of its five-word shingles)."""
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal data replaced by its kind; n_chars follows the text."""
    columns = docs.columns
    redacted = pii.redact(docs)
    if "n_chars" in columns:
        redacted = redacted.selectExpr("* except (n_chars)", f"cast(length(text) as {docs.schema['n_chars'].dataType.simpleString()}) as n_chars")
    return redacted.select(*columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 1024 ids, with their ids and places."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("personal data", redact_pii),
    ("best-fit packing", pack_sequences),
]

#: Language models, hashes and tokenisers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            done.getFileSystem(spark._jsc.hadoopConfiguration()).delete(done, True)
    return docs
