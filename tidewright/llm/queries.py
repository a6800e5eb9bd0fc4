"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read
from . import ann, decontamination, licenses, near_duplicates, packing, pii, quality, repeats, sharding, toxicity


def _held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def op1_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    weights = toxicity.train(docs, labels.where(~_held_out()))
    scored = toxicity.score(docs.select("doc_id", "text"), weights)
    return scored.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_suffix_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.remove_repeats(read(spark, sf_dir, "documents")))


def op3_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return quality.classify(docs, labels.where("quality = 1"))


def op4_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(read(spark, sf_dir, "documents"), words=4, percent=80)


def op5_stratified_interleaving(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.interleave(read(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )


def op6_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"), queries_divisor=20, k=20)


def op7_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "license", "template", F.round("dice", 6).alias("dice"))


def op8_containment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shingles", "n_shared")


def op9_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(read(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_toxicity_ftrl, op2_suffix_grouping, op3_kneser_ney_quality, op4_hyperminhash, op5_stratified_interleaving, op6_multi_index_hashing, op7_license_dice, op8_containment_search, op9_best_two_fit, op10_pii)}
#: Word shingles (at most five words) of a table, as strings.
_SHINGLES = """
  SELECT DISTINCT {id}, array_to_string(words[i + 1 : i + width], ' ') AS s
  FROM (SELECT {id}, words, {width} AS width, unnest(range(0, len(words) - {width} + 1)) AS i
        FROM (SELECT {id}, [w for w in string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+') if w <> ''] AS words FROM {table})
        WHERE len(words) >= {least})
"""

ORACLE_SQL: dict[str, str] = {
    "op8_containment_search": f"""
WITH item AS ({_SHINGLES.format(id="item_id", width="least(len(words), 5)", least=1, table="benchmark")}),
sized AS (SELECT item_id, s, count(*) OVER (PARTITION BY item_id) AS n FROM item),
doc AS ({_SHINGLES.format(id="doc_id", width=5, least=5, table="documents")}
        {" ".join("UNION ALL " + _SHINGLES.format(id="doc_id", width=k, least=k, table="documents") for k in range(1, 5))})
SELECT doc_id, item_id, n AS n_shingles, count(*) AS n_shared
FROM doc JOIN sized USING (s) GROUP BY doc_id, item_id, n HAVING count(*) >= ceil(n * 0.8 - 1e-9)
""",
}
