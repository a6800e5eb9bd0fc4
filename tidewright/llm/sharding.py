"""Proportional stratified interleaving: every shard gets the corpus's mixture.

Rows are shuffled by a seeded hash within their source, each gets the fractional
rank (rank - 1/2) / rows of its source, and the corpus sorted by that fraction is
cut into shards of equal row counts (law ``rows``: counts at most one apart).

No source is ranked in one task. Both ranks are found in two levels: rows fall
into buckets that follow the order (leading bits of the hash; slices of the
fraction), bucket counts are summed up over the few buckets, and only the rows
inside one bucket are numbered by a window. The number of buckets follows the
row count, so a bucket holds about ``BUCKET_ROWS`` rows whatever the skew.

Defined results: a null source is a source of its own; a null text has no bytes
(size 1, crc32 0); rows that repeat are each placed (their order among
themselves does not show); an empty table gives an empty result; extra columns
are not carried. Equal texts are not kept together: a text that makes up a third
of the corpus has to be spread over the shards for the mixture to hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 2000
SEED = 20240229


def interleave(docs: DataFrame, n_shards: int = 8, seed: int = SEED, source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, source, size, text_crc32, shard and slot (gapless from 0) of every row."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        "doc_id",
        F.col(source).cast("string").alias("source"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).cast("long").alias("text_crc32"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")).cast("binary")).alias("shuffle"),
    )
    n = docs.count()
    levels = max(1, -(-n // BUCKET_ROWS))
    # The first 7 hex digits are uniform over 2^28, so their slices are even in any large source.
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("shuffle", 1, 7), 16, 10).cast("double") * levels / float(1 << 28)))
    counts = rows.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("here"))
    per = Window.partitionBy("source")
    before = counts.select(
        F.col("source").alias("s"),
        F.col("bucket").alias("b"),
        (F.sum("here").over(per.orderBy("bucket")) - F.col("here")).alias("before"),
        F.sum("here").over(per).alias("total"),
    )
    inner = Window.partitionBy("source", "bucket").orderBy("shuffle", "doc_id", "text_crc32", "size")
    ranked = (
        rows.withColumn("rank", F.row_number().over(inner))
        .join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        .withColumn("fraction", (F.col("before") + F.col("rank") - F.lit(0.5)) / F.col("total"))
        .select("doc_id", "source", "size", "text_crc32", "shuffle", "fraction", F.floor(F.col("fraction") * levels).alias("slice"))
    )
    slices = ranked.groupBy("slice").agg(F.count(F.lit(1)).alias("here"))
    # One row a slice, a few thousand times fewer than rows.
    earlier = slices.select(F.col("slice").alias("c"), (F.sum("here").over(Window.orderBy("slice")) - F.col("here")).alias("before"))
    order = Window.partitionBy("slice").orderBy("fraction", "source", "shuffle", "doc_id", "text_crc32", "size")
    place = F.col("before") + F.row_number().over(order) - 1
    placed = ranked.join(earlier, F.col("slice") == F.col("c")).withColumn("place", place)
    shard = F.expr(f"cast((place * {n_shards}L) div {max(n, 1)}L as int)")
    first = F.expr(f"(shard * {n}L + {n_shards - 1}L) div {n_shards}L")
    return placed.withColumn("shard", shard).select("doc_id", "source", "size", "text_crc32", "shard", (F.col("place") - first).cast("long").alias("slot"))
