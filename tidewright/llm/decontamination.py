"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are short and documents long, so similarity of whole sets says
nothing; what counts is how much of an item a document contains. Items are
partitioned by size, and each keeps a bottom-k MinHash sketch (the k smallest
hashes of its word shingles) whose k follows from its size n: a document that
contains at least t * n of the shingles lacks at most m = n - ceil(t * n), so it
holds at least k - m of the sketch. With k = m + ``SPARE`` every such document
is found, and the others are mostly not. A document's shingles above the largest
sketch hash of their width are dropped at once; the rest meet the sketches.

Candidates are then verified by exact containment: only the candidate documents
are read again, and all their shingles are held against all of the item's.

Everything is built from SQL functions. Words are runs of letters and digits,
lower-cased; shingles take five words, and an item with fewer is one shingle.

Defined results: null, empty or wordless texts and items match nothing; items or
documents that repeat give one row per pair of ids (the union of the shingles of
equal ids counts); null ids are kept as ids of their own; extra columns are
ignored; empty tables give an empty result; long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .names import fresh

WORDS = 5
THRESHOLD = 0.8
SPARE = 4
#: Sketches and candidates of at most this many rows are broadcast (some tens of bytes each); larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _hashes(words: Column, width: int) -> Column:
    """Hashes of the shingles of ``width`` words (repeats included)."""
    starts = F.sequence(F.lit(0), F.size(words) - width)
    hashed = F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(width))))
    return F.when(F.size(words) >= width, hashed).otherwise(F.expr("cast(array() as array<bigint>)"))


def item_shingles(items: DataFrame, text: str = "text") -> DataFrame:
    """item_id, width, h, n (distinct shingles of the item), missing (how many may be absent), rank by hash."""
    rows = items.select("item_id", _words(F.col(text)).alias("words")).where(F.size("words") > 0)
    width = F.least(F.size("words"), F.lit(WORDS))
    hashed = F.lit(None).cast("array<bigint>")
    for k in range(1, WORDS + 1):
        hashed = F.when(width == k, _hashes(F.col("words"), k)).otherwise(hashed)
    flat = rows.select("item_id", width.alias("width"), F.explode(hashed).alias("h")).distinct()
    per = Window.partitionBy("item_id")
    return flat.withColumns({"n": F.count(F.lit(1)).over(per), "rank": F.row_number().over(per.orderBy("h", "width"))})


def _small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it has few enough rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, text: str = "text", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared, containment of all pairs at ``threshold`` or above."""
    # Read four times; the benchmark is small beside the corpus, and each item is independent.
    shingles = cut(item_shingles(items, item_text).withColumn("missing", F.col("n") - F.ceil(F.col("n") * threshold - 1e-9)))
    sketch = shingles.where(F.col("rank") <= F.col("missing") + SPARE)
    limits = {r["width"]: r["top"] for r in sketch.groupBy("width").agg(F.max("h").alias("top")).collect()}  # at most five rows
    if not limits:
        return _pairs(docs.limit(0).select("doc_id", F.lit(0).alias("width"), F.lit(0).cast("long").alias("h")), shingles, threshold)
    sketches = sketch.select("item_id", "width", "h", F.least("n", F.col("missing") + SPARE).alias("k"), "missing")
    low = _document_shingles(docs, limits, text)
    matched = (
        low.join(_small(sketches), ["width", "h"])
        .groupBy("doc_id", "item_id", "k", "missing")
        .agg(F.count_distinct("h").alias("m"))
        .where(F.col("m") >= F.col("k") - F.col("missing"))
    )
    candidates = cut(matched.select("doc_id", "item_id"))
    ids = candidates.select(F.col("doc_id").alias("id")).distinct()
    again = docs.select("doc_id", F.col(text).alias("body")).join(_small(ids), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    full = _document_shingles(again, dict.fromkeys(limits), "body").distinct()
    wanted = candidates.select(F.col("doc_id").alias("c_doc"), F.col("item_id").alias("c_item"))
    shared = full.join(_small(shingles.select("item_id", "width", "h", "n")), ["width", "h"])
    kept = shared.join(wanted, F.col("doc_id").eqNullSafe(F.col("c_doc")) & F.col("item_id").eqNullSafe(F.col("c_item")), "left_semi")
    return _contained(kept, threshold)


def _pairs(rows: DataFrame, shingles: DataFrame, threshold: float) -> DataFrame:
    return _contained(rows.join(shingles.select("item_id", "width", "h", "n"), ["width", "h"]), threshold)


def _contained(shared: DataFrame, threshold: float) -> DataFrame:
    pairs = shared.groupBy("doc_id", "item_id", F.col("n").alias("n_shingles")).agg(F.count(F.lit(1)).alias("n_shared"))
    return pairs.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).where(F.col("n_shared") >= F.ceil(F.col("n_shingles") * threshold - 1e-9))


def _document_shingles(docs: DataFrame, limits: dict[int, int | None], text: str) -> DataFrame:
    """doc_id, width, h of the shingles up to each width's limit, repeats within a row removed."""
    words = docs.select("doc_id", _words(F.col(text)).alias("words"))
    arrays = []
    for width, top in limits.items():
        hashed = _hashes(F.col("words"), width)
        kept = hashed if top is None else F.filter(hashed, lambda h: h <= top)  # noqa: B023
        arrays.append(F.transform(F.array_distinct(kept), lambda h: F.struct(F.lit(width).alias("width"), h.alias("h"))))  # noqa: B023
    return words.select("doc_id", F.inline(F.concat(*arrays)))


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that contain no item, with their columns."""
    name = fresh(docs, "gone")
    found = contaminated(docs, items, threshold).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(_small(cut(found)), F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")
