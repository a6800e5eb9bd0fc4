"""Quality by an interpolated modified Kneser-Ney model of trusted text.

Tokens are UTF-16 code units, so an n-gram of ``ORDER`` (four) is one 64-bit
number, shorter ones are parts of it, and the tables of a corpus stay far smaller
than those of words. Counts, continuation counts and context sums are Spark
tables sharded by n-gram; the probability of every n-gram that occurs in the
corpus is found by joining them.

A document is not split into its n-grams to be scored. Documents are packed into
blocks of some MB, which are written once, bucketed by block; a block lists its distinct
n-grams once, the joins give these their probabilities, and these tables are dealt
out to the buckets of packed texts. No text is shuffled, and what moves grows with
the corpus, but far less than its n-grams.

The model learns from all trusted documents. These themselves fall into ``FOLDS``
folds by their id and are scored by a model of the other folds; the threshold of a
language is a quantile of the perplexities that its trusted documents get so. The
models of all folds are one set of tables, with the fold that is left out as a
part of every key.

Defined results: a null or empty text has no tokens, no perplexity, and is kept
(there is nothing to reject); a language without trusted documents, null
included, takes the quantile over all languages; with no trusted documents, or
with all of them in one fold (as one alone is), there is no threshold and
everything is kept; ids that repeat are scored row by row, but ``accept`` drops all
rows of an id of which one is rejected, and keeps rows with a null id; extra columns pass
through ``accept`` and are ignored elsewhere; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bucketed, cut, free_memory, released, text_batches
from .names import fresh

ORDER = 4
QUANTILE = 0.99
FOLDS = 5
#: In place of a fold: the model that leaves none out.
WHOLE = FOLDS
#: Characters of text in a block, more or less: a block holds at least one document.
BLOCK_CHARS = 8_000_000
#: Characters whose n-grams are in memory at a time (a longer text is one step).
STEP_CHARS = 500_000
#: Scored n-grams that go into one row for each of their blocks.
GATHERED = 100_000
#: Count tables of at most this many rows (some tens of bytes each) are broadcast.
BROADCAST_GRAMS = 200_000
#: Thresholds of at most this many languages are broadcast, as one language may hold most rows.
BROADCAST_LANGS = 10_000
#: Ids of at most this many trusted documents are broadcast (9 bytes each).
BROADCAST_ROWS = 1_000_000
PAD = b"\0" * (2 * (ORDER - 1))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that end in each code unit of ``texts``, in order, and the number of units of each text."""
    parts = [t.replace("\0", "\1").encode("utf-16-le", "surrogatepass") for t in texts]
    sizes = np.array([len(p) // 2 for p in parts], dtype=np.int64)
    units = np.frombuffer(PAD + PAD.join(parts), dtype="<u2").astype(np.uint64)
    found = np.zeros(max(0, len(units) - ORDER + 1), dtype=np.uint64)
    for k in range(ORDER):
        found |= units[k : k + len(found)] << np.uint64(16 * (ORDER - 1 - k))
    return found[units[ORDER - 1 :] != 0], sizes


def distinct(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of ``texts``, sorted, and how often they occur; built up from ``STEP_CHARS`` at a time."""
    keys, times, part, size = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), [], 0
    for k, t in enumerate(texts):
        part.append(t)
        size += len(t)
        if size >= STEP_CHARS or k + 1 == len(texts):
            new, n = np.unique(grams(part)[0], return_counts=True)
            both, at = np.unique(np.r_[keys, new], return_inverse=True)
            times = np.bincount(at, np.r_[times, n], minlength=len(both)).astype(np.int64)
            keys, part, size = both, [], 0
    return keys, times


def _blocks(texts: list[str], first: int = 0) -> Iterator[tuple[int, int]]:
    """Ranges of rows that make up a block; the first range has ``first`` characters (0: as many as the others)."""
    start, size, room = 0, 0, first or BLOCK_CHARS
    for k, t in enumerate(texts):
        size += len(t)
        if size >= room:
            yield start, k + 1
            start, size, room = k + 1, 0, BLOCK_CHARS
    if start < len(texts):
        yield start, len(texts)


def _by_fold(folds: list[int], texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """The texts of each fold that occurs."""
    for f in sorted(set(folds)):
        yield f, [t for t, g in zip(texts, folds, strict=True) if g == f]


def counted(docs: DataFrame, fold: Column | None = None) -> DataFrame:
    """fold, gram, n: the n-grams of column ``body`` and how often they occur; with ``fold`` also without the rows of each fold."""

    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds, texts = batch["fold"].to_pylist(), batch["body"].to_pylist()
            for a, b in _blocks(texts):
                for f, part in _by_fold(folds[a:b], texts[a:b]):
                    gram, n = distinct(part)
                    yield pa.RecordBatch.from_arrays([pa.array([f] * len(gram), pa.int32()), pa.array(gram.view(np.int64)), pa.array(n)], names=["fold", "gram", "n"])

    rows = docs.select("body", (F.lit(WHOLE) if fold is None else fold).cast("int").alias("fold")).mapInArrow(count, "fold int, gram long, n long")
    if fold is None:
        return rows.groupBy("fold", "gram").agg(F.sum("n").alias("n"))
    # One row for each n-gram is dealt out; the models' counts are made from it afterwards.
    own = [F.sum(F.when(F.col("fold") == f, F.col("n")).otherwise(0)) for f in range(FOLDS)]
    wide = rows.groupBy("gram").agg(F.array(*own).alias("own"), F.sum("n").alias("all"))
    left = F.concat(F.transform("own", lambda x: F.col("all") - x), F.array("all"))
    return wide.select("gram", F.posexplode(left).alias("fold", "n")).where("n > 0").select("fold", "gram", "n")


def _part(gram: Column, skip: int, length: int) -> Column:
    """``length`` units of an n-gram that end ``skip`` units before its last; the n-gram itself if these are all."""
    return gram if length == ORDER else F.shiftrightunsigned(gram, 16 * skip).bitwiseAND(F.lit((1 << (16 * length)) - 1))


def _of_fold(values: dict[int, float]) -> Column:
    """The value of a row's fold."""
    return F.element_at(F.create_map(*(F.lit(x) for f, v in values.items() for x in (f, float(v)))), F.col("fold")) if values else F.lit(0.0)


class Model:
    """Count tables of every order and fold: for k < ORDER, the number of distinct units before a k-gram takes the place of its count."""

    def __init__(self, counts: DataFrame) -> None:
        self.counts, self.contexts, self.discounts, rows = {}, {}, {}, {}
        table = cut(counts)
        for k in range(ORDER, 0, -1):
            if k < ORDER:
                table = cut(table.groupBy("fold", _part(F.col("gram"), 0, k).alias("gram")).agg(F.count(F.lit(1)).alias("n")))
            self.counts[k] = table
            # Six numbers a level and fold reach the driver.
            found = table.groupBy("fold").agg(*(F.count_if(F.col("n") == i).alias(f"n{i}") for i in range(1, 5)), F.count(F.lit(1)).alias("all"), F.sum("n").alias("sum")).collect()
            self.discounts[k], rows[k] = {}, sum(n["all"] for n in found)
            for n in found:
                n1, n2, n3, n4 = (float(n[f"n{i}"]) for i in range(1, 5))
                y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
                raw = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
                self.discounts[k][n["fold"]] = tuple(min(max(d, 0.05), i - 0.05) for i, d in enumerate(raw, 1))
            if k > 1:
                self.contexts[k] = table.groupBy("fold", _part(F.col("gram"), 1, k - 1).alias("context")).agg(
                    F.sum("n").alias("total"), *(F.count_if(F.col("n") == i).alias(f"c{i}") for i in (1, 2)), F.count_if(F.col("n") > 2).alias("c3")
                )
            else:
                self.unigrams = {n["fold"]: (n["all"], n["sum"]) for n in found}
        # A context is a shorter n-gram or nothing but padding. Short ones are few and hot (a blank), so they are sent to the others.
        for k in range(1, ORDER + 1):
            if rows[k] <= BROADCAST_GRAMS:
                self.counts[k] = F.broadcast(self.counts[k])
            if k > 1 and rows[k - 1] + FOLDS + 1 <= BROADCAST_GRAMS:
                self.contexts[k] = F.broadcast(self.contexts[k])

    def log_probability(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` (fold, gram, distinct) with ``logp``, by joins with the tables of each order."""
        out = wanted
        # The longest first: its join needs no other partitioning than that of the distinct n-grams, and rows are narrow when they are dealt again.
        for k in range(ORDER, 0, -1):
            table = self.counts[k].select(F.col("fold").alias(f"f{k}"), F.col("gram").alias(f"g{k}"), F.col("n").alias(f"n{k}"))
            out = out.join(table, (_part(F.col("gram"), 0, k) == F.col(f"g{k}")) & (F.col("fold") == F.col(f"f{k}")), "left")
            if k > 1:
                names = ("total", "c1", "c2", "c3")
                context = self.contexts[k].select(F.col("fold").alias(f"e{k}"), F.col("context").alias(f"h{k}"), *(F.col(c).alias(f"{c}_{k}") for c in names))
                out = out.join(context, (_part(F.col("gram"), 1, k - 1) == F.col(f"h{k}")) & (F.col("fold") == F.col(f"e{k}")), "left")
        types, total = (_of_fold({f: n[i] for f, n in self.unigrams.items()}) for i in (0, 1))
        # One more type stands for all unseen units; each seen one gives it a part of its count.
        d = _of_fold({f: min(x[2], 1.0) for f, x in self.discounts[1].items()})
        p = (F.greatest(F.coalesce("n1", F.lit(0)) - d, F.lit(0.0)) + d * types / (types + 1)) / F.greatest(total, F.lit(1.0))
        for k in range(2, ORDER + 1):
            d1, d2, d3 = (_of_fold({f: x[i] for f, x in self.discounts[k].items()}) for i in range(3))
            n = F.coalesce(f"n{k}", F.lit(0))
            discount = F.when(n == 0, 0.0).when(n == 1, d1).when(n == 2, d2).otherwise(d3)
            left = (d1 * F.col(f"c1_{k}") + d2 * F.col(f"c2_{k}") + d3 * F.col(f"c3_{k}")) / F.col(f"total_{k}")
            p = F.when(F.col(f"total_{k}").isNull(), p).otherwise((n - discount) / F.col(f"total_{k}") + left * p)
        return out.select("fold", "gram", F.log(F.greatest(p, F.lit(1e-30))).cast("float").alias("logp"))


def _packed(docs: DataFrame) -> DataFrame:
    """block, fold, data: blocks of rows of one fold, compressed.

    The number of a block is that of its task and its place there, so it is fixed
    once these rows are written, and only then.
    """

    @released
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, number = zstandard.ZstdCompressor(level=9), TaskContext.get().partitionId() << 32
        held: dict[int, list[pa.RecordBatch]] = {}
        sizes: dict[int, int] = {}

        def emit(f: int) -> pa.RecordBatch:
            nonlocal number
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[f][0].schema) as writer:
                for part in held.pop(f):
                    writer.write_batch(part)
            sizes.pop(f)
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([f], pa.int32()), pa.array([press.compress(sink.getvalue())], pa.binary())], names=["block", "fold", "data"])

        for batch in batches:
            for f in batch["fold"].unique().to_pylist():
                part = batch.filter(pc.equal(batch["fold"], f)).select(["doc_id", "lang", "body"])
                for a, b in _blocks(part["body"].to_pylist(), BLOCK_CHARS - sizes.get(f, 0)):
                    some = part.slice(a, b - a)
                    held.setdefault(f, []).append(some)
                    sizes[f] = sizes.get(f, 0) + pc.sum(pc.utf8_length(some["body"])).as_py()
                    if sizes[f] >= BLOCK_CHARS:
                        yield emit(f)
        for f in list(held):
            yield emit(f)

    return docs.mapInArrow(pack, "block long, fold int, data binary")


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.decompress(data)).read_all()


def _listed(packs: DataFrame) -> DataFrame:
    """block, fold, gram: the distinct n-grams of every block."""

    @released
    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, f, data in zip(batch["block"].to_pylist(), batch["fold"].to_pylist(), batch["data"], strict=True):
                gram = distinct(_unpacked(data.as_py())["body"].to_pylist())[0].view(np.int64)
                block, fold = np.full(len(gram), name, dtype=np.int64), np.full(len(gram), f, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(fold), pa.array(gram)], names=["block", "fold", "gram"])

    return packs.mapInArrow(listing, "block long, fold int, gram long")


def _tables(scored: DataFrame) -> DataFrame:
    """block, gram and logp (as bytes): each task's share of a block's table in one row."""

    @released
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, held, size = zstandard.ZstdCompressor(level=1), [], 0

        def emit() -> pa.RecordBatch:
            block, gram, logp = (np.concatenate([b[c].to_numpy(zero_copy_only=False) for b in held]) for c in ("block", "gram", "logp"))
            order = np.lexsort((gram, block))
            block, gram, logp = block[order], gram[order], logp[order]
            first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            ends = np.r_[first[1:], len(block)]
            steps = [press.compress(np.diff(gram[a:b], prepend=0).astype("<i8").tobytes()) for a, b in zip(first, ends, strict=True)]
            values = [logp[a:b].astype("<f4").tobytes() for a, b in zip(first, ends, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(block[first]), pa.array(steps, pa.binary()), pa.array(values, pa.binary())], names=["block", "gram", "logp"])

        for batch in batches:
            if len(batch):
                held.append(batch)
                size += len(batch)
            if size >= GATHERED:
                yield emit()
                held, size = [], 0
        if held:
            yield emit()

    return scored.mapInArrow(gather, "block long, gram binary, logp binary")


def _look_up(gram: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of each n-gram: a table by hash first, a search among the sorted keys for those that lost their slot."""
    bits = max(4, int(len(keys)).bit_length() + 2)
    hashed = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
    slot = np.zeros(1 << bits, dtype=np.int32)
    slot[hashed(keys)] = np.arange(len(keys), dtype=np.int32)
    at = slot[hashed(gram)]
    lost = np.flatnonzero(keys[at] != gram)
    found = np.minimum(np.searchsorted(keys, gram[lost]), len(keys) - 1)
    if np.any(keys[found] != gram[lost]):
        raise ValueError("an n-gram of the block is not in its table")
    at[lost] = found
    return values[at]


def perplexity(docs: DataFrame, model: Model, text: str = "text", fold: Column | None = None) -> DataFrame:
    """doc_id, lang, n_tokens and perplexity of every row of ``docs`` (written), by the model without its ``fold``."""
    own = (F.lit(WHOLE) if fold is None else fold).cast("int").alias("fold")
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"), own)
    schema = "doc_id {}, lang string, n_tokens long, perplexity double".format(docs.schema["doc_id"].dataType.simpleString())

    def scores(packs: pd.DataFrame, shares: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(shares):
            keys = np.concatenate([np.cumsum(np.frombuffer(zstandard.decompress(x), dtype="<i8")) for x in shares["gram"]]).view(np.uint64)
            values = np.concatenate([np.frombuffer(x, dtype="<f4") for x in shares["logp"]])
            keys, first = np.unique(keys, return_index=True)
            values = values[first]
        for data in packs["data"]:
            table = _unpacked(data)
            texts = table["body"].to_pylist()
            total, n = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
            for a in range(0, len(texts), 128):
                gram, n[a : a + 128] = grams(texts[a : a + 128])
                if len(gram):
                    logp = np.r_[0.0, np.cumsum(_look_up(gram, keys, values), dtype=np.float64)]
                    ends = np.cumsum(n[a : a + 128])
                    total[a : a + 128] = logp[ends] - logp[ends - n[a : a + 128]]
            mean = -total / np.maximum(n, 1)
            out.append(pd.DataFrame({"doc_id": table["doc_id"].to_pandas(), "lang": table["lang"].to_pandas(), "n_tokens": n, "perplexity": np.where(n > 0, np.exp(mean), np.nan)}))
        return pd.concat(out) if out else pd.DataFrame({"doc_id": [], "lang": [], "n_tokens": [], "perplexity": []})

    def score(packs: pd.DataFrame, shares: pd.DataFrame) -> pd.DataFrame:
        made = scores(packs, shares)
        free_memory()
        return made

    with bucketed(_packed(rows), "block") as packs:
        listed = _listed(packs)
        known = cut(model.log_probability(listed.select("fold", "gram").distinct()))
        tables = _tables(listed.join(known, ["fold", "gram"]).select("block", "gram", "logp"))
        scored = packs.select("block", "data").groupBy("block").cogroup(tables.groupBy("block")).applyInPandas(score, schema)
        return cut(scored.withColumn("perplexity", F.nanvl("perplexity", F.lit(None))))


def _fold(column: str) -> Column:
    return (F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS).cast("int")


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, text: str = "text") -> DataFrame:
    """doc_id, lang, n_tokens, perplexity, threshold, accepted of every row; ``trusted`` has the ids of trusted documents."""
    text_batches(docs)
    ids = trusted.where("doc_id is not null").select(F.col("doc_id").alias("id")).distinct()
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = docs.select("doc_id", "lang", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))
    rows = rows.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("id"), "left")
    model = Model(counted(rows.where("id is not null"), _fold("id")))
    # A fold that holds all trusted documents leaves nothing to learn from.
    crossed = _fold("id").isin([f for f in model.unigrams if f != WHOLE])
    scored = perplexity(rows, model, "body", F.when(crossed, _fold("id")).otherwise(WHOLE))
    held = scored.join(ids.where(crossed), F.col("doc_id") == F.col("id"), "left_semi").where("perplexity is not null")
    at = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10000))
    # A row for each language that has trusted documents.
    limits = cut(held.groupBy(F.col("lang").alias("l")).agg(at.alias("limit")))
    if limits.limit(BROADCAST_LANGS + 1).count() <= BROADCAST_LANGS:
        limits = F.broadcast(limits)
    everywhere = held.agg(at.alias("limit")).first()["limit"]
    threshold = F.coalesce(F.col("limit"), F.lit(everywhere).cast("double"))
    out = scored.join(limits, F.col("lang") == F.col("l"), "left").withColumn("threshold", threshold)
    accepted = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return out.select("doc_id", "lang", "n_tokens", "perplexity", "threshold", accepted.alias("accepted"))


def accept(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """The documents that the model accepts, with their columns."""
    name = fresh(docs, "gone")
    gone = cut(classify(docs, trusted, quantile).where("not accepted and doc_id is not null").select(F.col("doc_id").alias(name)).distinct())
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, F.col("doc_id") == F.col(name), "left_anti")
