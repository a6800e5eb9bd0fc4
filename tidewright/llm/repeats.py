"""Exact repeated substrings, removed with suffix arrays over anchored segments.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts somewhere
else in the corpus. All windows of that length are judged, in four steps:

1. Anchors. Of the ``GRAM``-byte strings in a window the one with the smallest
   hash is its anchor, so equal windows have equal anchors at equal places. A run
   is the stretch of neighbouring windows with one anchor; there are some fifty
   bytes to a run. Runs whose anchor occurs once in the corpus are done.
2. Whole copies. Runs that are equal throughout (as in copied documents and
   passages) repeat in every window; counting their hashes settles them.
3. Suffix arrays. Different runs of one anchor may share some windows. Their
   segments, cut down to what another one of the group can share, are set side by
   side with the anchor as a single symbol, and the suffix array of such a block
   (built by linear grouping, see ``suffix_array``) has equal windows next to
   each other, where they are compared in full.
4. Crowded anchors. An anchor with more than ``GROUP`` different runs isn't put
   into one task: its windows are counted by hash, spread over all tasks.

No step gathers the occurrences of a string in one place: counts are aggregated
before they are shuffled, and joined back.

Defined results: a null text is empty; rows that repeat are occurrences of their
own (each is removed by the other); null ids are kept; extra columns are ignored;
an empty table gives an empty result; texts of any length are read whole, and
nothing matches across documents. A 64-bit hash of a window stands for it, given
that a 64-bit hash of its anchor agrees too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, text_batches
from .shingles import mixed
from .suffix_array import suffix_array

LENGTH, GRAM = 200, 100
GROUP = 4096
#: Symbols in a suffix array, more or less: groups of one anchor are never parted.
BLOCK = 20_000
#: Tables of at most this many rows (some tens of bytes each) are broadcast.
BROADCAST_ROWS = 500_000
#: Texts worked on at a time, in bytes.
BATCH = 250_000
POS = np.uint64(28)

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: A random odd number for each byte.
BYTE = mixed(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


_KEPT: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers, kept for the next call unless there are very many."""
    if n > len(_KEPT.get(base, ())):
        out = np.full(max(n, 2 * BATCH), base, dtype=np.uint64)
        out[0] = 1
        out = np.multiply.accumulate(out)
        if n > 8 * BATCH:
            return out[:n]
        _KEPT[base] = out
    return _KEPT[base][:n]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of ``width`` items: a block's end and the next one's start."""
    if len(x) < width:
        return x[:0]
    y = np.full(-(-len(x) // width) * width, np.uint64(2**64 - 1))
    y[: len(x)] = x
    y = y.reshape(-1, width)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    behind = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: len(x) - width + 1], ahead[width - 1 : len(x)])


class Runs:
    """The runs of some texts: row, lo (first window), width (windows - 1), at (anchor - lo), key and run hashes."""

    def __init__(self, texts: list[bytes]) -> None:
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        n = len(data)
        self.row = self.lo = self.width = self.at = np.zeros(0, dtype=np.int64)
        self.key = self.run = np.zeros(0, dtype=np.uint64)
        if n < LENGTH:
            return
        self.inverse = _powers(INVERSE, n + 1)
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(BYTE[data] * _powers(BASE, n), out=self.prefix[1:])
        gram = mixed((self.prefix[GRAM:] - self.prefix[:-GRAM]) * self.inverse[: n - GRAM + 1])
        least = _sliding_min((gram >> POS << POS) | np.arange(len(gram), dtype=np.uint64), LENGTH - GRAM + 1)
        anchor = (least & np.uint64((1 << int(POS)) - 1)).astype(np.int64)
        ends = np.cumsum(sizes)
        doc = np.repeat(np.arange(len(texts)), sizes)[: len(anchor)]
        window = np.flatnonzero(np.arange(len(anchor)) + LENGTH <= ends[doc])
        if not len(window):
            return
        a = anchor[window]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (window[1:] != window[:-1] + 1)])
        lo, hi, a = window[first], np.r_[window[first[1:] - 1], window[-1]], a[first]
        self.start = (ends - sizes)[doc[lo]]
        self.row, self.at, self.width, self.key = doc[lo], a - lo, hi - lo, gram[a]
        self.lo = lo - self.start
        shape = mixed((self.at * 1000 + self.width).astype(np.uint64))
        self.run = mixed((self.prefix[hi + LENGTH] - self.prefix[lo]) * self.inverse[lo] + shape)


def windows_of(segment: bytes) -> np.ndarray:
    """Hashes of all windows of a segment."""
    data = np.frombuffer(segment, dtype=np.uint8)
    prefix = np.r_[np.uint64(0), np.cumsum(BYTE[data] * _powers(BASE, len(data)), dtype=np.uint64)]
    return mixed((prefix[LENGTH:] - prefix[:-LENGTH]) * _powers(INVERSE, len(data) + 1)[: len(data) - LENGTH + 1])


def uid(doc_id: object, text: bytes) -> int:
    """A number for a row: rows with equal id and text share it and have equal results."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(f"{doc_id} ".encode() + text)).view(np.int64))


def _batched(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts (bytes), up to ``BATCH`` bytes at a time (a longer text by itself)."""
    for batch in batches:
        sizes = np.diff(np.frombuffer(batch["body"].buffers()[1], dtype=np.int32)[batch["body"].offset :][: len(batch) + 1])
        block = np.cumsum(sizes) // BATCH
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(batch) else []
        for a, b in zip(starts, [*starts[1:], len(batch)], strict=True):
            part = batch.slice(a, b - a)
            yield part["doc_id"].to_pylist(), part["body"].to_pylist()


def _uids(batch: pa.RecordBatch) -> pa.Array:
    return pa.array((uid(i.as_py(), t.as_py()) for i, t in zip(batch["doc_id"], batch["body"], strict=True)), pa.int64())


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _keys(docs: DataFrame) -> DataFrame:
    """key, n: anchors and how often they occur, counted within a batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _batched(batches):
            key, n = np.unique(Runs(texts).key, return_counts=True)
            yield pa.RecordBatch.from_arrays([_signed(key), pa.array(n.astype(np.int64))], names=["key", "n"])

    return docs.mapInArrow(count, "key long, n long")


def _runs(docs: DataFrame) -> DataFrame:
    """key, run, uid, place (lo, at and width in one number) of every run."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _batched(batches):
            r = Runs(texts)
            own = np.array([uid(i, t) for i, t in zip(ids, texts, strict=True)], dtype=np.int64)
            place = r.lo << 16 | r.at << 8 | r.width
            yield pa.RecordBatch.from_arrays([_signed(r.key), _signed(r.run), pa.array(own[r.row]), pa.array(place)], names=["key", "run", "uid", "place"])

    return docs.mapInArrow(runs, "key long, run long, uid long, place long")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _segments(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """key, crowded, single, uid, place, segment (bytes) of the runs in ``edges``."""
    by_doc = edges.groupBy("uid").agg(F.collect_list(F.struct("key", "crowded", "single", "place")).alias("edges"))
    by_doc = cut(by_doc)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([_uids(batch), batch["body"]], names=["uid", "body"])

    # Rows that share a uid are equal, and one is enough; the rest only repeat its windows.
    named = docs.mapInArrow(name, "uid long, body binary").join(_small(by_doc), "uid")
    flat = named.select("uid", "body", F.inline("edges"))
    lo, size = F.shiftright("place", 16), F.col("place").bitwiseAND(F.lit(255)) + LENGTH
    return flat.select("key", "crowded", "single", "uid", "place", F.substring("body", (lo + 1).cast("int"), size.cast("int")).alias("segment")).dropDuplicates(["key", "uid", "place"])


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def _reach(parts: list[bytes]) -> list[int]:
    """For each string, the longest prefix it shares with another one."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    out = [0] * len(parts)
    for i, j in zip(order, order[1:], strict=False):
        n = _common(parts[i], parts[j])
        out[i], out[j] = max(out[i], n), max(out[j], n)
    return out


def shared_windows(groups: list[list[tuple[bytes, int]]]) -> list[list[tuple[int, int]]]:
    """For every (segment, place of the anchor) of every group, the ranges of windows that another member has too.

    A range is (first, last) window of the segment. One suffix array is built for all groups.
    """
    window = LENGTH - GRAM + 1  # with the anchor as one symbol
    out: list[list[tuple[int, int]]] = []
    symbols: list[int] = []
    spans: list[tuple[int, int, int]] = []  # place in symbols, windows, first window's number in the segment
    for g, group in enumerate(groups):
        left = _reach([segment[:at][::-1] for segment, at in group])
        right = _reach([segment[at + GRAM :] for segment, at in group])
        for (segment, at), a, b in zip(group, left, right, strict=True):
            out.append([])
            spans.append((len(symbols), a + GRAM + b - LENGTH + 1, at - a))
            if a + GRAM + b >= LENGTH:
                symbols += [x + 2 for x in segment[at - a : at]]
                symbols.append(258 + g)
                symbols += [x + 2 for x in segment[at + GRAM : at + GRAM + b]]
                symbols.append(1)
    if not symbols:
        return out
    symbols.append(0)
    text = np.array(symbols, dtype="<u4").tobytes()
    starts = bytearray(len(symbols))
    for place, n, _ in spans:
        if n > 0:
            starts[place : place + n] = b"\1" * n
    repeated = bytearray(len(symbols))
    last, before = -1, b""
    for p in suffix_array(symbols):
        if starts[p]:
            own = text[4 * p : 4 * (p + window)]
            if own == before:
                repeated[p] = repeated[last] = 1
            last, before = p, own
    for ranges, (place, n, first) in zip(out, spans, strict=True):
        marks = repeated[place : place + max(n, 0)]
        k = marks.find(1)
        while k >= 0:
            end = marks.find(0, k)
            end = len(marks) if end < 0 else end
            ranges.append((first + k, first + end - 1))
            k = marks.find(1, end)
    return out


def _shared(segments: DataFrame) -> DataFrame:
    """uid, start, end of the windows that different runs of an anchor share."""
    parts = segments.where("not crowded").select("key", "single", "uid", "place", "segment")
    dealt = parts.repartition("key").sortWithinPartitions("key")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def flush(block: list[tuple]) -> pa.RecordBatch:
            groups: dict[int, list[tuple]] = {}
            for row in block:
                groups.setdefault(row[0], []).append(row)
            # Equal segments (whole copies in rows of their own) are one member that the group need not confirm.
            found = shared_windows([[(r[4], r[3] >> 8 & 255) for r in g] for g in groups.values()])
            spans = [
                (r[2], (r[3] >> 16) + a, (r[3] >> 16) + b + LENGTH)
                for r, ranges in zip((r for g in groups.values() for r in g), found, strict=True)
                if r[1]
                for a, b in ranges
            ]
            cols = list(zip(*spans, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["uid", "start", "end"])

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("key", "single", "uid", "place", "segment")), strict=True):
                if size >= BLOCK and row[0] != rows[-1][0]:
                    yield flush(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4]) - GRAM
        if rows:
            yield flush(rows)

    return dealt.mapInArrow(solve, "uid long, start long, end long")


def _counted(segments: DataFrame) -> DataFrame:
    """uid, start, end of the windows of crowded anchors that occur twice or more."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, own, single, place, segment in zip(*(batch[c].to_pylist() for c in ("key", "uid", "single", "place", "segment")), strict=True):
                h = windows_of(segment)
                n = len(h)
                start = np.arange(n, dtype=np.int64) + (place >> 16)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key)), _signed(h), pa.array(np.full(n, own)), pa.array([single] * n), pa.array(start)], names=["key", "h", "uid", "single", "start"])

    each = segments.where("crowded").select("key", "uid", "single", "place", "segment").mapInArrow(explode, "key long, h long, uid long, single boolean, start long")
    often = each.groupBy("key", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "h")
    hit = each.where("single").join(often, ["key", "h"], "left_semi")
    return hit.select("uid", "start", (F.col("start") + LENGTH).alias("end"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """uid, spans (array of start and end, disjoint, in order) of the texts that lose bytes; ``docs``: doc_id, body (bytes)."""
    twice = _keys(docs).groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")
    met = cut(_runs(docs).join(twice, "key"))
    kinds = met.groupBy("key", "run").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("uid", "place")).alias("one"))
    kinds = cut(kinds)
    whole = met.join(kinds.where("n > 1").select("key", "run"), ["key", "run"], "left_semi")
    place = F.col("place")
    copies = whole.select("uid", F.shiftright(place, 16).alias("start"), (F.shiftright(place, 16) + place.bitwiseAND(F.lit(255)) + LENGTH).alias("end"))
    # Anchors with several kinds of runs; each kind sends one of its runs.
    several = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    edges = kinds.join(several, "key").select("key", (F.col("kinds") > GROUP).alias("crowded"), (F.col("n") == 1).alias("single"), "one.uid", "one.place")
    segments = cut(_segments(docs, edges))
    found = copies.union(_shared(segments)).union(_counted(segments))
    listed = found.groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far = 1 << 34  # beyond any text's end: rows lie one after the other on one line
        for batch in batches:
            lists = batch["spans"]
            sizes = np.diff(lists.offsets.to_numpy())
            if not sizes.sum():
                continue
            parts = lists.flatten()
            row = np.repeat(np.arange(len(lists), dtype=np.int64), sizes)
            start, end = (parts.field(c).to_numpy() + row * far for c in ("start", "end"))
            order = np.argsort(start, kind="stable")
            start, end, row = start[order], np.maximum.accumulate(end[order]), row[order]
            first = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
            last = np.r_[first[1:] - 1, len(start) - 1]
            own = row[first] * far
            pairs = pa.array(np.stack([start[first] - own, end[last] - own], axis=1).ravel())
            pairs = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(first) + 1, 2, dtype=np.int32)), pairs)
            ends = np.searchsorted(row[first], np.arange(len(lists) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["uid"], pa.ListArray.from_arrays(pa.array(ends), pairs)], names=["uid", "spans"])

    return listed.mapInArrow(merge, "uid long, spans array<array<long>>")


def _bodies(docs: DataFrame, text: str) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("body"))


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, body (bytes of the text), spans (removed stretches) of every row."""
    text_batches(docs)
    bodies = _bodies(docs, text)
    spans = cut(repeated_spans(bodies))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([_uids(batch), batch["doc_id"], batch["body"]], names=["uid", "doc_id", "body"])

    named = bodies.mapInArrow(name, f"uid long, doc_id {id_type}, body binary")
    return named.join(_small(spans), "uid", "left").select("doc_id", "body", F.coalesce("spans", F.expr("cast(array() as array<array<bigint>>)")).alias("spans"))


def digest(removed: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of ``remove_repeats``' rows."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body, spans in zip((x.as_py() for x in batch["body"]), batch["spans"].to_pylist(), strict=True):
                h, at = hashlib.sha256(), 0
                for a, b in spans:
                    h.update(body[at:a])
                    at = b
                h.update(body[at:])
                rows.append((len(body), sum(b - a for a, b in spans), len(spans), h.hexdigest()))
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    id_type = removed.schema["doc_id"].dataType.simpleString()
    return removed.mapInArrow(digests, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
