"""Best-two-fit packing of token sequences.

Lengths run from 1 to the capacity, so the packing problem is fully described by
a histogram of at most ``capacity`` counts. Spark tokenises, counts the pieces of
each length and ranks them; the packing itself is done on the histogram, which
has the same size for a thousand or a trillion pieces: a bin is filled greedily
with the longest pieces that fit, then its smallest piece is exchanged for two
unpacked ones that fit the widened gap more tightly, and the finished pattern is
used as often as the counts allow. A piece finds its bin from its length and its
rank among the pieces of that length.

Ranks are found in two levels (counts of buckets, then a window inside a
bucket), so a length that a third of all rows share is not ranked in one task.

Defined results: a null text is an empty one, and an empty text is the closing
id alone; repeated rows are packed each; an empty table gives an empty result;
texts of any length are cut into pieces of the capacity, the first one shorter.
Extra columns are not carried.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator, Mapping
from functools import lru_cache
from itertools import pairwise
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..session import cut, free_memory, released, text_batches

CAPACITY = 1024
CLOSING_ID = 2
BUCKET_ROWS = 2000
#: Bytes of text whose ids are in memory at a time (a longer text by itself).
TEXT_BYTES = 2_000_000
#: Words whose ids a worker keeps (as many again from before), some tens of bytes each, and characters of the longest one kept.
KEPT_WORDS, LONG_WORD = 300_000, 64
#: Words that are encoded in one call.
JOINED = 150


def default_vocabulary() -> str:
    """The file of the public byte-level BPE with 50,257 ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _rows(ids: np.ndarray, counts: np.ndarray) -> pa.LargeBinaryArray:
    """Ids that lie one after the other, as rows of ``counts`` ids each."""
    ends = np.append(0, 4 * np.cumsum(counts, dtype=np.int64))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(ids)])


def _values(rows: pa.LargeBinaryArray) -> np.ndarray:
    """The ids of all rows."""
    return np.frombuffer(rows.buffers()[2] or b"", dtype="<u4")


#: A row of no ids.
NOTHING = pa.array([b""], pa.large_binary())


class Kept(Mapping):
    """Words and the bytes of their ids, in a few arrays: a Python object for each takes several times the memory, and leaves gaps where it is freed."""

    def __init__(self) -> None:
        self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.large_binary())

    def __getitem__(self, word: str) -> bytes:
        at = int(self.find(pa.array([word]))[0])
        if at < 0:
            raise KeyError(word)
        return self.ids[at].as_py()

    def __iter__(self) -> Iterator[str]:
        return iter(self.words.to_pylist())

    def __len__(self) -> int:
        return len(self.words)

    def find(self, words: pa.Array) -> np.ndarray:
        """The places of different words; -1 for one that is not kept."""
        # The kept words are looked up among the others, which are fewer: a table of them is made faster.
        at = pc.index_in(self.words, value_set=words).fill_null(-1).to_numpy()
        here = np.flatnonzero(at >= 0)
        found = np.full(len(words), -1, dtype=np.int64)
        found[at[here]] = here
        return found

    def add(self, words: pa.Array, ids: pa.LargeBinaryArray) -> None:
        """Keep words that are not kept so far."""
        self.words, self.ids = pa.concat_arrays([self.words, words]), pa.concat_arrays([self.ids, ids])


class Encoder:
    """Token ids by ``tokenizers``, with the ids of words kept.

    The byte-level tokeniser always parts a text before a blank between two other
    characters, so what lies between such places has the same ids wherever it
    stands; it also parts a letter from punctuation after it, so a word is kept once,
    whatever follows it. A batch is coded by its different words; those not met before
    are encoded in one call, set one after the other with their blanks (the tokens
    that begin with a blank tell where each starts), and the ids of the texts are
    gathered from theirs.
    """

    PLACE = re.compile(r"(?<=\S)(?=\x20\S)")
    #: ASCII punctuation but the apostrophe, which may begin a token with letters.
    MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
    #: Letters beyond these may not be letters to the tokeniser's tables.
    LETTERS = pa.array([c for c in map(chr, range(0x250)) if c.isalpha()])

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.blank = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        # \u0120 is how the vocabulary writes a blank.
        self.blank[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known, self.older = Kept(), Kept()
        self.marks: dict[str, bytes] = {}

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """The ids of every text."""
        if not len(texts):
            return []
        lists = pc.split_pattern(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, " ")
        sizes = pc.list_value_length(lists).to_numpy()
        first = np.cumsum(sizes) - sizes
        coded = lists.flatten().dictionary_encode()
        del lists
        words, code = coded.dictionary.cast(pa.string()), coded.indices.to_numpy()
        later = np.ones(len(code), dtype=bool)
        later[first] = False
        used = np.flatnonzero(np.bincount(code[later], minlength=len(words)))
        made, odd = self._words(words.take(pa.array(used)))
        # A blank beside other white space is no place to part a text: such a text is encoded by itself.
        heads = words.take(pa.array(code[first])).to_pylist()
        whole = np.array([not p or p[-1].isspace() for p in heads])
        place = np.zeros(len(words), dtype=np.int32)
        if odd.any():
            place[used[odd]] = 1
            whole |= np.logical_or.reduceat((place[code] > 0) & later, first)
        place[used] = np.arange(len(used))
        code = place[code]
        code[first] = len(used) + np.arange(len(first))
        parts = [made, self._ids(heads)]
        if whole.any():
            alone = np.flatnonzero(whole)
            for k in alone.tolist():
                text = texts[k] if isinstance(texts, list) else texts[k].as_py()
                ids = _values(self._ids(self.PLACE.split(text)))
                parts.append(_rows(ids, np.array([len(ids)])))
            code[first[alone]] = len(used) + len(first) + np.arange(len(alone))
            # Nothing is left for the other words of such a text.
            code[later & np.repeat(whole, sizes)] = len(used) + len(first) + len(alone)
        rows = pa.concat_arrays([*parts, NOTHING]).take(pa.array(code))
        ends = np.frombuffer(rows.buffers()[1], dtype=np.int64, count=len(rows) + 1) // 4
        return np.split(_values(rows), ends[first[1:]])

    def _words(self, words: pa.Array) -> tuple[pa.LargeBinaryArray, np.ndarray]:
        """The ids of different words after a blank; and which are empty or have other white space at an end, so that there is no place before or after them."""
        sizes = pc.binary_length(words).to_numpy()
        odd = (sizes == 0) | (pc.binary_length(pc.utf8_trim_whitespace(words)).to_numpy() < sizes)
        cores = pc.ascii_rtrim(words, characters=self.MARKS)
        parted = ~odd & (pc.binary_length(cores).to_numpy() < sizes)
        parted &= pc.is_in(pc.utf8_slice_codeunits(cores, -1), value_set=self.LETTERS).to_numpy(zero_copy_only=False)
        for token in self.added:
            parted &= ~pc.match_substring(words, token).to_numpy(zero_copy_only=False)
        cores = pc.if_else(pa.array(parted), cores, pc.if_else(pa.array(odd), "", words))
        coded = cores.dictionary_encode()
        made = self._cores(coded.dictionary).take(coded.indices)
        at = pa.array(np.flatnonzero(parted))
        marks = [w[k:] for w, k in zip(words.take(at).to_pylist(), pc.utf8_length(cores.take(at)).to_pylist(), strict=True)]
        coded = pa.array(marks, pa.string()).dictionary_encode()
        place = np.zeros(len(words), dtype=np.int32)
        place[parted] = 1 + coded.indices.to_numpy()
        after = pa.array([b"", *map(self._marks, coded.dictionary.to_pylist())], pa.large_binary()).take(pa.array(place))
        return pc.binary_join_element_wise(made, after, pa.scalar(b"", pa.large_binary())), odd

    def _cores(self, words: pa.Array) -> pa.LargeBinaryArray:
        """The ids of different words after a blank (none of an empty one); those that were not known are from now on, but for very long ones."""
        if len(self.known) > KEPT_WORDS:
            self.known, self.older = Kept(), self.known
        at, lengths = self.known.find(words), pc.utf8_length(words).to_numpy()
        new = np.flatnonzero((at < 0) & (lengths > 0) & (lengths <= LONG_WORD))
        met = self.older.find(words.take(pa.array(new)))
        old, new, met = new[met >= 0], new[met < 0], met[met >= 0]
        for k, ids in ((old, self.older.ids.take(pa.array(met))), (new, self._joined(words.take(pa.array(new)).to_pylist()))):
            at[k] = len(self.known) + np.arange(len(k))
            self.known.add(words.take(pa.array(k)), ids)
        long = np.flatnonzero(lengths > LONG_WORD)
        at[long] = len(self.known) + np.arange(len(long))
        at[lengths == 0] = len(self.known) + len(long)
        return pa.concat_arrays([self.known.ids, *(self._ids([" " + words[k].as_py()]) for k in long.tolist()), NOTHING]).take(pa.array(at))

    def _marks(self, marks: str) -> bytes:
        """The ids of punctuation that follows a letter."""
        ids = self.marks.get(marks)
        if ids is None:
            ids = _values(self._ids([marks])).tobytes()
            if len(marks) <= LONG_WORD and len(self.marks) < KEPT_WORDS // 10:
                self.marks[marks] = ids
        return ids

    def _joined(self, words: list[str]) -> pa.LargeBinaryArray:
        """The ids of different words after a blank, which are their only one."""
        parts = [NOTHING[:0]]
        for k in range(0, len(words), JOINED):
            some = [" " + w for w in words[k : k + JOINED]]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            starts = np.flatnonzero(self.blank[ids])
            parts.append(_rows(ids, np.diff(starts, append=len(ids))) if len(starts) == len(some) else self._ids(some))
        return pa.concat_arrays(parts)

    def _ids(self, words: list[str]) -> pa.LargeBinaryArray:
        """The ids of each word, encoded by itself."""
        made = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        return _rows(np.array(made.ids, dtype="<u4"), np.bincount(np.array(made.word_ids, dtype=np.int64), minlength=len(words)))


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """The encoder of a worker, which its tasks share."""
    return Encoder(path)


def _some(bodies: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``TEXT_BYTES`` (a longer text by itself)."""
    sizes, start, held = pc.binary_length(bodies).to_numpy(zero_copy_only=False), 0, 0
    for k, n in enumerate(sizes.tolist()):
        if k > start and held + n > TEXT_BYTES:
            yield start, k
            start, held = k, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, text: str = "text") -> DataFrame:
    """Every document's token ids, cut: doc_id, piece, start, length, ids_crc32 (and ids)."""
    path = vocabulary or default_vocabulary()

    @released
    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, j - i) for b in batches for i, j in _some(b["body"])):
            rows: list[tuple] = []
            encoded = _encoder(path).encode(batch["body"])
            for doc_id, own in zip(batch["doc_id"].to_pylist(), encoded, strict=True):
                ids = np.append(own, np.array([CLOSING_ID], dtype="<u4"))
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(pairwise(cuts)):
                    rows.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), *([ids[a:b].view("<i4")] if with_ids else [])))
            cols = list(zip(*rows, strict=True)) or [()] * (5 + with_ids)
            types = [batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int32())] if with_ids else [])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)
            del encoded, rows, cols
            free_memory()  # what these texts took would stay beside what the next ones take

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body")).mapInArrow(tokenise, schema)


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Bins for ``counts`` pieces of each length: (lengths in a bin, number of such bins)."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    bins = []
    while left.any():
        free, chosen, gap = left.copy(), [], capacity
        while gap and (fits := np.flatnonzero(free[: gap + 1])).size:
            longest = int(fits[-1])
            # All copies that fit are taken at once: the gap shrinks below them or they run out.
            n = int(min(free[longest], gap // longest))
            free[longest] -= n
            chosen += [longest] * n
            gap -= n * longest
        while gap and len(chosen) > 1:
            smallest = chosen[-1]
            pair = _closest_pair(free, gap + smallest)
            if not pair or sum(pair) <= smallest:
                break
            free[smallest] += 1
            free[pair[0]] -= 1
            free[pair[1]] -= 1
            gap += smallest - sum(pair)
            chosen = sorted([*chosen[:-1], *pair], reverse=True)
        lengths, uses = np.unique(chosen, return_counts=True)
        times = int((left[lengths] // uses).min())
        left[lengths] -= uses * times
        bins.append((tuple(chosen), times))
    return bins


def _closest_pair(free: np.ndarray, room: int) -> tuple[int, int] | None:
    """The two unpacked lengths of largest sum within ``room``."""
    have = np.flatnonzero(free[: room + 1])
    if not have.size:
        return None
    other = np.searchsorted(have, room - have, side="right") - 1
    small = np.where(other >= 0, have[np.maximum(other, 0)], 0)
    small = np.minimum(small, have)
    # The same length twice needs two pieces of it; else the next shorter one.
    twice = (small == have) & (free[have] < 2)
    lower = np.where(np.arange(have.size) > 0, have[np.maximum(np.arange(have.size) - 1, 0)], 0)
    small = np.where(twice, lower, small)
    total = np.where(small > 0, have + small, 0)
    best = int(total.argmax())
    return (int(have[best]), int(small[best])) if total[best] else None


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, text: str = "text") -> DataFrame:
    """The pieces of all documents with sequence_id and offset (place in the sequence)."""
    text_batches(docs)
    # Read twice (counts, ranks), tokenised once.
    cuts = cut(pieces(docs, vocabulary, capacity, with_ids, text))
    # monotonically_increasing_id is fixed here: the written partitions don't change.
    cuts = cuts.withColumn("row", F.xxhash64(F.monotonically_increasing_id()))
    counts = {r["length"]: r["n"] for r in cuts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    levels = max(1, -(-sum(counts.values()) // BUCKET_ROWS))
    cuts = cuts.withColumn("bucket", F.pmod("row", F.lit(levels)))
    # Bucket counts are summed up in two levels too, so no window holds more than about the root of them.
    wide = max(1, isqrt(levels))
    sizes = cuts.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("here")).withColumn("slab", F.expr(f"bucket div {wide}"))
    slabs = sizes.groupBy("length", "slab").agg(F.sum("here").alias("whole"))
    earlier = F.sum("whole").over(Window.partitionBy("length").orderBy("slab")) - F.col("whole")
    slabs = slabs.select(F.col("length").alias("sl"), F.col("slab").alias("sb"), earlier.alias("earlier"))
    within = F.sum("here").over(Window.partitionBy("length", "slab").orderBy("bucket")) - F.col("here")
    before = sizes.withColumn("within", within).join(slabs, (F.col("length") == F.col("sl")) & (F.col("slab") == F.col("sb")))
    before = before.select(F.col("length").alias("l"), F.col("bucket").alias("b"), (F.col("earlier") + F.col("within")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row"))
    ranked = (
        cuts.withColumn("inside", inside)
        .join(before, (F.col("length") == F.col("l")) & (F.col("bucket") == F.col("b")))
        .withColumn("rank", F.col("before") + F.col("inside") - 1)
        .drop("l", "b", "bucket", "before", "inside", "row")
    )
    slots = _slots(best_two_fit(counts, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch), dtype=np.int64)
            lengths, ranks = batch["length"].to_numpy(), batch["rank"].to_numpy()
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                rank = ranks[at]
                first, base, where = slots[int(length)]
                k = np.searchsorted(first, rank, side="right") - 1
                sequence[at], offset[at] = base[k] + rank - first[k], where[k]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank") + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def _slots(bins: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length, by rank: first rank of a run of slots, its first sequence, the offset there."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for lengths, times in bins:
        offset = 0
        for length in lengths:
            first = used.get(length, 0)
            runs.setdefault(length, []).append((first, base, offset))
            used[length] = first + times
            offset += length
        base += times
    return {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v, strict=True)) for k, v in runs.items()}
