"""Near duplicates by HyperMinHash registers, banding and exact verification.

A document is the set of its word shingles. Documents with one and the same set
form a class, of which only the smallest id goes on. The set's hashes fall into
``REGISTERS`` buckets; of each bucket's smallest hash a register keeps the number
of leading zeros and ``MANTISSA`` further bits (16 bits in all). Bands of
``ROWS`` registers propose partners:

* In a band bucket of up to ``SMALL`` members all pairs are proposed (at most
  ``SMALL / 2`` a member), then thinned by the Jaccard estimate of the registers,
  corrected for registers that agree by accident.
* In a larger bucket members meet its ``LEADERS`` most central members: those
  whose bands are the most crowded, that is, the versions with the fewest edits,
  which any member that resembles some other one resembles at least as much.
  Members are dealt over tasks of ``CHUNK``, each with a copy of the leaders, so
  neither a task nor the number of pairs grows with the square of a group.
* A member that has enough other bands to find its partners there leaves the
  larger buckets (see ``_staying``): a passage that very many texts share crowds
  some bands of each, but by far not all.
* What the leaders leave apart is settled exactly, without comparing all members.
  All buckets with one main component are a group, and its member with most links
  the pivot. If u is not similar to the pivot, and v is no shorter than it, then
  similar u and v share a shingle that the pivot has not: else u would share as
  much with the pivot. So every member names its shingles outside the pivot, as
  many as a prefix filter asks for, and those that members of several components
  name propose pairs, as small buckets do. The members that name one shingle meet in
  a block of at most ``BLOCK`` by ``BLOCK``; a shingle with more of them is a
  bucket of the next round (a group within the group, with a pivot of its own),
  for ``LEVELS`` rounds. What is left then, and the few pairs with a v shorter
  than the pivot and nearly all of it inside it, meet in several blocks.

Proposed pairs are confirmed on the full sets; components are those of the
confirmed links. Registers accept a pair ``SLACK`` standard deviations below the
threshold, which loses one in a million.

Defined results: a null or wordless text has the empty set, is linked with
nothing and is its own component; a text with fewer words than a shingle is one
shingle; a row with a null id is linked with nothing and kept (component null);
rows that repeat an id share its component; extra columns pass through ``dedup``
and are ignored elsewhere; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, cut_narrow, released, text_batches
from .components import components
from .names import fresh
from .shingles import forgetting, mixed, shared, shingle_set

WORDS = 5
PERCENT = 80
REGISTERS, ROWS, MANTISSA = 128, 4, 10
SMALL, LEADERS, CHUNK, BLOCK = 16, 12, 256, 512
SLACK = 5.0
LEVELS = 3
#: Chance of losing a partner up to which a document leaves the larger buckets.
MISS = 1e-6
#: Ids of at most this many documents are broadcast (8 bytes each).
BROADCAST_ROWS = 1_000_000


def node(hashes: np.ndarray) -> int:
    """The number of a set: a signed 64-bit hash of its members."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).view(np.int64))


def registers(hashes: np.ndarray) -> np.ndarray:
    """The 16-bit registers of a sorted set of hashes; 0 where a bucket is empty."""
    bits = int(REGISTERS).bit_length() - 1
    out = np.zeros(REGISTERS, dtype=np.uint16)
    if hashes.size:
        # Sorted hashes: the first of each bucket (leading bits) is its smallest.
        bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        rest = hashes[first] << np.uint64(bits)
        # Exact powers of two keep the leading bit; frexp of the upper half is exact enough for zeros below 2**-52.
        zeros = np.minimum(63, 64 - np.frexp(rest.astype(np.float64))[1])
        zeros = np.where(rest == 0, 63, zeros).astype(np.uint64)
        after = (rest << zeros) << np.uint64(1)
        out[bucket[first]] = ((zeros + np.uint64(1)) << np.uint64(MANTISSA)).astype(np.uint16) | (after >> np.uint64(64 - MANTISSA)).astype(np.uint16)
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of register rows, corrected for accidental agreement, and registers in use."""
    used = np.count_nonzero((a != 0) | (b != 0), axis=-1)
    equal = np.count_nonzero((a == b) & (a != 0), axis=-1)
    # Two independent minima agree in their zeros one time in three, and then in the mantissa.
    accident = 2.0**-MANTISSA / 3
    return np.clip((equal / np.maximum(used, 1) - accident) / (1 - accident), 0, 1), used


def plausible(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether register rows allow a Jaccard similarity of ``percent``."""
    t = percent / 100
    guess, used = estimate(a, b)
    return guess >= t - SLACK * np.sqrt(t * (1 - t) / np.maximum(used, 1))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets have 100 * intersection >= percent * union."""
    if 100 * min(a.size, b.size) < percent * max(a.size, b.size):
        return False
    n = shared(a, b)
    return 100 * n >= percent * (a.size + b.size - n)


def sketches(docs: DataFrame, words: int = WORDS, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, node (64-bit hash of the set; null for the empty one), registers of every row."""

    @released
    @forgetting
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, rows = [], [], []
            for body in batch["body"]:
                s = shingle_set(body.as_py(), words)
                sizes.append(s.size)
                nodes.append(node(s) if s.size else None)
                rows.append(registers(s).tobytes() if s.size else None)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(rows, pa.binary())], names=["doc_id", "n_shingles", "node", "registers"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).cast("string").alias("body")).mapInArrow(sketch, f"doc_id {id_type}, n_shingles long, node long, registers binary")


def _bands(reps: DataFrame) -> DataFrame:
    """rep, band (a hash of the band's number and registers) of every band in use."""

    @released
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                r = np.frombuffer(b"".join(batch["registers"]), dtype="<u8").reshape(len(batch), -1)  # four registers are one number
                band = mixed(r + mixed(np.arange(1, r.shape[1] + 1, dtype=np.uint64))[None, :])
                row, col = np.nonzero(r)
                yield pd.DataFrame({"rep": batch["rep"].to_numpy()[row], "band": band[row, col].view(np.int64)})

    return reps.select("rep", "registers").mapInPandas(split, "rep long, band long")


def _sets(docs: DataFrame, nodes: DataFrame, words: int, text: str) -> DataFrame:
    """rep, hashes (sorted set as bytes) of the classes in ``nodes`` (rep, and the id of a document of the class)."""
    ids = cut(nodes.select("doc_id").distinct())
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    chosen = docs.select("doc_id", F.col(text).cast("string").alias("body")).join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")

    @released
    @forgetting
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [s for s in (shingle_set(x.as_py(), words) for x in batch["body"]) if s.size]
            yield pa.RecordBatch.from_arrays([pa.array([node(s) for s in made], pa.int64()), pa.array([s.tobytes() for s in made], pa.binary())], names=["rep", "hashes"])

    return chosen.mapInArrow(build, "rep long, hashes binary")


def _hint(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it has few enough rows (of some tens of bytes)."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b (written) whose full sets are similar."""

    @released
    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = [similar(np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8"), percent) for x, y in zip(batch["s_a"], batch["s_b"], strict=True)]
            yield batch.loc[np.array(good, dtype=bool), ["a", "b"]]

    full = lambda end: sets.select(F.col("rep").alias(end), F.col("hashes").alias(f"s_{end}"))
    return _hint(pairs).join(full("a"), "a").join(full("b"), "b").mapInPandas(confirm, "a long, b long")


def _thinned(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b (written) that their registers allow."""

    @released
    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                a, b = (np.frombuffer(b"".join(batch[c]), dtype="<u2").reshape(len(batch), REGISTERS) for c in ("r_a", "r_b"))
                yield batch.loc[plausible(a, b, percent), ["a", "b"]]

    regs = lambda end: reps.select(F.col("rep").alias(end), F.col("registers").alias(f"r_{end}"))
    return _hint(pairs).join(regs("a"), "a").join(regs("b"), "b").mapInPandas(thin, "a long, b long")


def _staying(large: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """rep: the members of larger buckets that their other bands alone would not do for.

    With a share q of its bands in larger buckets, and bands that agree with a
    partner's with probability a, a document misses a partner in all its other
    bands with probability ((1 - a) / (1 - q)) ** (number of others), as a partner
    that shares what all of the crowd shares does so in at most q of the bands.
    Up to ``MISS`` the smaller buckets, where all pairs meet, do the whole work.
    """

    @released
    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                r = np.frombuffer(b"".join(batch["registers"]), dtype="<u2").reshape(len(batch), -1, ROWS)
                used, crowded = np.count_nonzero(r.any(axis=2), axis=1), batch["crowded"].to_numpy()
                agree, share = (percent / 100) ** (np.count_nonzero(r, axis=(1, 2)) / used), crowded / used
                miss = np.where(agree > share, ((1 - agree) / np.maximum(1 - share, 1e-9)) ** (used - crowded), 1.0)
                yield batch.loc[miss > MISS, ["rep"]]

    counts = large.groupBy("rep").agg(F.count(F.lit(1)).alias("crowded"))
    return counts.join(reps.select("rep", "registers"), "rep").mapInPandas(choose, "rep long")


def links(docs: DataFrame, reps: DataFrame, words: int, percent: int, text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Confirmed links a, b between classes (``reps``: rep, registers, doc_id of a member); the larger buckets (rep, band); their members' sets."""
    bands = _bands(reps)
    crowded = bands.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    met, parts = cut_narrow(bands.join(crowded, "band"))
    # Pairs of small buckets; each band has every representative once.
    small = met.where(F.col("members") <= SMALL)
    left, right = small.select("band", F.col("rep").alias("a")), small.select("band", F.col("rep").alias("b"))
    pairs, _ = cut_narrow(left.join(right, "band").where("a < b").select("a", "b").coalesce(parts).distinct())
    near, _ = cut_narrow(_thinned(pairs, reps, percent))
    # Large buckets: a member goes to its most and its least crowded one.
    large = met.where(F.col("members") > SMALL)
    staying, _ = cut_narrow(_staying(large, reps, percent))
    large, _ = cut_narrow(large.join(_hint(staying), "rep", "left_semi"))
    centrality = large.groupBy("rep").agg(F.sum(F.log2("members")).alias("weight"), F.min(F.struct("members", "band")).alias("least"), F.max(F.struct("members", "band")).alias("most"))
    member = centrality.select("rep", F.explode(F.array_distinct(F.array("least", "most"))).alias("home")).select("rep", "home.*")
    homes = member.select("band", "members").distinct()
    order = Window.partitionBy("band").orderBy(F.desc("weight"), "rep")
    leaders = (
        large.join(homes.select("band"), "band", "left_semi")
        .join(centrality.select("rep", "weight"), "rep")
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= LEADERS)
    )
    chunks = F.ceil(F.col("members") / CHUNK)
    member, _ = cut_narrow(member.withColumn("chunk", F.pmod(F.xxhash64("rep"), chunks)).select("rep", "band", "chunk"))
    leaders, _ = cut_narrow(leaders.select("rep", "band", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk")))
    wanted = near.select(F.col("a").alias("rep")).union(near.select("b")).union(member.select("rep")).union(leaders.select("rep")).distinct()
    sets = cut(_sets(docs, wanted.join(reps.select("rep", "doc_id"), "rep"), words, text).dropDuplicates(["rep"]))

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        heads, members, found = rows[rows["head"]], rows[~rows["head"]], []
        if len(members) and len(heads):
            table = np.array([np.frombuffer(x, dtype="<u2") for x in heads["registers"]])
            tops = [(rep, np.frombuffer(x, dtype="<u8")) for rep, x in zip(heads["rep"], heads["hashes"], strict=True)]
            for rep, own, bits in zip(members["rep"], members["hashes"], members["registers"], strict=True):
                mine = np.frombuffer(own, dtype="<u8")
                likely = plausible(table, np.frombuffer(bits, dtype="<u2")[None, :], percent)
                found += [(rep, head) for (head, other), ok in zip(tops, likely, strict=True) if ok and head != rep and similar(mine, other, percent)]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    crowd = member.withColumn("head", F.lit(False)).union(leaders.withColumn("head", F.lit(True)))
    crowd = crowd.join(sets, "rep").join(reps.select("rep", "registers"), "rep")
    starred = crowd.groupBy("band", "chunk").applyInPandas(meet, "a long, b long")
    return _confirmed(near, sets, percent).union(starred), large.select("rep", "band"), sets


#: What a pivot says of a member: linked with it (``e`` is the pivot), has the
#: shingle ``e`` that the pivot has not, may be like a shorter one, is a shorter one.
LINK, OWN, ASKS, SHORT = 0, 1, 2, 3


def _groups(buckets: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """main, rep, component, weight (buckets), size of the members of all buckets with several components; main is a bucket's largest one.

    The buckets of one group have one main component, and a member stands there once.
    """
    named = buckets.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    sizes = named.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    mains = sizes.groupBy("band").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all"))
    mains = mains.where("all > top.n").select("band", F.col("top.component").alias("main"))
    placed = named.join(mains, "band").groupBy("main", "rep").agg(F.first("component").alias("component"), F.count(F.lit(1)).alias("weight"))
    return placed.join(sets.select("rep", F.expr("octet_length(hashes) div 8").alias("size")), "rep")


def _told(placed: DataFrame, degrees: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """main, rep, component, kind, e: what the pivot of every group says of the members; it is the main component's member with most links (``degrees``: rep, links)."""
    counts = placed.groupBy("main").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"), F.min("size").alias("least"))
    heads = placed.where("component = main").join(degrees, "rep", "left")
    pivots = heads.groupBy("main").agg(F.max_by("rep", F.struct(F.coalesce("links", F.lit(0)), "weight", "rep")).alias("pivot"))
    heads = counts.join(pivots, "main").join(sets.select(F.col("rep").alias("pivot"), F.col("hashes").alias("pivoted")), "pivot")
    heads = heads.select("main", "pivot", "pivoted", "least", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    dealt = placed.join(_hint(counts.select("main", "chunks")), "main").withColumn("chunk", F.pmod(F.xxhash64("rep"), "chunks"))
    both = dealt.join(sets, "rep").join(heads, ["main", "chunk"]).select("main", "rep", "component", "hashes", "pivot", "pivoted", "least")

    @released
    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for main, rep, component, own, pivot, other, least in batch.itertuples(index=False):
                x, y = np.frombuffer(own, dtype="<u8"), np.frombuffer(other, dtype="<u8")
                at = np.minimum(np.searchsorted(y, x), y.size - 1)
                mine = x[y[at] != x]
                inside = x.size - mine.size
                linked = (100 + percent) * inside >= percent * (x.size + y.size)
                if component != main:
                    if linked:
                        out.append((main, rep, component, LINK, pivot))
                    elif (100 + percent) * inside >= percent * (x.size + least):
                        out.append((main, rep, component, ASKS, 0))
                if x.size < y.size and 100 * inside >= percent * x.size:
                    out.append((main, rep, component, SHORT, 0))
                # A partner shares at least so many shingles that the pivot has not; so one of it is among these.
                shares = max(1, -(-percent * x.size // 100) - inside)
                out += [(main, rep, component, OWN, e) for e in mine[: max(mine.size - shares + 1, 0)].view(np.int64).tolist()]
            yield pd.DataFrame(out, columns=["main", "rep", "component", "kind", "e"]).astype({"kind": "int32"})

    return both.mapInPandas(tell, "main long, rep long, component long, kind int, e long")


def leftovers(large: DataFrame, labels: DataFrame, confirmed: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: further links between members of one larger bucket that are in different components (``labels``: node, component) by the ``confirmed`` ones."""
    schema, spark = "a long, b long", large.sparkSession
    found, asking, asked = [], [], []
    buckets = large
    for level in range(LEVELS + 1):
        placed, _ = cut_narrow(_groups(buckets, labels, sets))
        if placed.isEmpty():
            break
        if not level:
            # Later rounds are about the same members or fewer.
            members = _hint(placed.select("rep").distinct())
            sets, reps = (t.join(members, "rep", "left_semi") for t in (sets, reps))
            degrees = confirmed.select(F.col("a").alias("rep")).union(confirmed.select("b")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
            degrees = _hint(cut_narrow(degrees)[0])
        named = placed.select(F.xxhash64("main", F.lit(level)).alias("main"), "rep", "component", (F.col("component") != F.col("main")).alias("other"))
        if level == LEVELS:
            asking.append(named.where("other").drop("other"))
            asked.append(named.drop("other"))
            break
        told, parts = cut_narrow(_told(placed, degrees, sets, percent))
        kinds = {r["kind"] for r in told.select("kind").distinct().collect()}  # at most four
        found.append(told.where(F.col("kind") == LINK).select(F.col("rep").alias("a"), F.col("e").alias("b")))
        if {ASKS, SHORT} <= kinds:
            member = lambda kind: told.where(F.col("kind") == kind).select(F.xxhash64("main", F.lit(level)).alias("main"), "rep", "component")  # noqa: B023, E731
            asking.append(member(ASKS))
            asked.append(member(SHORT))
        own = told.where(F.col("kind") == OWN).select(F.xxhash64("main", "e").alias("band"), "rep", "component")
        mixed_up = own.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band", "n", "lo")
        met, _ = cut_narrow(own.join(mixed_up, "band").coalesce(parts))
        end = lambda name: met.where(F.col("n") <= SMALL).select("band", F.col("rep").alias(name), F.col("component").alias(f"c_{name}"))  # noqa: B023, E731
        pairs, _ = cut_narrow(end("a").join(end("b"), "band").where("a < b and c_a <> c_b").select("a", "b").coalesce(parts).distinct())
        found.append(_confirmed(cut_narrow(_thinned(pairs, reps, percent))[0], sets, percent))
        # Up to a block's members meet at once; the links of all of one component to the others are links of the others.
        block = met.where((F.col("n") > SMALL) & (F.col("n") <= BLOCK)).select(F.xxhash64("band", F.lit(level)).alias("main"), "rep", "component", "lo")
        asking.append(block.where("component <> lo").drop("lo"))
        asked.append(block.drop("lo"))
        buckets = met.where(F.col("n") > BLOCK).select("rep", "band")
    if asking:
        union = lambda parts: reduce(DataFrame.union, parts)
        found.append(_blocks(union(asking), union(asked), reps, sets, percent))
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], schema)


def _blocks(asking: DataFrame, asked: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: confirmed links of ``asking`` and ``asked`` members (main, rep, component) of one group, in blocks of ``BLOCK`` by ``BLOCK``."""
    counts = asked.groupBy("main").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    counts = _hint(cut_narrow(counts.join(asking.groupBy("main").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("rows")), "main"))[0])
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    keys = ["main", "block", "row"]
    columns = ["rep", "main", "component", "block", "row", "other"]
    members = asked.join(counts, "main").withColumns({"block": own("blocks"), "row": every("rows"), "other": F.lit(False)}).select(columns)
    others = asking.join(counts, "main").withColumns({"row": own("rows"), "block": every("blocks"), "other": F.lit(True)}).select(columns)

    def likely(part: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, Iterator[np.ndarray]]:
        """Others, members, and for each of the others the members of other components that it may resemble."""
        heads, rest = part[part["other"]], part[~part["other"]]
        table = np.array([np.frombuffer(x, dtype="<u2") for x in rest["registers"]]).reshape(-1, REGISTERS)
        bands, component = table.view("<u8"), rest["component"].to_numpy()

        def found() -> Iterator[np.ndarray]:
            for bits, label in zip(heads["registers"], heads["component"], strict=True):
                mine = np.frombuffer(bits, dtype="<u8")
                near = np.flatnonzero(((bands == mine) & (mine != 0)).any(axis=1) & (component != label))
                yield near[plausible(table[near], np.frombuffer(bits, dtype="<u2")[None, :], percent)]

        return heads, rest, found()

    def narrow(part: pd.DataFrame) -> pd.DataFrame:
        heads, rest, found = likely(part)
        met, used = np.zeros(len(rest), dtype=bool), np.zeros(len(heads), dtype=bool)
        for k, near in enumerate(found):
            used[k] = near.size > 0
            met[near] = True
        return pd.concat([heads[used], rest[met]])[columns]

    def settle(part: pd.DataFrame) -> pd.DataFrame:
        heads, rest, found = likely(part)
        sets_of, reps_of, labels_of = rest["hashes"].to_numpy(), rest["rep"].to_numpy(), rest["component"].to_numpy()
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while x in root:
                x = root[x]
            return x

        out = []
        for rep, label, hashes, near in zip(heads["rep"], heads["component"], heads["hashes"], found, strict=True):
            mine = np.frombuffer(hashes, dtype="<u8")
            for j in near:
                a, b = top(label), top(labels_of[j])
                if a != b and similar(mine, np.frombuffer(sets_of[j], dtype="<u8"), percent):
                    root[a] = b
                    out.append((rep, reps_of[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    bits = reps.select("rep", "registers")
    schema = "rep long, main long, component long, block long, row long, other boolean"
    kept, _ = cut_narrow(members.union(others).join(bits, "rep").groupBy(*keys).applyInPandas(narrow, schema))
    return kept.join(bits, "rep").join(sets, "rep").groupBy(*keys).applyInPandas(settle, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked id) and kept (the id is its component's)."""
    text_batches(docs)
    made = cut(sketches(docs, words, text))
    linked = made.where("doc_id is not null and node is not null")
    classes = cut(linked.groupBy(F.col("node").alias("rep")).agg(F.min("doc_id").alias("doc_id"), F.min("registers").alias("registers")))
    # An id that names several texts ties their classes together.
    tied = linked.groupBy("doc_id").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("doc_id", "least")
    ties = linked.join(tied, "doc_id").select(F.col("node").alias("a"), F.col("least").alias("b"))
    confirmed, large, sets = links(docs, classes, words, percent, text)
    confirmed, _ = cut_narrow(confirmed)
    found, _ = cut_narrow(components(confirmed.union(ties)))
    named = classes.select("rep", "doc_id").join(found, F.col("rep") == F.col("node"), "left").select("rep", "doc_id", F.coalesce("component", "rep").alias("component"))
    named, _ = cut_narrow(named)
    more, _ = cut_narrow(leftovers(large, found, confirmed, classes, sets, percent))
    if not more.isEmpty():
        # Few links, between components: these are what is joined up now.
        label = lambda end: named.select(F.col("rep").alias(end), F.col("component").alias(f"c_{end}"))
        joined = components(more.join(label("a"), "a").join(label("b"), "b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b")))
        joined = joined.select(F.col("node").alias("n"), F.col("component").alias("root"))
        named = named.join(joined, F.col("component") == F.col("n"), "left").select("rep", "doc_id", F.coalesce("root", "component").alias("component"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "component").select(F.col("rep").alias("node"), "component_id")
    rows = made.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node"))
    component = F.coalesce("component_id", "doc_id")
    out = rows.join(named, "node", "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def dedup(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents that another one of their group stands for."""
    name = fresh(docs, "gone")
    # Rows that repeat the id of a kept document repeat its text or are tied to it.
    gone = cut(near_duplicates(docs, words, percent).where("not kept").select(F.col("doc_id").alias(name)).distinct())
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, F.col("doc_id") == F.col(name), "left_anti")
