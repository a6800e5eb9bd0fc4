"""Token ids of odd and very long texts, and bins against a plain best-two-fit."""

import cProfile
import gc
import random
import tracemalloc
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from test_operators import prose, table
from tokenizers import Tokenizer

from tidewright.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.default_vocabulary())


def test_ids_of_any_text(tokenizer, monkeypatch):
    rng = random.Random(3)
    alphabet = ["a", "B", "é", "中", "\U0001f600", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", " ", "​", "'s", "1", ".", "<|endoftext|>", "\0", "ة", "́"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(6000)] + ["", " ", "a" * 300 + " b", "b " + "a" * 300, "x <|endoftext|> y", "a b\n", "a b \n c", "some words in a row, some words again"]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    encoder = packing.Encoder(packing.default_vocabulary())
    monkeypatch.setattr(packing, "KEPT_WORDS", 300)
    for k in range(0, len(texts), 500):
        assert [x.tolist() for x in encoder.encode(texts[k : k + 500])] == want[k : k + 500]


def test_words_are_kept_once_in_a_worker(tokenizer):
    encoder = packing._encoder(packing.default_vocabulary())
    assert packing._encoder(packing.default_vocabulary()) is encoder
    texts = ["so zyzzog, zyzzog. (zyzzog) zyzzog<|endoftext|> zyzzog<| it's zyzzog's; zyzzog"]
    assert [x.tolist() for x in encoder.encode(texts)] == [tokenizer.encode(texts[0], add_special_tokens=False).ids]
    assert "zyzzog" in encoder.known and not {"zyzzog,", "zyzzog."} & encoder.known.keys()


def test_kept_words_take_little_memory(tokenizer):
    encoder = packing.Encoder(packing.default_vocabulary())
    texts = [" ".join(f"w{i:x}" for i in range(k, k + 1000)) for k in range(0, 40_000, 1000)]
    encoder.encode(["a"])
    tracemalloc.start()
    try:
        held = -pa.total_allocated_bytes()
        for text in texts:
            encoder.encode([text])
        gc.collect()
        held += tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes()
    finally:
        tracemalloc.stop()
    assert len(encoder.known) > 39_000 and held < 60 * len(encoder.known)
    assert encoder.encode(texts[-1:])[0].tolist() == tokenizer.encode(texts[-1], add_special_tokens=False).ids


def test_known_words_take_no_python_calls(tokenizer):
    encoder = packing.Encoder(packing.default_vocabulary())
    text = " ".join(f"w{i:x}a," for i in range(20_000))
    encoder.encode([text])
    profile = cProfile.Profile()
    ids = profile.runcall(encoder.encode, [text])
    assert ids[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert sum(e.callcount for e in profile.getstats()) < 5000


def test_very_long_texts(spark, tokenizer):
    rng = random.Random(4)
    texts = [" " * 1_200_000, "\t" * 1_200_000, "\n" * 1_200_000, "x" * 5_000_000, prose(rng, 400_000), " \n" * 300_000]
    rows = packing.pack(table(spark, texts), with_ids=True).orderBy("doc_id", "piece").collect()
    back = defaultdict(list)
    for r in rows:
        assert r["start"] == len(back[r["doc_id"]]) and (r["length"] == 1024 or r["piece"] == 0)
        back[r["doc_id"]] += r["ids"]
    assert back == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}


def plain_bins(lengths, capacity):
    """One bin at a time, over a list of pieces: greedy, then the smallest piece for the two that fit its gap best."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        room, chosen, free = capacity, [], list(left)
        while fits := [x for x in free if x <= room]:
            chosen.append(fits[0])
            free.remove(fits[0])
            room -= fits[0]
        while room and len(chosen) > 1:
            last = min(chosen)
            pairs = [free[i] + free[j] for i in range(len(free)) for j in range(i) if last < free[i] + free[j] <= room + last]
            if not pairs:
                break
            best = max(pairs)
            # Of several such pairs, the most even one.
            a = min(x for k, x in enumerate(free) if 2 * x >= best and best - x in free[:k] + free[k + 1 :])
            for x in (a, best - a):
                free.remove(x)
                chosen.append(x)
            chosen.remove(last)
            free = sorted([*free, last], reverse=True)
            room -= best - last
        bins.append(tuple(sorted(chosen, reverse=True)))
        left = free
    return bins


@pytest.mark.parametrize("capacity", [10, 37, 64])
def test_bins_are_those_of_a_plain_packer(capacity):
    rng = random.Random(capacity)
    for _ in range(60):
        lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 40))]
        got = Counter()
        for bin_, times in packing.best_two_fit(Counter(lengths), capacity):
            got[bin_] += times
        assert got == Counter(plain_bins(lengths, capacity))
