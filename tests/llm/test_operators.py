"""Each numbered operator against a plain version on small tables, and defined results on odd ones."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewright.llm import ann, decontamination, licenses, near_duplicates, packing, pii, quality, queries, repeats, sharding, suffix_array, toxicity
from tidewright.llm.components import components

#: Extra columns have the names of result and inner columns.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, pii string, key long, rank int, gone long, body string, hits_card string"
WORDS = [f"w{i}" for i in range(300)]


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en" if k % 3 else None, f"s{k % 2}" if k % 5 else None, len(t or ""), None, None, "x", 1, 2, 3, "b", "h") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    base = [prose(rng, rng.randrange(20, 200)) for _ in range(40)]
    passage = prose(rng, 90)
    near = []
    for _ in range(40):
        words = base[0].split()
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(len(words))] = "edit" + str(rng.randrange(10_000))
        near.append(" ".join(words))
    odd = ["", None, " \t\n", "a", "one two three", "one two three", "é 中文 \U0001f600 text", "ab" * 900, prose(rng, 4000)]
    mixed = [f"{prose(rng, 20)}\n{passage}\n{prose(rng, 15)}" for _ in range(6)]
    return base + base[:5] + near + mixed + odd


def test_suffix_arrays():
    rng = random.Random(1)
    for alphabet in (1, 2, 3, 20):
        for n in (0, 1, 2, 5, 50, 400):
            s = [rng.randrange(1, alphabet + 1) for _ in range(n)] + [0]
            assert suffix_array.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])
    assert suffix_array.suffix_array([]) == []


def removed(texts, length=200):
    count = Counter()
    bodies = [(t or "").encode() for t in texts]
    for b in bodies:
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats(spark, texts):
    got = repeats.digest(repeats.remove_repeats(table(spark, texts))).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == removed(texts)


def test_repeats_of_crowded_anchors(spark, texts, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", 2)
    got = repeats.digest(repeats.remove_repeats(table(spark, texts))).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == removed(texts)


def shingles_of(text, words):
    body = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
    w = re.findall(rb"[^\x20\x09-\x0d]+", body)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + words]) for i in range(max(len(w) - words + 1, 1)))


def near_groups(texts, words, percent):
    sets = [shingles_of(t, words) for t in texts]
    low = list(range(len(texts)))
    for _ in range(len(texts)):
        before = list(low)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if i < j and a and b and 100 * len(a & b) >= percent * len(a | b):
                    low[i] = low[j] = min(low[i], low[j])
        if low == before:
            break
    return [(len(s), c, c == i) for i, (s, c) in enumerate(zip(sets, low, strict=True))]


@pytest.mark.parametrize("small", [16, 3])
def test_near_duplicates(spark, texts, monkeypatch, small):
    """With small buckets of 3 members most groups take the way of the larger ones."""
    monkeypatch.setattr(near_duplicates, "SMALL", small)
    monkeypatch.setattr(near_duplicates, "LEADERS", 12 if small > 3 else 1)
    got = near_duplicates.near_duplicates(table(spark, texts), 4, 80).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == near_groups(texts, 4, 80)


def test_near_duplicate_rows_of_odd_ids(spark):
    got = near_duplicates.near_duplicates(table(spark, ["a b c d e", "a b c d e", "x y z", "a b c d e"], [5, 5, 5, None])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in got) == [(-1, None, True), (5, 5, True), (5, 5, True), (5, 5, True)]
    kept = near_duplicates.dedup(table(spark, ["p q r s t u"] * 5))
    assert [r["doc_id"] for r in kept.collect()] == [0] and kept.columns == table(spark, []).columns


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)]
    low = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: c for x, c in low.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_sharding(spark, texts):
    rows = [r.asDict() for r in sharding.interleave(table(spark, texts), 8).collect()]
    assert len(rows) == len(texts)
    by = {r["doc_id"]: r for r in rows}
    for i, t in enumerate(texts):
        body = (t or "").encode()
        assert (by[i]["size"], by[i]["text_crc32"]) == (len(body) + 1, zlib.crc32(body))
    shards = defaultdict(list)
    for r in rows:
        shards[r["shard"]].append(r)
    sizes = [len(x) for x in shards.values()]
    assert len(shards) == 8 and max(sizes) - min(sizes) <= 1
    total = Counter(r["source"] for r in rows)
    for x in shards.values():
        assert sorted(r["slot"] for r in x) == list(range(len(x)))
        own = Counter(r["source"] for r in x)
        assert all(abs(own[s] - total[s] / 8) <= 2 for s in total)
    assert sharding.interleave(table(spark, [])).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 32)).astype("float32")
    x[100] = x[7]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(3000, None), (3001, [0.0] * 32), (3002, [float("nan")] + [1.0] * 31), (3003, [1.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 20, 20).collect()
    by = defaultdict(dict)
    for r in got:
        by[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    assert sorted(by) == list(range(0, 3000, 20))
    y, hits = x.astype(float), 0
    for q, found in by.items():
        assert sorted(found) == list(range(1, 21))
        s = y @ y[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20]) & {v for v, _ in found.values()})
        pairs = [found[k] for k in range(1, 21)]
        assert all(score == pytest.approx(s[v], abs=1e-12) for v, score in pairs)
        assert pairs == sorted(pairs, key=lambda p: (-p[1], p[0]))
    assert hits / (20 * len(by)) >= 0.9
    few = ann.search(spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>"), 20, 20).collect()
    assert [(r["query_id"], r["rank"]) for r in few] == [(0, 1), (0, 2)]
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), 20, 20).count() == 0


def test_packing(spark, texts):
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*e.ids, 2] for i, e in enumerate(t.encode_batch([x or "" for x in texts], add_special_tokens=False))}
    rows = packing.pack(table(spark, texts)).collect()
    back = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(part, dtype="<u4").tobytes()) == r["ids_crc32"]
        assert r["start"] == len(back[r["doc_id"]]) and (r["length"] == 1024 or r["piece"] == 0)
        back[r["doc_id"]] += part
    assert back == ids
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 1024
    total = sum(map(len, ids.values()))
    assert len(bins) <= -(-total // 1024) + 2
    assert packing.pack(table(spark, [])).count() == 0


def test_two_documents_take_a_smaller_ones_place():
    bins = packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)
    assert (6, 2, 2) in [b for b, _ in bins]
    assert sum(n * len(b) for b, n in bins) == 4


LUHN = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]


def spans_of(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else LUHN[int(c)] for k, c in enumerate(reversed(d))) % 10 == 0:
            found.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, m.end(), "phone"))
    return sorted(found)


def test_personal_data(spark, texts):
    rng = random.Random(9)
    alphabet = list("0123456789..--@@ab+() \n") + ["1.2.3.4", "x@y.zz", "4111 1111 1111 1111", "+1 (555) 010-9999", "é", "\U0001f600", "@a.b.c"]
    noise = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(1500)]
    known = ["card 4111 1111 1111 1111 iban GB82 WEST 1234 5698 7654 32, ssn 123-45-6789 social", "x@y.zz@a.bb", "1.2.3.4.5.6.7.8", "+" * 50]
    every = texts + noise + known
    got = pii.digest(pii.find(table(spark, every))).orderBy("doc_id").collect()
    assert len(got) == len(every)
    for r, t in zip(got, every, strict=True):
        want = spans_of(t or "")
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[3] == k for s in want) for k in ("email", "ip", "card", "phone")], t
        listed = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), t
        assert set(filter(None, listed.split(","))) <= set(r["spans"].split(","))
    assert "iban:" in got[-4]["spans"] and "ssn:" in got[-4]["spans"]
    clean = pii.redact(table(spark, known[:1])).first()["text"]
    assert clean == "card [CARD] iban [IBAN], ssn [SSN] social"
    assert pii.redact(table(spark, [None])).first()["text"] is None
    found = pii.find(table(spark, known))
    assert found.columns == table(spark, []).columns and {(r["body"], r["hits_card"]) for r in found.collect()} == {("b", "h")}
    assert pii.digest(pii.find(table(spark, []))).count() == 0


def best_window(text, form):
    """The greatest coefficient over all windows of the words, by trying each."""
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    want = [w for w in re.split(r"[\W_]+", form.lower()) if w]
    pairs, own = list(zip(words, words[1:])), Counter(zip(want, want[1:]))
    size, best = sum(own.values()), 0.0
    for i in range(len(pairs)):
        left, shared = Counter(own), 0
        for n, pair in enumerate(pairs[i : i + 2 * size], 1):
            shared += left[pair] > 0
            left[pair] -= 1
            best = max(best, 2 * shared / (n + size))
    return best


def test_licences(spark, texts):
    short = licenses.TEMPLATES["MIT"][1]
    mit = licenses.TEMPLATES["MIT"][3]
    words = licenses.TEMPLATES["ISC"][1].split()
    header = "int a = 1; /*\n" + "\n".join(" * " + " ".join(words[k : k + 9]) for k in range(0, len(words), 9)) + "\n */ int main() {}"
    more = [
        mit,
        f"some words\n\n{mit}\n\nmore",
        "header\nLicensed under the MIT License.\nend",
        f"The code of this page is {short} It has been so since its first day.",
        header,
        mit.replace("without restriction", "with no limit"),
        "the the the " * 60 + short,
        "it is licensed",
    ]
    every = texts + more
    forms = {"MIT": [short, mit, "of the people of the land of the free"], "ISC": [licenses.TEMPLATES["ISC"][1]]}
    got = {(r["doc_id"], r["license"], r["template"]): r for r in licenses.scan(table(spark, every), forms).collect()}
    want = {}
    for i, t in enumerate(every):
        for name, texts_of in forms.items():
            for k, form in enumerate(texts_of):
                d = best_window(t or "", form)
                if d >= 0.8:
                    want[i, name, k] = d
    assert got.keys() == want.keys() and all(got[k]["dice"] == pytest.approx(want[k]) for k in got)
    at = len(texts)
    assert {i - at for i, _, _ in got} == {0, 1, 2, 3, 4, 5, 6}
    assert got[at + 3, "MIT", 0]["unit"] == short.rstrip(".")
    assert got[at + 4, "ISC", 0]["dice"] == 1 and got[at + 4, "ISC", 0]["unit"].startswith("Permission to use")
    assert licenses.scan(table(spark, [])).count() == 0


def test_licence_templates_match_themselves():
    made = licenses.prepare(licenses.TEMPLATES)
    known = {pair for t in made for pair in t.bigrams}
    for name, forms in licenses.TEMPLATES.items():
        for k, form in enumerate(forms):
            found = {(m[0], m[1]): m[2] for m in licenses.matches(f"so it is said {form} and so on", made, known)}
            assert found[name, k] == 1


def test_licence_places_in_pieces(monkeypatch):
    form = licenses.TEMPLATES["MIT"][1]
    made = licenses.prepare({"MIT": [form]})
    text = "some __ words. " * 40 + "x" * 90 + " İn " + form + " more words" * 30
    want = licenses.matches(text, made, set(made[0].bigrams))
    for size in (1, 7, 50, 64):
        monkeypatch.setattr(licenses, "PIECE", size)
        assert licenses.matches(text, made, set(made[0].bigrams)) == want == [("MIT", 0, 1.0, form.rstrip("."))]


def test_contained_items(spark, texts):
    rng = random.Random(2)
    items = [prose(rng, n) for n in (1, 3, 5, 8, 20, 40)] + ["", None]
    held = [f"{prose(rng, 50)} {i} {prose(rng, 30)}" for i in items[2:6]]
    part = " ".join(items[5].split()[:35])
    every = texts + held + [part]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["n_shingles"], r["n_shared"]) for r in decontamination.contaminated(table(spark, every), bench).collect()}

    def grams(t, n):
        w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}, len(w)

    want = set()
    for j, item in enumerate(items):
        n = min(5, grams(item, 1)[1])
        own = grams(item, n)[0] if n else set()
        for i, t in enumerate(every):
            shared = len(own & grams(t, n)[0]) if own else 0
            if own and shared >= 0.8 * len(own) - 1e-9:
                want.add((i, j, len(own), shared))
    assert got == want
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(table(spark, texts), empty).count() == 0
    assert decontamination.clean(table(spark, texts), empty).count() == len(texts)


def kneser_ney(trusted, texts):
    """Interpolated modified Kneser-Ney over code units, by dictionaries."""
    order = quality.ORDER
    grams = lambda t: [tuple((["\0"] * (order - 1) + list(t))[i : i + order]) for i in range(len(t))]
    counts = {order: Counter(g for t in trusted for g in grams(t))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discounts, contexts = {}, {}
    for k, c in counts.items():
        n1, n2, n3, n4 = (float(sum(v == i for v in c.values())) for i in range(1, 5))
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        raw = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
        discounts[k] = [min(max(d, 0.05), i - 0.05) for i, d in enumerate(raw, 1)]
        contexts[k] = defaultdict(list)
        for g, n in c.items():
            contexts[k][g[:-1]].append(n)

    def p(g):
        k = len(g)
        if k == 1:
            total, d = sum(counts[1].values()), min(discounts[1][2], 1.0)
            return (max(counts[1][g] - d, 0) + d * len(counts[1]) / (len(counts[1]) + 1)) / max(total, 1)
        seen = contexts[k].get(g[:-1])
        if not seen:
            return p(g[1:])
        n = counts[k][g]
        d = [0, *discounts[k]]
        return (n - d[min(n, 3)] + sum(d[min(x, 3)] for x in seen) * p(g[1:])) / sum(seen)

    return [np.exp(-np.mean([np.log(max(p(g), 1e-30)) for g in grams(t)])) if t else None for t in texts]


def test_perplexity(spark):
    rng = random.Random(4)
    trusted = [prose(rng, 30) for _ in range(12)]
    every = trusted + [prose(rng, 20), "zzz qqq xxx kkk", "", None, "w1 w2 é中"]
    model = quality.Model(quality.counted(spark.createDataFrame([(t,) for t in trusted], "body string")))
    got = [r["perplexity"] or 0 for r in quality.perplexity(table(spark, every), model).orderBy("doc_id").collect()]
    assert got == pytest.approx([x or 0 for x in kneser_ney(trusted, every)], rel=1e-4)


def test_rejected_documents(spark, texts):
    rng = random.Random(4)
    good = [prose(rng, 60) for _ in range(100)]
    junk = ["".join(rng.choice("#%&*{}~^|<>") for _ in range(300)) for _ in range(5)]
    docs = table(spark, good + junk + ["", None])
    trusted = spark.createDataFrame([(i,) for i in range(60)], "doc_id long")
    out = quality.accept(docs, trusted)
    kept = {r["doc_id"] for r in out.collect()}
    assert out.columns == docs.columns and not kept & set(range(100, 105)) and {105, 106} <= kept and len(kept & set(range(100))) >= 97
    none = spark.createDataFrame([], "doc_id long")
    assert quality.accept(docs, none).count() == docs.count()
    assert quality.accept(table(spark, []), trusted).count() == 0


def test_toxicity(spark):
    large = "/root/testdata/sf0.1"
    scored = queries.op1_toxicity_ftrl(spark, large).join(spark.read.parquet(f"{large}/labels.parquet"), "doc_id")
    rows = scored.where("held_out").select("score", "toxic", "predicted").collect()
    a, b = [r["score"] for r in rows if r["toxic"]], [r["score"] for r in rows if not r["toxic"]]
    assert a and b and all(0 <= x <= 1 for x in a + b)
    assert np.mean([x > y for x in a for y in b]) > 0.95
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.9


def test_toxicity_of_odd_rows(spark):
    docs = table(spark, ["bad bad words", "good words", "", None] * 4)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(8)] + [(None, 1), (9, None), (1, 0)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(out) == 16 and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.train(docs, labels.limit(0)) == {}
    assert {r["score"] for r in toxicity.score(docs, {}).collect()} == {0.5}


def test_sql(spark, medium):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{medium}/{t}.parquet')")
    for name, sql in queries.ORACLE_SQL.items():
        df, want = queries.QUERIES[name](spark, medium), con.sql(sql)
        columns = sorted(df.columns)
        assert columns == sorted(want.columns)
        order = [want.columns.index(c) for c in columns]
        assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r[i] for i in order) for r in want.fetchall())


def test_pipeline(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, small)
        assert docs.columns == columns and 0 < docs.count() <= before, name
    bodies = {r["doc_id"]: r["text"] for r in docs.collect()}
    packed = corpus_pipeline.run(spark, small).collect()
    assert {r["doc_id"] for r in packed} == set(bodies)
    enc = Tokenizer.from_file(packing.default_vocabulary())
    ids = defaultdict(list)
    for r in sorted(packed, key=lambda r: (r["doc_id"], r["piece"])):
        ids[r["doc_id"]] += r["ids"]
    assert all(enc.decode(x[:-1], skip_special_tokens=False) == (bodies[i] or "") and x[-1] == 2 for i, x in ids.items())
