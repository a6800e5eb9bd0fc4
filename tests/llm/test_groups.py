"""Near duplicates in large groups: exact components, and no join that grows with the square of a group."""

import random

import pytest
from pyspark.sql import functions as F
from test_operators import WORDS, near_groups, prose, table

from tidewright.llm import near_duplicates, shingles


def edited(rng, words, most, fresh=10_000):
    words = list(words)
    for _ in range(rng.randrange(most)):
        words[rng.randrange(len(words))] = f"e{rng.randrange(fresh)}"
    return words


def group(rng, n, length=120, most=12):
    base = prose(rng, length).split()
    return [" ".join(edited(rng, base, most)) for _ in range(n)]


@pytest.mark.parametrize("levels", [3, 1, 0])
def test_groups_within_groups(spark, monkeypatch, levels):
    """Versions of a version, shortened copies, and texts that only share boilerplate."""
    monkeypatch.setattr(near_duplicates, "SMALL", 4)
    monkeypatch.setattr(near_duplicates, "LEADERS", 2)
    monkeypatch.setattr(near_duplicates, "BLOCK", 16)
    monkeypatch.setattr(near_duplicates, "CHUNK", 16)
    monkeypatch.setattr(near_duplicates, "LEVELS", levels)
    rng = random.Random(11)
    base = prose(rng, 100).split()
    other = [rng.choice(WORDS) if k % 3 == 0 else w for k, w in enumerate(base)]
    texts = [" ".join(edited(rng, w, 14, 60)) for w in (base, other) for _ in range(90)]
    for _ in range(60):
        words = edited(rng, base, 6)
        at = rng.randrange(60)
        texts.append(" ".join(words[:at] + words[at + rng.randrange(30) :]))
    texts += [" ".join(base[:70]) + " " + prose(rng, 30) for _ in range(40)]
    rng.shuffle(texts)
    got = near_duplicates.near_duplicates(table(spark, texts), 4, 80).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == near_groups(texts, 4, 80)


def joined_rows(spark, run):
    """The largest number of rows that a join of ``run`` made."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs, largest = store.executionsList(), 0
    for k in range(before, runs.size()):
        number = runs.apply(k).executionId()
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for j in range(nodes.size()):
            node = nodes.apply(j)
            if "Join" in node.name():
                for m in range(node.metrics().size()):
                    metric = node.metrics().apply(m)
                    if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                        largest = max(largest, int(values.apply(metric.accumulatorId()).replace(",", "")))
    return largest


def test_joins_grow_with_the_rows(spark):
    rng = random.Random(12)
    rows = []
    for n in (1000, 2000):
        docs = table(spark, group(rng, n) + group(rng, n))
        rows.append(joined_rows(spark, lambda: near_duplicates.near_duplicates(docs).agg(F.count("kept")).collect()))  # noqa: B023
    assert 0 < rows[1] < 2.6 * rows[0], rows


def test_workers_drop_the_hashes_of_words(spark):
    docs = table(spark, [prose(random.Random(k), 50) for k in range(40)]).repartition(8)
    assert near_duplicates.sketches(docs).where("n_shingles > 0").count() == 40

    def held(batches):
        for batch in batches:
            yield batch.assign(id=len(shingles._HASHES))

    assert {r["id"] for r in spark.range(0, 16, 1, 16).mapInPandas(held, "id long").collect()} == {0}
