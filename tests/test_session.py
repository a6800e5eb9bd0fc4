"""Tables bucketed for the time of a block; limits of batches, memory of workers."""

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewright import session
from tidewright.session import bucketed, shared_folder


def _left(spark):
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    return [f.getPath().getName() for f in files if f.getPath().getName().startswith("rows_")] + [t.name for t in spark.catalog.listTables() if t.name.startswith("rows_")]


def test_bucketed_rows_are_not_shuffled_again(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("key"), "id")
    before = _left(spark)
    with bucketed(rows, "key") as table:
        grouped = table.groupBy("key").applyInPandas(lambda part: part.assign(id=part["id"].sum()).head(1), "key long, id long")
        assert "Exchange" not in grouped._jdf.queryExecution().executedPlan().toString()
        assert {r["key"]: r["id"] for r in grouped.collect()} == {k: sum(range(k, 1000, 7)) for k in range(7)}
    assert _left(spark) == before


def test_bucketed_table_goes_after_an_error_and_may_be_empty(spark):
    before = _left(spark)
    with pytest.raises(ZeroDivisionError), bucketed(spark.range(0).withColumnRenamed("id", "key"), "key") as table:
        assert table.count() == 0
        raise ZeroDivisionError
    assert _left(spark) == before


def test_text_batches_bound_the_bytes_of_a_batch(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    usual = spark.conf.get(key)
    monkeypatch.setattr(session, "BATCH_BYTES", 1_000_000)
    try:
        wide = spark.range(0, 1500, 1, 1).selectExpr("repeat('x', 10000) as text")
        session.text_batches(wide)
        sizes = [r["n"] for r in wide.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()]
        assert sum(sizes) >= 15_000_000 and max(sizes) < 1_100_000
    finally:
        spark.conf.set(key, usual)


def test_released_gives_memory_back():
    held = lambda: int(Path("/proc/self/statm").read_text().split()[1]) * 4096

    @session.released
    def task(batches):
        for n in batches:
            # Blocks below the size that is mapped by itself; the last one keeps the heap from shrinking at its end.
            blocks = [np.ones(8000) for _ in range(n)]
            pins.append(np.ones(8000))
            yield len(blocks)

    pins: list = []
    before = held()
    assert list(task([2000])) == [2000]
    assert held() - before < 60_000_000
