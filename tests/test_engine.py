"""Indexes end to end: ramps, harmonics, bounds, refresh, catalogue, streams."""

import math
import uuid
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.engine import Engine
from tidewright.streaming.refresh import refresh


@pytest.fixture()
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / uuid.uuid4().hex))


def ramp(spark, n, hide=0.0):
    t = F.col("id")
    return spark.range(n).select(t.alias("time"), F.when(F.rand(5) >= hide, t.cast("double")).alias("ts"), (2.0 * t).alias("other"))


def test_ramp_is_imputed_and_forecast(spark, engine):
    engine.register("ramp", ramp(spark, 3000))
    engine.create_pindex("ramp", "time", "ts", "i", k=2, t=2000, t0=100)
    inside = engine.predict("ramp", "ts", 100, 1500, "i", uq=False).collect()
    assert len(inside) == 1401
    assert max(abs(r["prediction"] - r["t"]) for r in inside) < 1e-3
    ahead = engine.predict("ramp", "ts", 2995, 3020, "i", uq=False).collect()
    assert max(abs(r["prediction"] - r["t"]) for r in ahead) < 1e-2
    after = engine.forecast_next("ramp", "ts", "i", 5).orderBy("t").collect()
    assert [r["t"] for r in after] == list(range(3000, 3005))
    assert max(abs(r["prediction"] - r["t"]) for r in after) < 1e-2


def test_point_equals_range(spark, engine):
    engine.register("ramp", ramp(spark, 2000, 0.2))
    engine.create_pindex("ramp", "time", ["ts", "other"], "i", k=2, t=1000, t0=100)
    rows = {r["t"]: r for r in engine.predict("ramp", "other", 0, 1999, "i").collect()}
    assert len(rows) == 2000
    for t in (0, 3, 260, 999, 1998):
        one = engine.predict("ramp", "other", t, None, "i").first()
        assert one["prediction"] == pytest.approx(rows[t]["prediction"])
        assert one["lb"] == pytest.approx(rows[t]["lb"]) and one["ub"] >= one["prediction"] >= one["lb"]


def test_timestamps_and_bounds(spark, engine):
    start = datetime(2012, 10, 1)
    n = 2000
    rng = np.random.default_rng(1)
    rows = [(start + timedelta(seconds=5 * i), float(10 * math.sin(2 * math.pi * i / 50) + rng.normal())) for i in range(n)]
    engine.register("waves", spark.createDataFrame(rows, "time timestamp_ntz, ts double"))
    engine.create_pindex("waves", "time", "ts", "w", k=2, k_var=1, t=1000, t0=100, agg_interval=5)
    out = engine.predict("waves", "ts", "2012-10-01 00:05:00", "2012-10-01 01:05:00", "w", c=95).collect()
    assert len(out) == 721
    truth = [10 * math.sin(2 * math.pi * r["t"] / 50) for r in out]
    assert np.sqrt(np.mean([(r["prediction"] - x) ** 2 for r, x in zip(out, truth, strict=True)])) < 0.6
    gaussian = np.mean([r["ub"] - r["lb"] for r in out])
    assert 2.5 < gaussian < 5.5  # about 2 * 1.96 standard deviations of the noise
    wide = engine.predict("waves", "ts", "2012-10-01 00:05:00", "2012-10-01 01:05:00", "w", uq_method="Chebyshev", c=95).collect()
    assert np.mean([r["ub"] - r["lb"] for r in wide]) > 2 * gaussian
    shown = engine.list_pindices().first()
    assert shown["agg_interval"] == "5.0 seconds" and shown["initial_timestamp"].startswith("2012-10-01 00:00:00")


def test_arguments_are_checked(spark, engine):
    engine.register("ramp", ramp(spark, 500))
    engine.create_pindex("ramp", "time", "ts", "i", k=1, t=300, t0=100)
    for bad in (dict(c=100), dict(c=-1), dict(uq_method="other")):
        with pytest.raises(ValueError):
            engine.predict("ramp", "ts", 1, 5, "i", **bad)
    with pytest.raises(ValueError):
        engine.predict("ramp", "other", 1, 5, "i")
    with pytest.raises(ValueError):
        engine.predict("ramp", "ts", 5, 1, "i")
    with pytest.raises(ValueError):
        engine.create_pindex("ramp", "time", "absent", "j")
    with pytest.raises(ValueError):
        engine.delete_pindex("")


def test_too_few_rows_give_the_mean(spark, engine):
    engine.register("ramp", ramp(spark, 11))
    engine.create_pindex("ramp", "time", "ts", "i", t0=100)
    assert {r["prediction"] for r in engine.predict("ramp", "ts", 3, 20, "i").collect()} == {5.0}
    assert engine.pindices_stat().first()["number_of_trained_models"] == 0


def test_refresh_equals_rebuild(spark, engine):
    waves = spark.range(4000).select(F.col("id").alias("time"), (F.sin(F.col("id") / 9) + F.col("id") / 500).alias("ts"))
    engine.register("w", waves.where("time < 2500"))
    engine.create_pindex("w", "time", "ts", "i", k=3, t=1000, t0=100)
    assert engine.update_pindex("i") is False
    engine.register("w", waves)
    assert engine.update_pindex("i") is True
    engine.create_pindex("w", "time", "ts", "j", k=3, t=1000, t0=100)
    a = {r["t"]: r["prediction"] for r in engine.predict("w", "ts", 0, 4010, "i", uq=False).collect()}
    b = {r["t"]: r["prediction"] for r in engine.predict("w", "ts", 0, 4010, "j", uq=False).collect()}
    assert a.keys() == b.keys() and max(abs(a[t] - b[t]) for t in a) < 1e-6
    assert {r["index_name"] for r in engine.list_pindices().collect()} == {"i", "j"}
    engine.delete_pindex("i")
    assert [r["index_name"] for r in engine.list_pindices().collect()] == ["j"]
    with pytest.raises(ValueError):
        engine.predict("w", "ts", 0, 1, "i")


def test_stream_refreshes_the_index(spark, engine, tmp_path):
    waves = spark.range(3000).select(F.col("id").alias("time"), F.sin(F.col("id") / 9).alias("ts"))
    folder, source = str(tmp_path / "table"), str(tmp_path / "source")
    waves.where("time < 1500").write.parquet(f"{folder}/batch=-1")
    engine.register("w", spark.read.parquet(folder).drop("batch"))
    engine.create_pindex("w", "time", "ts", "i", k=2, t=1000, t0=100)
    waves.where("time >= 1500").write.parquet(source)
    stream = spark.readStream.schema("time long, ts double").parquet(source)
    refresh(stream, engine, "w", folder, str(tmp_path / "checkpoint"), strict=True).trigger(availableNow=True).start().awaitTermination(120)
    assert engine.store.meta("i")["steps"] == 3000
    assert engine.predict("w", "ts", 2990, 2999, "i").count() == 10
