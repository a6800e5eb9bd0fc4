"""Queries over the driver's tables, with SQL that gives the same rows.

Measured values are rounded to six decimals on both sides.
"""

from __future__ import annotations

from math import pi

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions import generators, layout, metrics, series
from ..operators import als, bound, control, factor, fit, predict
from ..session import cut, read, shared_folder

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    # Adding 0 turns a negative zero into zero.
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + 0.0


# -- scans and regular series

EVENTS_AXIS = "SELECT epoch_us(min(date_trunc('second', ts))) AS s0 FROM events"


def steps_sql(seconds: int, aggregate: str = "avg") -> str:
    """The regular series of the events' values: t, value."""
    return f"""
a AS ({EVENTS_AXIS}),
b AS (SELECT (epoch_us(ts) - s0) // {seconds * 1_000_000} AS t, {aggregate}(value) AS value FROM events, a GROUP BY 1),
s AS (SELECT r.t, b.value FROM (SELECT unnest(range(0, (SELECT max(t) + 1 FROM b))) AS t) r LEFT JOIN b USING (t))"""


def events_series(spark: SparkSession, sf_dir: str, seconds: int, aggregate: str = "average") -> DataFrame:
    df = read(spark, sf_dir, "events")
    return series.regularise(df, "ts", ["value"], series.axis_of(df, "ts", seconds), aggregate)


@query(f"WITH {steps_sql(3600)} SELECT t, round(value, 6) + 0.0 AS value FROM s")
def bucket_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_series(spark, sf_dir, 3600).select("t", r6("value").alias("value"))


@query(f"WITH {steps_sql(3600, 'min')} SELECT t, round(value, 6) + 0.0 AS value FROM s")
def bucket_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_series(spark, sf_dir, 3600, "min").select("t", r6("value").alias("value"))


@query(f"WITH {steps_sql(3600, 'max')} SELECT t, round(value, 6) + 0.0 AS value FROM s")
def bucket_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_series(spark, sf_dir, 3600, "max").select("t", r6("value").alias("value"))


@query(f"WITH {steps_sql(300)} SELECT t, value IS NULL AS missing, round(value, 6) + 0.0 AS value FROM s")
def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-minute steps, many of them empty."""
    return events_series(spark, sf_dir, 300).select("t", F.col("value").isNull().alias("missing"), r6("value").alias("value"))


@query("SELECT event_id - (SELECT min(event_id) FROM events) AS t, round(avg(value), 6) + 0.0 AS value FROM events GROUP BY 1")
def integer_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events")
    return series.regularise(df, "event_id", ["value"], series.axis_of(df, "event_id")).select("t", r6("value").alias("value"))


@query(
    "SELECT event_id, ts, round(value, 6) + 0.0 AS value FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-05 12:00:00'"
)
def range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events").where("ts between timestamp_ntz'2024-01-05 00:00:00' and timestamp_ntz'2024-01-05 12:00:00'")
    return df.select("event_id", "ts", r6("value").alias("value"))


@query("SELECT min(ts) AS first, max(ts) AS last FROM events")
def time_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.bounds(read(spark, sf_dir, "events"), "ts")


@query(
    "SELECT round(median(d), 6) + 0.0 AS step FROM (SELECT (epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts)) / 1e6 AS d FROM (SELECT ts FROM events WHERE ts IS NOT NULL ORDER BY ts LIMIT 100))"
)
def interval_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.interval(read(spark, sf_dir, "events"), "ts").select(r6("step").alias("step"))


@query(
    "SELECT event_type, (epoch_us(ts) - s0) // 3600000000 AS t, count(*) AS n, round(avg(value), 6) + 0.0 AS mean, round(min(value), 6) + 0.0 AS low, round(max(value), 6) + 0.0 AS high "
    f"FROM events, ({EVENTS_AXIS}) GROUP BY 1, 2"
)
def bucket_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events")
    t = series.axis_of(df, "ts", 3600).index(F.col("ts"))
    return df.groupBy("event_type", t.alias("t")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean"), r6(F.min("value")).alias("low"), r6(F.max("value")).alias("high"))


# -- missing values

FILL_SQL = "last_value(value IGNORE NULLS) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING)"
BACK_SQL = "first_value(value IGNORE NULLS) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def fill_sql(expression: str) -> str:
    return f"WITH {steps_sql(300)} SELECT t, round({expression}, 6) + 0.0 AS filled FROM s"


@query(fill_sql(FILL_SQL))
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.fill_series(events_series(spark, sf_dir, 300), behind=False, slab=288).select("t", r6("filled").alias("filled"))


@query(fill_sql(BACK_SQL))
def backward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.fill_series(events_series(spark, sf_dir, 300), ahead=False, slab=288).select("t", r6("filled").alias("filled"))


@query(fill_sql(f"coalesce({FILL_SQL}, {BACK_SQL})"))
def fill_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.fill_series(events_series(spark, sf_dir, 300), slab=288).select("t", r6("filled").alias("filled"))


@query(f"WITH {steps_sql(300)} SELECT round(count(value) / count(*), 6) + 0.0 AS p FROM s")
def observed_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events_series(spark, sf_dir, 300)
    return df.agg(r6(series.observed(df)).alias("p"))


@query(f"WITH {steps_sql(300)} SELECT t, round(coalesce(value, 0) / p, 6) + 0.0 AS x FROM s, (SELECT count(value) / count(*) AS p FROM s)")
def zero_fill_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events_series(spark, sf_dir, 300)
    p = df.agg(series.observed(df).alias("p")).first()["p"]
    return df.select("t", r6(series.zero_fill(F.col("value"), F.lit(p))).alias("x"))


@query(
    f"WITH {steps_sql(3600)}, g AS (SELECT *, t // 120 AS block FROM s) "
    "SELECT t, round((value - avg(value) OVER (PARTITION BY block)) / CASE WHEN stddev_pop(value) OVER (PARTITION BY block) > 0 THEN stddev_pop(value) OVER (PARTITION BY block) ELSE 1 END, 6) + 0.0 AS z FROM g"
)
def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events_series(spark, sf_dir, 3600).withColumn("block", F.floor(F.col("t") / 120))
    return df.join(series.moments(df, ["block"]), "block").select("t", r6((F.col("value") - F.col("mean")) / F.col("std")).alias("z"))


# -- sub-models and pages. T = 240 entries at L = 2: half = 120 steps.

ROWS, ENTRIES = 2, 240


def shapes_of(n: int, count: int = 1):
    return layout.shapes(n, layout.dimensions(ENTRIES, 10.0, count, ROWS), count, True)


#: § stands for a suffix of all names, so that a second model (of the variance) can follow the first. s§ has t and value.
MODELS = """
n§ AS (SELECT max(t) + 1 AS n FROM s§),
last§ AS (SELECT greatest(cast(floor((n - 1) / 120.0 - 1) AS BIGINT), 0) AS last FROM n§),
m§ AS (SELECT DISTINCT t, value, unnest([t // 120, t // 120 - 1, last]) AS model, n, last FROM s§, last§, n§),
c§ AS (SELECT t, value, model, t - model * 120 AS x, CASE WHEN model = last THEN n - model * 120 ELSE 240 END AS size FROM m§
       WHERE model BETWEEN 0 AND last AND t >= model * 120 AND t < model * 120 + CASE WHEN model = last THEN n - model * 120 ELSE 240 END GROUP BY ALL),
page§ AS (SELECT t, value, model, x % 2 AS row, x // 2 AS segment FROM c§ WHERE x // 2 < size // 2)"""
MODELS_SQL = MODELS.replace("§", "")


@query(f"WITH {steps_sql(3600)}, {MODELS_SQL} SELECT t, model FROM c")
def submodel_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events_series(spark, sf_dir, 3600)
    n = df.count()
    found = shapes_of(n)
    last = len(found) - 1
    return df.select("t", F.explode(layout.covering(F.col("t"), ENTRIES // 2, last).cast("array<long>")).alias("model"))


@query(f"WITH {steps_sql(3600)}, {MODELS_SQL} SELECT t, model, row, segment, round(value, 6) + 0.0 AS value FROM page")
def page_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events_series(spark, sf_dir, 3600)
    found = shapes_of(df.count())
    placed = fit.dealt(series.melt(df, ["value"]), layout.shape_table(spark, found), ENTRIES // 2, len(found))
    return placed.select("t", F.col("model").cast("long").alias("model"), "row", "segment", r6("value").alias("value"))


#: Closed form of the fit at L = 2, k = 1: the leading eigenvector of the 2 x 2 Gram matrix gives the denoised first row d0, and the weight is <d0, last> / <d0, d0>.
FIT = f"""
{MODELS},
stat§ AS (SELECT model, avg(value) AS mean, CASE WHEN stddev_pop(value) > 0 THEN stddev_pop(value) ELSE 1 END AS std FROM page§ GROUP BY model),
z§ AS (SELECT model, t, row, segment, coalesce(last_value((value - mean) / std IGNORE NULLS) OVER (PARTITION BY model ORDER BY t ROWS UNBOUNDED PRECEDING),
        first_value((value - mean) / std IGNORE NULLS) OVER (PARTITION BY model ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS x FROM page§ JOIN stat§ USING (model)),
col§ AS (SELECT model, segment, max(CASE WHEN row = 0 THEN x END) AS a, max(CASE WHEN row = 1 THEN x END) AS b FROM z§ GROUP BY model, segment),
gram§ AS (SELECT model, sum(a * a) AS p, sum(a * b) AS q, sum(b * b) AS r FROM col§ GROUP BY model),
eig§ AS (SELECT *, (p + r) / 2 + sqrt(((p - r) / 2) * ((p - r) / 2) + q * q) AS lam FROM gram§),
vec§ AS (SELECT model, CASE WHEN q = 0 THEN CASE WHEN p >= r THEN 1.0 ELSE 0.0 END ELSE q / sqrt(q * q + (lam - p) * (lam - p)) END AS u0,
               CASE WHEN q = 0 THEN CASE WHEN p >= r THEN 0.0 ELSE 1.0 END ELSE (lam - p) / sqrt(q * q + (lam - p) * (lam - p)) END AS u1 FROM eig§),
low§ AS (SELECT model, segment, a, b, u0 * (u0 * a + u1 * b) AS d0, u1 * (u0 * a + u1 * b) AS d1 FROM col§ JOIN vec§ USING (model)),
w§ AS (SELECT model, sum(d0 * b) / sum(d0 * d0) AS w FROM low§ GROUP BY model)"""
FIT_SQL = FIT.replace("§", "")

IMPUTE = """
cell§ AS (SELECT model, model * 120 + segment * 2 AS t, d0 * std + mean AS e FROM low§ JOIN stat§ USING (model) UNION ALL SELECT model, model * 120 + segment * 2 + 1, d1 * std + mean FROM low§ JOIN stat§ USING (model)),
served§ AS (SELECT t, avg(e) AS estimate FROM (SELECT t, model, e, last, greatest(t // 120 - 1, 0) AS m FROM cell§, last§) WHERE model = least(m, last) OR (m < last - 1 AND model = m + 1) GROUP BY t)"""
IMPUTE_SQL = IMPUTE.replace("§", "")

COEFFICIENT_SQL = """
coeff AS (SELECT avg(w) AS w, avg((1 - w) * mean) AS bias FROM w JOIN stat USING (model))"""


def fitted_l2(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, fit.Fitted]:
    long = cut(series.melt(events_series(spark, sf_dir, 3600), ["value"]))
    n = long.agg(F.max("t")).first()[0] + 1
    return long, fit.fit(long, n, 1, fit.Options(entries=ENTRIES, rank=1, rows=ROWS))


@query(f"WITH {steps_sql(3600)}, {FIT_SQL} SELECT model, round(w, 6) + 0.0 AS w, round(mean, 6) + 0.0 AS mean, round(std, 6) + 0.0 AS std FROM w JOIN stat USING (model)")
def fit_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, f = fitted_l2(spark, sf_dir)
    info = f.part("model").select("model", F.element_at("vec", 5).alias("mean"), F.element_at("vec", 6).alias("std"))
    return f.part("weight").join(info, "model").select(F.col("model").cast("long").alias("model"), r6("val").alias("w"), r6("mean").alias("mean"), r6("std").alias("std"))


@query(f"WITH {steps_sql(3600)}, {FIT_SQL}, {IMPUTE_SQL} SELECT t, round(estimate, 6) + 0.0 AS estimate FROM served")
def impute_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, f = fitted_l2(spark, sf_dir)
    steps = spark.range(0, f.boundary + 1).withColumnRenamed("id", "t")
    return predict.impute(f, steps).select("t", r6("estimate").alias("estimate"))


@query(f"WITH {steps_sql(3600)}, {FIT_SQL}, {IMPUTE_SQL} SELECT t, round(avg(e), 6) + 0.0 AS estimate FROM cell GROUP BY t")
def denoise_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, f = fitted_l2(spark, sf_dir)
    return predict.denoise(f).select("t", r6("estimate").alias("estimate"))


@query(
    f"WITH RECURSIVE {steps_sql(3600)}, {FIT_SQL}, {COEFFICIENT_SQL}, "
    "f(i, t, e) AS (SELECT 0, t, coalesce(value, (SELECT value FROM s WHERE value IS NOT NULL ORDER BY t DESC LIMIT 1)) FROM s WHERE t = (SELECT n - 1 FROM n) "
    "UNION ALL SELECT i + 1, t + 1, bias + w * e FROM f, coeff WHERE i < 24) SELECT t, round(e, 6) + 0.0 AS estimate FROM f WHERE i > 0"
)
def forecast_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    long, f = fitted_l2(spark, sf_dir)
    made = predict.forecast(f, fit.coefficients(f), long.where(F.col("t") == f.steps - 1), f.steps, f.steps + 23)
    return made.select("t", r6("estimate").alias("estimate"))


@query(f"WITH {steps_sql(3600)}, {FIT_SQL}, {COEFFICIENT_SQL} SELECT round(w, 6) + 0.0 AS w, round(bias, 6) + 0.0 AS bias FROM coeff")
def coefficient_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fit.coefficients(fitted_l2(spark, sf_dir)[1])
    return c.agg(r6(F.max(F.when(F.col("kind") == "weight", F.col("average")))).alias("w"), r6(F.max(F.when(F.col("kind") == "bias", F.col("average")))).alias("bias"))


@query(
    f"WITH {steps_sql(3600)}, {FIT_SQL}, j AS (SELECT model, w, (1 - w) * mean AS bias, last FROM w JOIN stat USING (model), last) "
    "SELECT kind, round(avg(v) FILTER (WHERE model > last - 1), 6) + 0.0 AS last1, round(avg(v) FILTER (WHERE model > last - 2), 6) + 0.0 AS last2, round(avg(v) FILTER (WHERE model > last - 10), 6) + 0.0 AS last10 "
    "FROM (SELECT 'weight' AS kind, model, w AS v, last FROM j UNION ALL SELECT 'bias', model, bias, last FROM j) GROUP BY kind"
)
def coefficient_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fit.coefficients(fitted_l2(spark, sf_dir)[1])
    return c.select("kind", *(r6(x).alias(x) for x in ("last1", "last2", "last10")))


BOUND_SQL = f"""
around AS (SELECT s.t, (s.value - d.e) * (s.value - d.e) AS v FROM s LEFT JOIN (SELECT t, avg(e) AS e FROM cell GROUP BY t) d USING (t)),
s2 AS (SELECT t, v AS value FROM around),
{FIT.replace("§", "2")}, {IMPUTE.replace("§", "2")}"""


def bounds_sql(alpha: float) -> str:
    return (
        f"WITH {steps_sql(3600)}, {FIT_SQL}, {IMPUTE_SQL}, {BOUND_SQL} SELECT t, round(a.estimate, 6) + 0.0 AS prediction, "
        f"round(a.estimate - {alpha!r} * sqrt(greatest(b.estimate, 0)), 6) + 0.0 AS lb, round(a.estimate + {alpha!r} * sqrt(greatest(b.estimate, 0)), 6) + 0.0 AS ub "
        "FROM served a JOIN served2 b USING (t)"
    )


def _variance_l2(spark: SparkSession, sf_dir: str) -> tuple[fit.Fitted, fit.Fitted]:
    long, f = fitted_l2(spark, sf_dir)
    around = cut(fit.residuals(long, predict.denoise(f)))
    return f, fit.fit(around, f.steps, 1, fit.Options(entries=ENTRIES, rank=1, rows=ROWS))


@query(f"WITH {steps_sql(3600)}, {FIT_SQL}, {IMPUTE_SQL}, {BOUND_SQL} SELECT t, round(v, 6) + 0.0 AS value FROM around")
def squared_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    long, f = fitted_l2(spark, sf_dir)
    return fit.residuals(long, predict.denoise(f)).select("t", r6("value").alias("value"))


def _bounds_l2(spark: SparkSession, sf_dir: str, method: str, c: float) -> DataFrame:
    mean, variance = _variance_l2(spark, sf_dir)
    steps = spark.range(0, mean.boundary + 1).withColumnRenamed("id", "t")
    out = predict.bounded(predict.impute(mean, steps), predict.impute(variance, steps), c, method)
    return out.select("t", *(r6(x).alias(x) for x in ("prediction", "lb", "ub")))


@query(bounds_sql(predict.width(95)))
def bounds_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bounds_l2(spark, sf_dir, "Gaussian", 95)


@query(bounds_sql(predict.width(90, "Chebyshev")))
def bounds_chebyshev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bounds_l2(spark, sf_dir, "Chebyshev", 90)


# -- the engine over stored indexes


def engine_of(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine in a fresh folder, with an index of hourly event values (L = 2, k = 1)."""
    import uuid

    engine = Engine(spark, f"{shared_folder(spark)}/indexes-{uuid.uuid4().hex}")
    engine.register("events", read(spark, sf_dir, "events"))
    engine.create_pindex("events", "ts", ["value"], "hourly", k=1, k_var=1, t=ENTRIES, t0=100, l=ROWS, agg_interval=3600)
    return engine


@query(
    f"WITH {steps_sql(3600)}, a2 AS ({EVENTS_AXIS}) SELECT 'hourly' AS index_name, 'value' AS value_columns, 'events' AS relation, 'ts' AS time_column, make_timestamp(s0) AS initial_timestamp, "
    "make_timestamp(s0 + (SELECT max(t) FROM s) * 3600000000) AS last_timestamp, '3600.0 seconds' AS agg_interval, true AS uncertainty_quantification FROM a2"
)
def list_pindices(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = engine_of(spark, sf_dir).list_pindices()
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("initial_timestamp", "last_timestamp")}
    return out.withColumns(times | {"value_columns": F.array_join("value_columns", ",")})


@query(
    f"WITH {steps_sql(3600)}, {FIT_SQL}, "
    "r AS (SELECT z.model, sum(CASE WHEN value IS NULL THEN NULL ELSE power((value - mean) / std - CASE WHEN z.row = 0 THEN d0 ELSE d1 END, 2) END) AS sse, "
    "var_pop((value - mean) / std) * count(value) AS sst FROM z JOIN page USING (model, t) JOIN stat USING (model) JOIN low ON low.model = z.model AND low.segment = z.segment GROUP BY z.model) "
    "SELECT 'hourly' AS index_name, 'value' AS column_name, (SELECT count(value) FROM s) AS number_of_observations, count(*) AS number_of_trained_models, round(avg(1 - sse / sst), 5) + 0.0 AS imputation_score FROM r"
)
def pindices_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = engine_of(spark, sf_dir).pindices_stat()
    return out.select("index_name", "column_name", "number_of_observations", "number_of_trained_models", (F.round("imputation_score", 5) + 0.0).alias("imputation_score"))


@query(f"WITH {steps_sql(3600)}, {FIT_SQL}, {IMPUTE_SQL} SELECT t, round(estimate, 6) + 0.0 AS prediction FROM served WHERE t BETWEEN 24 AND 47")
def engine_range_imputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_of(spark, sf_dir)
    meta = engine.store.meta("hourly")
    axis = series.Axis(meta["start"], meta["step"], True)
    first = spark.range(1).select(axis.time(F.lit(24)).alias("a"), axis.time(F.lit(47)).alias("b")).first()
    out = engine.predict("events", "value", str(first["a"]), str(first["b"]), "hourly", uq=False)
    return out.select("t", r6("prediction").alias("prediction"))


# -- symbols, generators, measures, distances

LATEST = "l AS (SELECT ts AS t, event_id, value FROM events ORDER BY ts DESC LIMIT 1000), d AS (SELECT t, lead(value) OVER (ORDER BY t) - value AS diff FROM l)"


def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound.latest(read(spark, sf_dir, "events"), "ts", "value", 1000)


@query("SELECT ts AS t, round(value, 6) + 0.0 AS value FROM events ORDER BY ts DESC LIMIT 1000")
def latest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_events(spark, sf_dir).select("t", r6("value").alias("value"))


@query(f"WITH {LATEST} SELECT t, round(diff, 6) + 0.0 AS diff FROM d WHERE diff IS NOT NULL")
def first_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound.differences(latest_events(spark, sf_dir)).select("t", r6("diff").alias("diff"))


@query(f"WITH {LATEST} SELECT t, CASE WHEN diff = 0 THEN 0 WHEN diff > 0 THEN 1 ELSE 2 END AS symbol FROM d WHERE diff IS NOT NULL AND t > (SELECT min(t) FROM d)")
def change_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound.changes(latest_events(spark, sf_dir))


@query(
    f"WITH {LATEST}, b AS (SELECT t, diff, min(diff) OVER () AS lo, max(diff) OVER () AS hi FROM d WHERE diff IS NOT NULL) "
    "SELECT t, cast(least(greatest(ceil((diff - lo) / (hi - lo) * 3) - 1, 0), 2) AS INTEGER) AS symbol FROM b"
)
def quantised_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound.quantised(latest_events(spark, sf_dir), 3)


@query()
def lower_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked against a brute-force count of the codes in the tests."""
    return bound.lower_bound(read(spark, sf_dir, "events"), "ts", "value")


@query(
    f"SELECT i AS t, round(-2.0 * sin(i * {2 * pi * 560 / 11000!r}) + 3.0 * sin(i * {2 * pi * 30 / 11000!r}) + -2.5 * cos(i * {2 * pi * 16 / 11000!r}), 6) + 0.0 AS value FROM (SELECT unnest(range(11000)) AS i)"
)
def harmonics(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = generators.harmonics(F.col("t"), 11000, [(-2.0, 560), (3.0, 30)], [(-2.5, 16)])
    return generators.steps(spark, 11000).select("t", r6(made).alias("value"))


@query(
    "SELECT i AS t, round(pow(i, 0.35) - 2.5, 6) + 0.0 AS power, round(CASE WHEN i > 0 THEN 0.5 * ln(i) ELSE 0 END + 1.0, 6) + 0.0 AS log, round(3.0 * exp(-i / 700.0), 6) + 0.0 AS decay FROM (SELECT unnest(range(11000)) AS i)"
)
def trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    return generators.steps(spark, 11000).select(
        "t", r6(generators.power_trend(t, 0.35, 1.0, -2.5)).alias("power"), r6(generators.log_trend(t, 0.5, 1.0)).alias("log"), r6(generators.negative_exponential_trend(t, 700.0, 3.0)).alias("decay")
    )


@query()
def masked_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded masks; the tests check their share and their runs."""
    df = generators.steps(spark, 11000).withColumn("value", generators.mask(F.col("t").cast("double"), 0.7, 3))
    return generators.mask_runs(df, 0.01, 20, 5)


@query(
    "WITH p AS (SELECT l_quantity AS q, l_extendedprice AS x, 1500.0 * l_quantity AS g FROM lineitem) SELECT "
    "round(avg((x - g) * (x - g)) / 1e6, 4) + 0.0 AS mse_m, round(sqrt(avg((x - g) * (x - g))), 4) + 0.0 AS rmse, round(sum(abs(x - g)) / sum(abs(x)), 6) + 0.0 AS wape, "
    "round(1 - avg((x - g) * (x - g)) / var_pop(x), 6) + 0.0 AS r2, round(1 - sum((x - g) * (x - g)) / sum((x - 30000) * (x - 30000)), 6) + 0.0 AS r2_var FROM p"
)
def error_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").cast("double").alias("x"), (F.col("l_quantity") * 1500.0).cast("double").alias("g"))
    x, g = F.col("x"), F.col("g")
    return df.agg(
        (F.round(metrics.mse(x, g) / 1e6, 4) + 0.0).alias("mse_m"), (F.round(metrics.rmse(x, g), 4) + 0.0).alias("rmse"), r6(metrics.wape(x, g)).alias("wape"),
        r6(metrics.r2(x, g)).alias("r2"), r6(metrics.r2_var(x, g, F.lit(30000.0))).alias("r2_var"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "label").where("x is not null")


@query(
    "WITH q AS (SELECT vec_id, embedding, label FROM embeddings WHERE embedding IS NOT NULL), o AS (SELECT label, min_by(embedding, vec_id) AS e FROM q GROUP BY label), "
    "f AS (SELECT vec_id, unnest(embedding) AS a, unnest(e) AS b FROM q JOIN o USING (label)), g AS (SELECT vec_id, cast(a AS DOUBLE) AS a, cast(b AS DOUBLE) AS b FROM f) "
    "SELECT vec_id AS id, round(sum(abs(a - b)), 6) + 0.0 AS l1, round(sqrt(sum((a - b) * (a - b))), 6) + 0.0 AS l2, round(1 - sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))), 6) + 0.0 AS cosine, "
    "round(1 - abs(sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b)))), 6) + 0.0 AS abs_cosine FROM g GROUP BY vec_id"
)
def vector_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of every vector to the first one of its label."""
    v = vectors(spark, sf_dir)
    first = v.groupBy("label").agg(F.min_by("x", "id").alias("y"))
    both = v.join(first, "label")
    return both.select("id", *(r6(factor.distance(F.col("x"), F.col("y"), k)).alias(k) for k in ("l1", "l2", "cosine", "abs_cosine")))


@query(
    "WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL), o AS (SELECT vec_id AS centre, embedding AS e FROM q ORDER BY vec_id LIMIT 8), "
    "f AS (SELECT vec_id, centre, unnest(embedding) AS a, unnest(e) AS b FROM q, o), g AS (SELECT vec_id, centre, sqrt(sum((cast(a AS DOUBLE) - b) * (cast(a AS DOUBLE) - b))) AS d FROM f GROUP BY 1, 2) "
    "SELECT vec_id AS id, cast(arg_min(centre, (d, centre)) AS INTEGER) AS centre, round(min(d), 6) + 0.0 AS distance FROM g GROUP BY vec_id"
)
def vector_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of eight codebook vectors."""
    v = vectors(spark, sf_dir)
    codebook = [(r["id"], r["x"]) for r in v.orderBy("id").limit(8).collect()]
    return factor.assign(v, codebook).select("id", F.col("centre").cast("int").alias("centre"), r6("distance").alias("distance"))


@query()
def principal_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factor.pca(vectors(spark, sf_dir), 3).select("id", F.transform("h", lambda x: r6(x)).alias("h"))


@query()
def nonnegative_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).withColumn("x", F.transform("x", lambda x: F.abs(x)))
    return factor.nmf(v, 4)[1].select("id", "h")


@query()
def semi_nonnegative_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factor.semi_nmf(vectors(spark, sf_dir), 4)[1].select("id", "h")


@query()
def kmeans_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factor.kmeans(vectors(spark, sf_dir), 5).select("id", "cluster")


@query()
def fuzzy_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factor.cmeans(vectors(spark, sf_dir), 4)[1].select("id", "h")


VECTORS = "v AS (SELECT vec_id AS id, cast(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL)"


def farthest_sql(k: int) -> str:
    """Picks one by one: each is the row farthest from all picks before it (the first: from the mean)."""
    steps = [
        f"WITH {VECTORS}",
        "m AS (SELECT list(a ORDER BY i) AS x FROM (SELECT i, avg(a) AS a FROM (SELECT unnest(x) AS a, unnest(range(len(x))) AS i FROM v) GROUP BY i))",
        "d0 AS MATERIALIZED (SELECT id, v.x, list_distance(v.x, m.x) AS d FROM v, m)",
    ]
    for i in range(k):
        steps.append(f"p{i} AS MATERIALIZED (SELECT id, x FROM d{i} ORDER BY d DESC, id LIMIT 1)")
        near = f"list_distance(d{i}.x, p{i}.x)"
        steps.append(f"d{i + 1} AS MATERIALIZED (SELECT d{i}.id, d{i}.x, {f'least(d, {near})' if i else near} AS d FROM d{i}, p{i})")
    return ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT cast({i} AS INTEGER) AS pick, id FROM p{i}" for i in range(k))


@query(
    f"WITH {VECTORS}, w AS (SELECT row_number() OVER (ORDER BY id) AS k, x FROM v ORDER BY id LIMIT 4), f AS (SELECT id, x, unnest(range(1, len(x) + 1)) AS i FROM v), "
    "e AS (SELECT id, i, any_value(f.x[i]) AS a, sum(f.x[k] * w.x[i]) AS b FROM f, w GROUP BY id, i) "
    "SELECT round(sqrt(sum((a - b) * (a - b))), 6) + 0.0 AS frobenius, round(100 * sum(abs(a - b)) / sum(abs(a)), 6) + 0.0 AS residual FROM e"
)
def factor_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error of given factors: the first four vectors, weighed by the first four numbers of each row."""
    v = vectors(spark, sf_dir)
    w = np.array([r["x"] for r in v.orderBy("id").limit(4).collect()])
    return factor.errors(v.withColumn("h", F.slice("x", 1, 4)), w).select(r6("frobenius").alias("frobenius"), r6("residual").alias("residual"))


def simplex_sql(k: int) -> str:
    """Three jumps to the farthest vector, then the greatest score of the logs of distances to the picks."""
    steps = [f"WITH {VECTORS}", "j0 AS (SELECT id, x, 0.0 AS d FROM v ORDER BY id LIMIT 1)"]
    for i in range(1, 4):
        steps.append(f"j{i} AS MATERIALIZED (SELECT v.id, v.x, list_distance(v.x, j{i - 1}.x) AS d FROM v, j{i - 1} ORDER BY d DESC, v.id LIMIT 1)")
    steps += ["d0 AS (SELECT id, x, 0.0 AS s, 0.0 AS q FROM v)", "p0 AS MATERIALIZED (SELECT id, x FROM j3)"]
    for i in range(1, k):
        log = f"ln(list_distance(d{i - 1}.x, p{i - 1}.x) + 1e-8)"
        steps.append(f"d{i} AS MATERIALIZED (SELECT d{i - 1}.id, d{i - 1}.x, s + {log} AS s, q + pow({log}, 2) AS q FROM d{i - 1}, p{i - 1})")
        steps.append(f"p{i} AS MATERIALIZED (SELECT id, x FROM d{i} ORDER BY (s * s - q) / 2 + (SELECT ln(d) FROM j3) * s - {i / 2} * q DESC, id LIMIT 1)")
    return ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT cast({i} AS INTEGER) AS pick, id FROM p{i}" for i in range(k))


@query(simplex_sql(5))
def simplex_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(factor.simplex_rows(vectors(spark, sf_dir), 5))), "pick int, id long")


@query(farthest_sql(6))
def farthest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return spark.createDataFrame(list(enumerate(factor.farthest(v, 6))), "pick int, id long")


@query()
def cur_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factor.cur_columns(vectors(spark, sf_dir), 40)


# -- panels

PANEL = "SELECT c_nationkey AS unit, year(o_orderdate) * 12 + month(o_orderdate) AS month, avg(o_totalprice) AS price, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"


def panel_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    both = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    return both.groupBy(F.col("c_nationkey").alias("unit"), month.alias("month")).agg(F.avg("o_totalprice").cast("double").alias("price"), F.count(F.lit(1)).cast("double").alias("orders"))


@query(f"WITH p AS ({PANEL}) SELECT month, " + ", ".join(f"round(avg(price) FILTER (WHERE unit = {i}) + 1.2e-6, 4) AS u{i}" for i in range(25)) + " FROM p GROUP BY month")
def donor_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = control.panel(panel_of(spark, sf_dir), "unit", "month", "price", list(range(25)))
    # Means of cents often end in a 5 at the fifth place; the shift keeps such ties apart.
    return wide.select("month", *(F.round(F.col(str(i)) + 1.2e-6, 4).alias(f"u{i}") for i in range(25)))


@query()
def synthetic_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation 0's monthly mean price as a combination of the others'; the tests recover a planted combination."""
    return control.synthetic_control(panel_of(spark, sf_dir), "unit", "month", "0", {"price": 1.0}, 1998 * 12, 3)


@query()
def multi_metric_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.synthetic_control(panel_of(spark, sf_dir), "unit", "month", "0", {"price": 1.0, "orders": 1e6}, 1998 * 12, 3)


@query()
def als_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel's cells from factors fitted to the observed ones."""
    return als.complete(panel_of(spark, sf_dir).select(F.col("unit").cast("int").alias("row"), F.col("month").cast("int").alias("col"), F.col("price").alias("value")), 3)


# -- general fits

@query()
def fit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five event types together: automatic rank, imputation and forecast scores."""
    df = read(spark, sf_dir, "events")
    axis = series.axis_of(df, "ts", 3600)
    kinds = ["click", "error", "purchase", "signup", "view"]
    t = axis.index(F.col("ts"))
    wide = df.groupBy(t.alias("t")).pivot("event_type", kinds).agg(F.avg("value"))
    n = wide.agg(F.max("t")).first()[0] + 1
    long = series.melt(spark.range(n).withColumnRenamed("id", "t").join(wide, "t", "left"), kinds)
    f = fit.fit(long, n, len(kinds), fit.Options(entries=1200))
    return fit.scores(f)


@query()
def general_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day ahead with ten columns to a row and rank 2; checked on ramps and harmonics in the tests."""
    long = cut(series.melt(events_series(spark, sf_dir, 3600), ["value"]))
    n = long.agg(F.max("t")).first()[0] + 1
    f = fit.fit(long, n, 1, fit.Options(entries=500, rank=2))
    return predict.forecast(f, fit.coefficients(f), long.where(F.col("t") >= n - f.dims.rows + 1), n, n + 23)

