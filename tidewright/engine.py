"""Prediction indexes over time-series tables: create, predict, forecast, refresh, list, delete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import layout, series
from .functions.series import Axis
from .operators import bound, fit, predict
from .operators.fit import Fitted, Options
from .session import cut
from .sources.store import IndexStore

MEAN, VARIANCE = "mean", "variance"


class Engine:
    """Indexes stored below ``folder``, over Parquet tables, views or DataFrames registered by name."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.store = IndexStore(spark, folder)
        self._frames: dict[str, DataFrame] = {}

    def register(self, relation: str, df: DataFrame) -> None:
        """Name a DataFrame; other names are looked up in the session's catalog."""
        self._frames[relation] = df

    def relation(self, name: str) -> DataFrame:
        return self._frames[name] if name in self._frames else self.spark.table(name)

    # -- building

    def create_pindex(
        self,
        table_name: str,
        time_column: str,
        value_column: list[str] | str,
        index_name: str,
        fill_in_missing: bool = True,
        normalize: bool = True,
        auto_update: bool = True,
        timescale: bool = False,
        t_var: int = -1,
        k: int | None = None,
        k_var: int | None = 1,
        t: int = 2_500_000,
        t0: int = 1000,
        var_direct: bool = True,
        gamma: float = 0.5,
        col_to_row_ratio: float = 10,
        agg_interval: float | None = None,
        l: int = 0,  # noqa: E741  the public name
        aggregation_method: str = "average",
        start_time: object = None,
        uncertainty: bool = True,
    ) -> dict:
        """Build an index and make it current. ``t_var`` and ``timescale`` are accepted; both models use ``t``.

        Below ``t0`` observations no model is fitted and predictions are the mean of what was observed.
        """
        values = [value_column] if isinstance(value_column, str) else list(value_column)
        df = self.relation(table_name)
        missing = [c for c in (time_column, *values) if c not in df.columns]
        if missing:
            raise ValueError(f"no columns {missing}")
        axis = series.axis_of(df, time_column, agg_interval, start_time)
        meta = {
            "index_name": index_name, "relation": table_name, "time_column": time_column, "value_columns": values, "uncertainty": uncertainty,
            "timestamps": axis.timestamps, "start": axis.start, "step": axis.step, "agg_interval": axis.step / series.SECOND if axis.timestamps else 1.0,
            "aggregate": aggregation_method, "entries": t, "rank": k, "rank_var": k_var, "ratio": float(col_to_row_ratio), "fixed_rows": l or None, "fill": fill_in_missing,
            "normalise": normalize, "direct": var_direct, "gamma": gamma if 0 <= gamma < 1 else 0.5, "t0": t0, "auto_update": auto_update,
        }
        return self._build(meta, self._long(meta), 0, None)

    def _axis(self, meta: dict) -> Axis:
        return Axis(meta["start"], meta["step"], meta["timestamps"])

    def _long(self, meta: dict) -> DataFrame:
        wide = series.regularise(self.relation(meta["relation"]), meta["time_column"], meta["value_columns"], self._axis(meta), meta["aggregate"])
        return series.melt(wide, meta["value_columns"])

    def _options(self, meta: dict, rank: int | None) -> Options:
        return Options(meta["entries"], rank, meta["ratio"], meta["fixed_rows"], meta["fill"], meta["normalise"])

    def _build(self, meta: dict, long: DataFrame, only: int, old: dict | None) -> dict:
        """Fit sub-models from ``only`` on, keep the older ones of ``old``, and publish."""
        long = cut(long)
        count = len(meta["value_columns"])
        seen = long.agg(F.max("t").alias("t"), F.count("value").alias("n")).first()
        steps = 0 if seen["t"] is None else seen["t"] + 1
        means = {r["series"]: r["m"] for r in long.groupBy("series").agg(F.avg("value").alias("m")).collect()}
        meta = meta | {"steps": steps, "fallback": [means.get(i) for i in range(count)], "models": 0, "models_var": 0, "boundary": -1, "boundary_var": -1, "observed": 1.0}
        tables = {"observations": long}
        if seen["n"] < max(meta["t0"], 4):
            return self.store.publish(meta, tables | {"stats": self._stats(meta, None, long, None)})
        mean = fit.fit(long, steps, count, self._options(meta, meta["rank"]), only, old["rank_used"] if old else None)
        mean = self._joined(mean, old, MEAN, only)
        meta |= {"models": mean.models, "boundary": mean.boundary, "observed": mean.observed, "rank": mean.rank}
        tables |= {MEAN: mean.parts, f"{MEAN}_coefficients": fit.coefficients(mean)}
        if meta["uncertainty"]:
            first = only * mean.half
            denoised = predict.denoise(mean, first) if meta["direct"] else None
            around = fit.residuals(long.where(F.col("t") >= first), denoised, meta["direct"])
            variance = fit.fit(cut(around), steps, count, self._options(meta, meta["rank_var"]), only)
            variance = self._joined(variance, old, VARIANCE, only)
            meta |= {"models_var": variance.models, "boundary_var": variance.boundary, "rank_var": variance.rank}
            tables |= {VARIANCE: variance.parts, f"{VARIANCE}_coefficients": fit.coefficients(variance)}
        return self.store.publish(meta, tables | {"stats": self._stats(meta, mean, long, fit.out_of_sample(mean, long))})

    def _joined(self, new: Fitted, old: dict | None, kind: str, only: int) -> Fitted:
        if old is None:
            return new
        kept = self.store.table(old["index_name"], kind, old["version"]).where(F.col("model") < only)
        return Fitted(cut(kept.unionByName(new.parts)), new.dims, new.series, new.steps, new.models, new.rank, new.observed)

    def _stats(self, meta: dict, fitted: Fitted | None, long: DataFrame, test: DataFrame | None) -> DataFrame:
        names = F.create_map(*(x for i, c in enumerate(meta["value_columns"]) for x in (F.lit(i), F.lit(c))))
        out = long.groupBy("series").agg(F.count("value").alias("number_of_observations"))
        if fitted is None:
            extra = {"models": F.lit(0).cast("long"), **{c: F.lit(None).cast("double") for c in ("imputation_score", "forecast_score", "test_forecast_score")}}
            out = out.withColumns(extra)
        else:
            out = out.join(fit.scores(fitted), "series", "left").join(test, "series", "left")
        return out.select(
            F.lit(meta["index_name"]).alias("index_name"), names[F.col("series")].alias("column_name"), "number_of_observations", F.col("models").alias("number_of_trained_models"),
            "imputation_score", "forecast_score", "test_forecast_score",
        )

    def update_pindex(self, index_name: str, minimum: int | None = None) -> bool:
        """Refit what new rows change; False if they are too few (five matrix rows' worth of steps, unless ``minimum``).

        Sub-models that new steps reach, from the last but one on, are fitted again; the others are kept.
        """
        meta = self.store.meta(index_name)
        long = self._long(meta)
        last = long.agg(F.max("t")).first()[0]
        if last is None or last + 1 <= meta["steps"]:
            return False
        if meta["models"] == 0:
            self._build(meta, long, 0, None)
            return True
        dims = layout.dimensions(min(meta["entries"], meta["steps"] * len(meta["value_columns"])), meta["ratio"], len(meta["value_columns"]), meta["fixed_rows"])
        gate = 5 * dims.rows if minimum is None else minimum
        if last + 1 - meta["steps"] <= gate:
            return False
        grown = meta["steps"] * len(meta["value_columns"]) < meta["entries"]  # a first sub-model that was not full changes its size
        only = 0 if grown else max(meta["models"] - 2, 0)
        old = None if grown else meta | {"rank_used": meta["rank"]}
        self._build(meta, long, only, old)
        return True

    def delete_pindex(self, index_name: str) -> None:
        self.store.drop(index_name)

    # -- reading

    def list_pindices(self) -> DataFrame:
        """index_name, value_columns, relation, time_column, initial_timestamp, last_timestamp, agg_interval, uncertainty_quantification."""
        m = self.store.manifests()
        at = lambda step: F.when(F.col("timestamps"), F.timestamp_micros(F.col("start") + step * F.col("step")).cast("string")).otherwise((F.col("start") + step).cast("string"))
        shown = F.when(F.col("timestamps"), F.concat(F.col("agg_interval").cast("string"), F.lit(" seconds"))).otherwise(F.concat(F.col("agg_interval").cast("string"), F.lit(" units")))
        return m.select(
            "index_name", "value_columns", "relation", "time_column", at(F.lit(0)).alias("initial_timestamp"), at(F.col("steps") - 1).alias("last_timestamp"),
            shown.alias("agg_interval"), F.col("uncertainty").alias("uncertainty_quantification"),
        )

    def pindices_stat(self) -> DataFrame:
        """Quality of every index and column."""
        rows = [self.store.table(r["index_name"], "stats", r["version"]) for r in self.store.manifests().select("index_name", "version").collect()]
        if not rows:
            return self.spark.createDataFrame(
                [], "index_name string, column_name string, number_of_observations long, number_of_trained_models long, imputation_score double, forecast_score double, test_forecast_score double"
            )
        out = rows[0]
        for more in rows[1:]:
            out = out.unionByName(more)
        return out

    def fitted(self, meta: dict, kind: str) -> Fitted:
        count = len(meta["value_columns"])
        dims = layout.dimensions(min(meta["entries"], meta["steps"] * count), meta["ratio"], count, meta["fixed_rows"])
        var = kind == VARIANCE
        return Fitted(
            self.store.table(meta["index_name"], kind, meta["version"]), dims, count, meta["steps"], meta["models_var" if var else "models"], meta["rank_var" if var else "rank"], meta["observed"]
        )

    def predict(
        self, table: str, column: str, t1: object, t2: object = None, index: str = "", uq: bool = True, uq_method: str = "Gaussian", c: float = 95.0, projected: bool = False, averaging: str = "average"
    ) -> DataFrame:
        """time, prediction, lb, ub of the steps from ``t1`` to ``t2`` (or at ``t1``).

        Steps that the index's matrices cover are imputed (denoised), later ones forecast.
        """
        meta = self.store.meta(index)
        if meta["relation"] != table:
            raise ValueError(f"{index!r} is an index of {meta['relation']!r}")
        if column not in meta["value_columns"]:
            raise ValueError(f"{column!r} is not in the index")
        predict.width(c, uq_method)
        axis = self._axis(meta)
        first = axis.index_of(t1)
        last = first if t2 is None else axis.index_of(t2)
        if first < 0 or last < first:
            raise ValueError("the range must start at or after the series and not end before it starts")
        number = meta["value_columns"].index(column)
        steps = self.spark.range(first, last + 1).select(F.lit(number).alias("series"), F.col("id").alias("t"))
        if meta["models"] == 0:
            mean = steps.withColumn("estimate", F.lit(meta["fallback"][number]).cast("double"))
            variance = steps.withColumn("estimate", F.lit(0.0))
        else:
            mean = self._kind(meta, MEAN, number, first, last, averaging, projected)
            variance = self._kind(meta, VARIANCE, number, first, last, averaging, projected) if uq and meta["uncertainty"] else None
        out = predict.bounded(mean, variance if uq else None, c, uq_method, meta["direct"])
        return out.select(axis.time(F.col("t")).alias("time"), "t", "prediction", "lb", "ub")

    def _kind(self, meta: dict, kind: str, number: int, first: int, last: int, averaging: str, projected: bool) -> DataFrame:
        """Imputed up to the model's own boundary, forecast beyond it."""
        model = self.fitted(meta, kind)
        edge = meta["boundary" if kind == MEAN else "boundary_var"]
        out = None
        if first <= edge:
            steps = self.spark.range(first, min(last, edge) + 1).withColumnRenamed("id", "t")
            out = predict.impute(model, steps).where(F.col("series") == number)
        if last > edge:
            after = max(first, edge + 1)
            coefficients = self.store.table(meta["index_name"], f"{kind}_coefficients", meta["version"])
            lags = model.dims.rows - 1
            if kind == VARIANCE and meta["direct"]:
                seeds = self.spark.range(max(edge - lags + 1, 0), edge + 1).withColumnRenamed("id", "t")
                recent = predict.impute(model, seeds).where(F.col("series") == number).select("series", "t", F.col("estimate").alias("value"))
            else:
                end = min(after - 1, meta["steps"] - 1)
                recent = self.store.table(meta["index_name"], "observations", meta["version"]).where((F.col("series") == number) & F.col("t").between(end - lags + 1, end))
            squared = kind == VARIANCE and not meta["direct"]
            ahead = predict.forecast(model, coefficients, recent, after, last, averaging, projected and kind == MEAN, squared)
            out = ahead if out is None else out.unionByName(ahead)
        return out

    def forecast_next(self, table: str, column: str, index: str, ahead: int = 1, averaging: str = "average", uq: bool = False, uq_method: str = "Gaussian", c: float = 95.0) -> DataFrame:
        """The ``ahead`` steps after the last one seen."""
        meta = self.store.meta(index)
        axis = self._axis(meta)
        begin = meta["start"] + meta["steps"] * meta["step"]
        end = begin + (ahead - 1) * meta["step"]
        if axis.timestamps:
            from datetime import datetime, timedelta, timezone

            epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
            return self.predict(table, column, epoch + timedelta(microseconds=begin), epoch + timedelta(microseconds=end), index, uq, uq_method, c, averaging=averaging)
        return self.predict(table, column, begin, end, index, uq, uq_method, c, averaging=averaging)

    def get_lowerbound(self, table: str, column: str, time_column: str, number_of_observations: int = 1000, samples: int = 100, k: int = 3, discretization_method: str = "quantization") -> DataFrame:
        """A lower bound on the error of predicting the last observations' symbols; null if one of them is missing."""
        return bound.lower_bound(self.relation(table), time_column, column, number_of_observations, samples, k, discretization_method)
