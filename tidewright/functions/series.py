"""Time series as DataFrames: equal steps, gaps, fills, normalisation.

The regular form is long: ``series`` (number of the value column), ``t`` (step from
0) and ``value`` (null where nothing was observed).
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

AGGREGATES = {"average": F.avg, "min": F.min, "max": F.max}
SECOND = 1_000_000


@dataclass(frozen=True)
class Axis:
    """How a time column maps to steps: step = (position - start) // step, in microseconds for timestamps."""

    start: int
    step: int
    timestamps: bool

    def index(self, time: Column) -> Column:
        """Step number of a time value; times before the start have negative ones."""
        x = position(time, self.timestamps) - F.lit(self.start)
        step = F.lit(self.step)
        return ((x - F.pmod(x, step)) / step).cast("long")

    def index_of(self, value: object) -> int:
        """Step number of a Python value (int, datetime or its text)."""
        return (to_position(value, self.timestamps) - self.start) // self.step

    def time(self, step: Column) -> Column:
        """The time at which a step starts."""
        x = step * F.lit(self.step) + F.lit(self.start)
        return F.timestamp_micros(x) if self.timestamps else x


def position(time: Column, timestamps: bool) -> Column:
    return F.unix_micros(time.cast("timestamp")) if timestamps else time.cast("long")


def to_position(value: object, timestamps: bool) -> int:
    if not timestamps:
        return int(value)  # type: ignore[call-overload]
    at = datetime.fromisoformat(value) if isinstance(value, str) else value
    if not isinstance(at, datetime):
        raise TypeError(f"a timestamp is needed, not {value!r}")
    at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    delta = at - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (delta.days * 86400 + delta.seconds) * SECOND + delta.microseconds


def is_timestamp(df: DataFrame, time: str) -> bool:
    return not isinstance(df.schema[time].dataType, NumericType)


def bounds(df: DataFrame, time: str) -> DataFrame:
    """first and last time of a table."""
    return df.agg(F.min(time).alias("first"), F.max(time).alias("last"))


def interval(df: DataFrame, time: str, n: int = 100) -> DataFrame:
    """The median step between the ``n`` first times, in seconds (timestamps) or units; column ``step``."""
    stamps = is_timestamp(df, time)
    first = df.where(F.col(time).isNotNull()).orderBy(time).limit(n).select(position(F.col(time), stamps).alias("x"))
    # At most n rows reach this window.
    gaps = first.select((F.col("x") - F.lag("x").over(Window.orderBy("x"))).alias("gap"))
    return gaps.agg((F.percentile("gap", 0.5) / (SECOND if stamps else 1)).alias("step"))


def axis_of(df: DataFrame, time: str, step_seconds: float | None = None, start: object = None) -> Axis:
    """The axis of a table. Timestamps start at the first one, cut to the second; integers step by 1."""
    stamps = is_timestamp(df, time)
    if start is None:
        row = df.agg(F.min(position(F.col(time), stamps)).alias("x")).first()
        if row is None or row["x"] is None:
            raise ValueError("the table has no times")
        begin = row["x"] // SECOND * SECOND if stamps else row["x"]
    else:
        begin = to_position(start, stamps)
    if not stamps:
        return Axis(begin, 1, False)
    if step_seconds is None:
        step_seconds = interval(df, time).first()["step"]
    if not step_seconds or step_seconds <= 0:
        raise ValueError("the sampling interval can't be estimated; give it")
    return Axis(begin, round(step_seconds * SECOND), True)


def regularise(df: DataFrame, time: str, values: list[str], axis: Axis, aggregate: str = "average", end: int | None = None) -> DataFrame:
    """Equal steps from 0 to the last (or ``end``): t and the value columns, null in empty steps.

    An equi-join on the step number, so no range join is needed.
    """
    if aggregate not in AGGREGATES:
        raise ValueError(f"aggregate must be one of {sorted(AGGREGATES)}")
    t = axis.index(F.col(time))
    rows = df.select(t.alias("t"), *(F.col(f"`{v}`").cast("double").alias(v) for v in values)).where("t >= 0")
    if end is not None:
        rows = rows.where(F.col("t") <= end)
    steps = rows.groupBy("t").agg(*(AGGREGATES[aggregate](F.col(f"`{v}`")).alias(v) for v in values))
    if end is None:
        last = rows.agg(F.max("t").alias("m")).first()["m"]
        end = -1 if last is None else last
    return df.sparkSession.range(0, end + 1).withColumnRenamed("id", "t").join(steps, "t", "left")


def melt(wide: DataFrame, values: list[str]) -> DataFrame:
    """Long form of a regular wide table: series (number), t, value."""
    pairs = ", ".join(f"{i}, `{v}`" for i, v in enumerate(values))
    return wide.select("t", F.expr(f"stack({len(values)}, {pairs}) as (series, value)")).select("series", "t", "value")


def fill(df: DataFrame, by: list[str], order: str = "t", value: str = "value", out: str = "filled") -> DataFrame:
    """Last seen value, else (at the beginning) the next one, within each group of ``by``."""
    w = Window.partitionBy(*by).orderBy(order)
    ahead = w.rowsBetween(Window.unboundedPreceding, 0)
    behind = w.rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(ahead), F.first(value, ignorenulls=True).over(behind)))


def forward_fill(df: DataFrame, by: list[str], order: str = "t", value: str = "value", out: str = "filled") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def backward_fill(df: DataFrame, by: list[str], order: str = "t", value: str = "value", out: str = "filled") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn(out, F.first(value, ignorenulls=True).over(w))


def fill_series(df: DataFrame, ahead: bool = True, behind: bool = True, slab: int = 4096, order: str = "t", value: str = "value", out: str = "filled") -> DataFrame:
    """One long series filled by the last seen value (``ahead``), else by the next one (``behind``), in two levels.

    Windows run inside slabs of ``slab`` steps; what a slab's edge needs comes from
    a table of one row a slab, so no window holds the whole series.
    """
    part, last, first = (_free(df, c) for c in ("slab", "seen", "next"))
    rows = df.withColumn(part, F.floor(F.col(order) / slab))
    seen = F.when(F.col(value).isNotNull(), F.struct(order, value))
    edges = rows.groupBy(part).agg(F.max(seen)[value].alias(last), F.min(seen)[value].alias(first))
    over = Window.orderBy(part)
    before = F.last(last, ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(first, ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing))
    edges = edges.select(part, before.alias(last), after.alias(first))
    w = Window.partitionBy(part).orderBy(order)
    own_last = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    own_next = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    sources = [own_last, F.col(last)] * ahead + [own_next, F.col(first)] * behind
    return rows.join(edges, part).withColumn(out, F.coalesce(*sources)).drop(part, last, first)


def _free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def observed(df: DataFrame, value: str = "value") -> Column:
    """Share of non-null values, an aggregate."""
    return F.count(value) / F.count(F.lit(1))


def zero_fill(value: Column, p: Column | float) -> Column:
    """Nulls as 0, scaled by the share of observed values."""
    return F.coalesce(value, F.lit(0.0)) / p


def moments(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """mean and population std of each group, nulls ignored; a constant group gets std 1."""
    std = F.stddev_pop(value)
    return df.groupBy(*by).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), F.when(std > 0, std).otherwise(1.0).alias("std"))
