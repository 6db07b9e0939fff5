"""Latency profiles: moving quantiles, floor elevation, hours and days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import day_of, hour_of, micros
from ..functions.stats import quantile
from .windows import QS, episodes, moving_quantiles


def hourly(df: DataFrame, keys: list[str], ts: str, x: str, spike_ms: float = 10.0, offset_h: float = 0.0, min_n: int = 5) -> DataFrame:
    """Quantiles, mean and share of spikes (over the series' median) by hour."""
    median = df.groupBy(*keys).agg(F.percentile(x, 0.5).alias("__m"))
    rows = df.join(median, keys).withColumn("hour", hour_of(ts, offset_h))
    spike = (F.col(x) > F.col("__m") + spike_ms).cast("double")
    return rows.groupBy(*keys, "hour").agg(F.count(x).alias("n"), quantile(x, QS).alias("q"), F.avg(x).alias("mean"), F.avg(spike).alias("spike_rate")).filter(F.col("n") >= min_n)


def daily(df: DataFrame, keys: list[str], ts: str, x: str, offset_h: float = 0.0, min_n: int = 20) -> DataFrame:
    """A13."""
    return df.groupBy(*keys, day_of(ts, offset_h).alias("day")).agg(F.count(x).alias("n"), quantile(x, QS).alias("q")).filter(F.col("n") >= min_n)


def drift(profile: DataFrame, keys: list[str]) -> DataFrame:
    """Spread of the medians and of the floors over hours or days."""
    return profile.groupBy(*keys).agg((F.max(F.col("q")[2]) - F.min(F.col("q")[2])).alias("median_range"), (F.max(F.col("q")[0]) - F.min(F.col("q")[0])).alias("floor_range"))


def moving_spread(moving: DataFrame, keys: list[str]) -> DataFrame:
    """P95 - P5 over time of the floor (p10), the median and the tail (p90), and
    what it means: the floor moves 2 ms or more, only the dispersion does, or neither."""
    r = lambda i: F.percentile(F.col("q")[i], 0.95) - F.percentile(F.col("q")[i], 0.05)
    out = moving.groupBy(*keys).agg(F.count(F.lit(1)).alias("windows"), r(0).alias("floor_range"), r(2).alias("median_range"), r(4).alias("tail_range"))
    wide = F.col("tail_range") > 2 * F.col("floor_range")
    return out.withColumn("reading", F.when(F.col("floor_range") >= 2, "mueve el piso").when(wide, "dispersion").otherwise("estable"))


def quantile_columns(profile: DataFrame) -> DataFrame:
    """The array q of a profile as p10 to p90 and iqr, and the timestamp of a moving one."""
    out = profile.withColumns({**{f"p{round(100 * v)}": F.col("q")[i] for i, v in enumerate(QS)}, "iqr": F.col("q")[3] - F.col("q")[1]})
    return out.withColumn("timestamp", F.timestamp_micros("center_us").cast("timestamp_ntz")) if "center_us" in profile.columns else out


def elevation_columns(found: DataFrame) -> DataFrame:
    """Episodes of the floor with times and hours."""
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return found.withColumns({"start_ts": at("start_us"), "end_ts": at("end_us"), "hours": F.col("duration_us") / 3.6e9})


def elevated_time(found: DataFrame, df: DataFrame, keys: list[str], ts: str, thresholds=(2.0, 5.0)) -> DataFrame:
    """Episodes, hours in them and the share of the series' time, for every series and
    threshold (none: 0; a series without duration: null)."""
    span = df.groupBy(*keys).agg((F.max(micros(ts)) - F.min(micros(ts))).alias("__span")).withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    sums = found.groupBy(*keys, "threshold").agg(F.count(F.lit(1)).alias("__n"), F.sum("duration_us").alias("__us"))
    us, zero = F.coalesce("__us", F.lit(0).cast("long")), F.lit(0).cast("long")
    return span.join(sums, [*keys, "threshold"], "left").select(*keys, "threshold", F.coalesce("__n", zero).alias("episodes"), (us / 3.6e9).alias("hours"), F.try_divide(us, "__span").alias("share"))


def floor_elevation(df: DataFrame, keys: list[str], ts: str, x: str, interval_s: float, width_s: float = 6 * 3600, step_s: float = 3600, q: float = 0.25, thresholds=(2.0, 5.0), min_s: float = 6 * 3600, min_cover: float = 0.5) -> DataFrame:
    """Episodes in which the moving floor stands above the series' P25."""
    ref = df.groupBy(*keys).agg(F.percentile(x, 0.25).alias("__ref"))
    moving = moving_quantiles(df, keys, ts, x, width_s, step_s, interval_s, min_cover, [q]).join(ref, keys).withColumn("above", F.col("q")[0] - F.col("__ref"))
    levels = moving.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    step = round(step_s * 1e6)
    return episodes(levels.filter("above >= threshold"), [*keys, "threshold"], "center_us", "above", 0.0, step, round(min_s * 1e6))


def downsample(df: DataFrame, keys: list[str], ts: str, x: str, columns: int) -> DataFrame:
    """A series in so many columns of time: least, greatest and mean value."""
    span = df.groupBy(*keys).agg(F.min(micros(ts)).alias("__a"), F.max(micros(ts)).alias("__b"))
    at = F.least(F.floor(F.try_divide((micros(ts) - F.col("__a")) * F.lit(columns), F.col("__b") - F.col("__a") + 1)), F.lit(columns - 1))
    return df.join(span, keys).groupBy(*keys, at.cast("long").alias("column")).agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"))
