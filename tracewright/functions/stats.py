"""Aggregates of the domain (aggregate inventory A1-A31)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .expr import c


def quantile(x: str | Column, q) -> Column:
    """exact, linear between neighbours; q may be a list."""
    return F.percentile(c(x), q if not isinstance(q, (list, tuple)) else F.array(*[F.lit(float(v)) for v in q]))


def at_rank(x: str | Column, q: float) -> Column:
    """F8: the value at floor(q (n - 1)), without interpolation."""
    values = F.sort_array(F.collect_list(c(x)))
    return F.try_element_at(values, (F.floor(F.lit(q) * (F.size(values) - 1)) + 1).cast("int"))


def upper_median(x: str | Column) -> Column:
    """The value at place n // 2, counted from 0 (collects a group's
    values; use ``upper_median_of`` where a group can be large)."""
    values = F.sort_array(F.collect_list(c(x)))
    return F.try_element_at(values, (F.floor(F.size(values) / 2) + 1).cast("int"))


def upper_median_of(df: DataFrame, keys: list[str], x: str, out: str, cell: int = 1 << 20) -> DataFrame:
    """The same by counts of distinct values, in two levels: cells of ``cell`` values name the
    one that holds the place, and only its distinct values meet in a group."""
    counts = df.filter(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count(F.lit(1)).alias("__n")).withColumn("__cell", F.floor(F.col(x) / cell))
    w = Window.partitionBy(*keys)
    up = lambda by: F.sum("__n").over(w.orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    cells = counts.groupBy(*keys, "__cell").agg(F.sum("__n").alias("__n")).withColumns({"__up": up("__cell"), "__all": F.sum("__n").over(w)})
    cells = cells.filter((F.col("__up") > F.floor(F.col("__all") / 2)) & (F.col("__up") - F.col("__n") <= F.floor(F.col("__all") / 2)))
    inside = counts.join(cells.select(*keys, "__cell", (F.floor(F.col("__all") / 2) - F.col("__up") + F.col("__n")).alias("__place")), [*keys, "__cell"])
    return inside.withColumn("__up", up(x)).filter(F.col("__up") > F.col("__place")).groupBy(*keys).agg(F.min(x).alias(out))


def mode_first_seen(df: DataFrame, keys: list[str], value: str, position: str | Column, out: str, nulls: bool = False) -> DataFrame:
    """A2: the most frequent value of each group; of equals the one seen first."""
    rows = df if nulls else df.filter(F.col(value).isNotNull())
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"), F.min(c(position)).alias("__p"))
    best = F.min(F.struct((-F.col("__n")).alias("n"), F.col("__p").alias("p"), F.col(value).alias("v")))
    return counts.groupBy(*keys).agg(best.alias("__b")).select(*keys, F.col("__b.v").alias(out), (-F.col("__b.n")).alias(f"{out}_n"))


def top_k(df: DataFrame, keys: list[str], value: str, position: str | Column, k: int) -> DataFrame:
    """A3: (keys, value, n, rank): the k most frequent, equals in order of first sight."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(c(position)).alias("__p"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "__p")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("__p")


def robust_sigma(df: DataFrame, keys: list[str], x: str, out: str = "sigma") -> DataFrame:
    """1.4826 times the median distance from the median."""
    centre = df.groupBy(*keys).agg(F.percentile(x, 0.5).alias("__m"))
    joined = df.join(centre, keys) if keys else df.crossJoin(F.broadcast(centre))  # one row
    return joined.groupBy(*keys).agg((F.lit(1.4826) * F.percentile(F.abs(F.col(x) - F.col("__m")), 0.5)).alias(out))


def ks_two_samples(df: DataFrame, keys: list[str], x: str, first: str, weight: str | None = None) -> DataFrame:
    """(keys, n1, n2, d, p) of the samples where the column ``first`` is true or not;
    ``weight``: how many values a row stands for (whole numbers), else one.

    Distribution steps are taken at distinct values, so samples of any size meet
    only as counts.  Null values belong to no sample."""
    n = F.lit(1).cast("long") if weight is None else F.col(weight)
    counts = df.filter(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.sum(F.col(first).cast("long") * n).alias("a"), F.sum((~F.col(first)).cast("long") * n).alias("b"))
    w = Window.partitionBy(*keys)
    up = w.orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    steps = counts.withColumns({"n1": F.sum("a").over(w), "n2": F.sum("b").over(w), "ca": F.sum("a").over(up), "cb": F.sum("b").over(up)})
    d = steps.filter("n1 > 0 and n2 > 0").groupBy(*keys).agg(F.first("n1").alias("n1"), F.first("n2").alias("n2"), F.max(F.abs(F.col("ca") / F.col("n1") - F.col("cb") / F.col("n2"))).alias("d"))
    return d.withColumn("p", ks_probability("d", "n1", "n2"))


def ks_probability(d: str | Column, n1: str | Column, n2: str | Column) -> Column:
    ne = F.sqrt(c(n1).cast("double") * c(n2) / (c(n1) + c(n2)))
    return ks_series((ne + 0.12 + F.lit(0.11) / ne) * c(d))


def ks_series(lam: str | Column) -> Column:
    """2 sum (-1)^(k-1) exp(-2 k^2 lambda^2) over k = 1..100, within 0 and 1."""
    x = c(lam)
    total = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(F.lit(-2.0) * k * k * x * x))
    return F.when(x < 1e-9, 1.0).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def pooled(n: str, mean: str, std: str) -> tuple[Column, Column]:
    """A10: mean and spread of groups put together."""
    total = F.sum(n)
    mu = F.sum(F.col(n) * F.col(mean)) / total
    square = F.sum(F.col(n) * (F.col(std) * F.col(std) + F.col(mean) * F.col(mean))) / total
    return mu, F.sqrt(F.greatest(square - mu * mu, F.lit(0.0)))


def pooled_acf(df: DataFrame, series: list[str], run: str, order: str, x: str, lags: int) -> DataFrame:
    """(series, lag, acf): pairs never cross a run; mean and variance over all.
    null where there are no pairs or no variance."""
    base = df.groupBy(*series).agg(F.avg(x).alias("__mu"), F.var_pop(x).alias("__var"))
    rows = df.join(base, series)
    w = Window.partitionBy(*series, run).orderBy(order)
    d = F.col(x) - F.col("__mu")
    lagged = rows.withColumns({"__d": d, "__lags": F.array(*[F.lag(d, k).over(w) for k in range(1, lags + 1)])})
    pairs = lagged.select(*series, "__var", "__d", F.posexplode("__lags").alias("__k", "__e"))
    return pairs.groupBy(*series, (F.col("__k") + 1).alias("lag")).agg(F.when(F.first("__var") > 0, F.try_divide(F.avg(F.col("__d") * F.col("__e")), F.first("__var"))).alias("acf"))


def precision_recall(tp: str | Column, fp: str | Column, fn: str | Column, zero: bool = False) -> dict[str, Column]:
    """Null where there is no denominator (zero: 0 instead)."""
    p, r = F.try_divide(c(tp).cast("double"), c(tp) + c(fp)), F.try_divide(c(tp).cast("double"), c(tp) + c(fn))
    if zero:
        p, r = F.coalesce(p, F.lit(0.0)), F.coalesce(r, F.lit(0.0))
    f1 = F.try_divide(p * r * 2, p + r)
    return {"precision": p, "recall": r, "f1": F.coalesce(f1, F.lit(0.0)) if zero else f1}


def _ranked(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Positives and all at each distinct score, from the top: curves over groups
    of any size are sums over distinct scores."""
    counts = df.groupBy(*keys, F.col(score).alias("__score")).agg(F.count(F.lit(1)).alias("__n"), F.sum(F.col(label).cast("long")).alias("__p"))
    w = Window.partitionBy(*keys).orderBy(F.desc("__score")).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("__cn", F.sum("__n").over(w))


def average_precision(df: DataFrame, keys: list[str], score: str, label: str, index: str) -> DataFrame:
    """By falling score, equals in order of ``index``; null without positives.

    Rows of one group are ranked in one window; see ``auroc`` for a form by counts."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), index).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumns({"__r": F.count(F.lit(1)).over(w), "__tp": F.sum(F.col(label).cast("long")).over(w)})
    return rows.groupBy(*keys).agg(F.try_divide(F.sum(F.when(F.col(label) == 1, F.col("__tp") / F.col("__r"))), F.sum(F.col(label).cast("long"))).alias("ap"))


def auroc(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Ranks averaged over equal scores; null with one class only."""
    r = _ranked(df, keys, score, label)
    # Rank from below: a score's rows stand below cn - n rows above them.
    down = F.col("__p") * (F.col("__cn") - F.col("__n") + (F.col("__n") + 1) / 2)
    totals = r.groupBy(*keys).agg(F.sum("__n").alias("__all"), F.sum("__p").alias("__pos"), F.sum(down).alias("__down"))
    n1, n0 = F.col("__pos"), F.col("__all") - F.col("__pos")
    up = n1 * (F.col("__all") + 1) - F.col("__down")
    return totals.select(*keys, F.try_divide(up - n1 * (n1 + 1) / 2, (n1 * n0).cast("double")).alias("auroc"))


def error_summary(x: str) -> list[Column]:
    """A19."""
    a = F.abs(x)
    return [F.count(x).alias("n"), F.avg(x).alias("mean"), F.avg(a).alias("mae"), F.percentile(x, 0.5).alias("median"), F.percentile(a, 0.9).alias("p90_abs"), F.max(a).alias("max_abs")]


def confusion(df: DataFrame, expected: str, obtained: str, weight: str | None = None) -> DataFrame:
    """A18, as rows (expected, obtained, n)."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.groupBy(F.col(expected).alias("expected"), F.col(obtained).alias("obtained")).agg(n.alias("n"))
