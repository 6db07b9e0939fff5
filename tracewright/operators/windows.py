"""Window and sequence operators (W1-W16) and joins in time.

Every operator takes the columns that name a series and works on all series at
once; partitioning is by series, so neighbouring operators share one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import c, micros
from ..functions.stats import quantile
from ..scratch import settled

#: Places of a series that meet in one group of the operators that work by parts.
PART = 1 << 17


def over(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def with_position(df: DataFrame, keys: list[str], order: list[str], out: str = "pos") -> DataFrame:
    """Position in the series, from 0."""
    return df.withColumn(out, F.row_number().over(over(keys, order)).cast("long") - 1)


def numbered(df: DataFrame, keys: str | list[str], order: list[str], out: str) -> DataFrame:
    """Settled ``df`` with each row's place in its series, from 0: parts of a range sort
    count for themselves, and begin behind those before them."""
    keys = [keys] if isinstance(keys, str) else keys
    parts = settled(df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()), "parts")
    counts = parts.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    first = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part")) - F.col("__n")
    before = counts.select(*[F.col(k).alias(f"__of{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p"), first.alias("__before"))
    place = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order)) - 1 + F.col("__before")
    on = [*[F.col(k).eqNullSafe(F.col(f"__of{i}")) for i, k in enumerate(keys)], F.col("__part") == F.col("__p")]
    return parts.join(before, on).withColumn(out, place.cast("long")).drop(*[f"__of{i}" for i in range(len(keys))], "__p", "__part", "__before")


def in_parts(df: DataFrame, pos: str, back: int = 0) -> DataFrame:
    """Rows with the part of ``PART`` places they are in (__part); a part's last ``back`` rows
    (at most ``PART``) stand before the next part too, marked by __copy.  So a window over
    (keys, __part) by place sees ``back`` rows before its own and never a whole series."""
    part, at = F.floor(F.col(pos) / PART), lambda p, copy: F.struct(p.alias("__part"), F.lit(copy).alias("__copy"))
    own = F.array(at(part, False))
    both = F.when(F.col(pos) % PART >= PART - back, F.array(at(part, False), at(part + 1, True))).otherwise(own) if back else own
    return df.select("*", F.inline(both))


def _with_earlier(df: DataFrame, totals: DataFrame, keys: list[str], earlier: list[Column]) -> DataFrame:
    """Rows with what the totals (a row for each part) say of the parts before: __t0, __t1, ..."""
    names, seen = [f"__of{i}" for i in range(len(keys))], [v.alias(f"__t{i}") for i, v in enumerate(earlier)]
    totals = totals.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("__part").alias("__p"), *seen)
    on = [*[F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)], F.col("__part") == F.col("__p")]
    return df.join(totals, on).drop("__p", *names)


def running_before(df: DataFrame, keys: list[str], pos: str, sums: dict[str, Column]) -> DataFrame:
    """Adds sums over the rows before each one in its series, in two levels: within the part
    (__part) by a window, and over the parts before by one over the parts' sums."""
    totals = df.groupBy(*keys, "__part").agg(*[F.sum(v).alias(f"__t{i}") for i, v in enumerate(sums.values())])
    before = Window.unboundedPreceding, -1
    w, parts, zero = over([*keys, "__part"], [pos]).rowsBetween(*before), over(keys, ["__part"]).rowsBetween(*before), F.lit(0).cast("long")
    out = _with_earlier(df.withColumns({name: F.sum(v).over(w) for name, v in sums.items()}), totals, keys, [F.sum(f"__t{i}").over(parts) for i in range(len(sums))])
    return out.withColumns({name: F.coalesce(name, zero) + F.coalesce(f"__t{i}", zero) for i, name in enumerate(sums)}).drop(*[f"__t{i}" for i in range(len(sums))])


def carried(df: DataFrame, keys: list[str], pos: str, values: dict[str, Column], ahead: bool = False) -> DataFrame:
    """Adds the last value that isn't null of the rows before each one (``ahead``: the first
    of those behind it) in its series, in the same two levels."""
    edge, turn, before = F.min_by if ahead else F.max_by, F.desc if ahead else F.col, (Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, "__part").agg(*[edge(v, F.when(v.isNotNull(), F.col(pos))).alias(f"__t{i}") for i, v in enumerate(values.values())])
    w, parts = over([*keys, "__part"], [turn(pos)]).rowsBetween(*before), over(keys, [turn("__part")]).rowsBetween(*before)
    out = _with_earlier(df.withColumns({name: F.last(v, True).over(w) for name, v in values.items()}), totals, keys, [F.last(f"__t{i}", True).over(parts) for i in range(len(values))])
    return out.withColumns({name: F.coalesce(name, f"__t{i}") for i, name in enumerate(values)}).drop(*[f"__t{i}" for i in range(len(values))])


def with_runs_by_part(df: DataFrame, keys: list[str], pos: str, by: list[str], out: str = "run_id") -> DataFrame:
    """W2 for rows with a place and its part."""
    rows = carried(df, keys, pos, {"__before": F.struct(*by)})
    rows = rows.withColumn("__start", F.when(F.struct(*by).eqNullSafe(F.col("__before")), 0).otherwise(1).cast("long"))
    return running_before(rows, keys, pos, {out: F.col("__start")}).withColumn(out, F.col(out) + F.col("__start")).drop("__start", "__before")


def with_runs(df: DataFrame, keys: list[str], order: list[str], by: list[str], out: str = "run_id") -> DataFrame:
    """Number of the run of neighbours with equal ``by`` (null equals null), from 1."""
    w = over(keys, order)
    same = F.struct(*by).eqNullSafe(F.lag(F.struct(*by)).over(w))
    start = F.when(F.row_number().over(w) == 1, 1).when(same, 0).otherwise(1)
    return df.withColumn("__start", start.cast("long")).withColumn(out, F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__start")


def runs(df: DataFrame, keys: list[str], order: list[str], by: list[str], ts: str) -> DataFrame:
    """(keys, run_id, by, n, i0, i1, start_ts, end_ts)."""
    rows = with_runs(with_position(df, keys, order, "__i"), keys, order, by)
    return rows.groupBy(*keys, "run_id", *by).agg(F.count(F.lit(1)).alias("n"), F.min("__i").alias("i0"), F.max("__i").alias("i1"), F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"))


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """Groups over many more tasks than cores, for grouped functions that take long: few share
    a task, and none are put together again (which goes by bytes, not by time)."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism), *keys)


def with_sequences(df: DataFrame, keys: list[str], order: list[str], ts: str, gap_s: float, out: str = "seq_id") -> DataFrame:
    """A new sequence where the step is longer than the gap (strictly), from 0."""
    w = over(keys, order)
    jump = (micros(ts) - F.lag(micros(ts)).over(w) > F.lit(round(gap_s * 1e6))).cast("long")
    return df.withColumn("__j", F.coalesce(jump, F.lit(0).cast("long"))).withColumn(out, F.sum("__j").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__j")


def cadence(df: DataFrame, keys: list[str], order: list[str], ts: str) -> DataFrame:
    """Upper median of the steps, in seconds."""
    from ..functions.stats import upper_median_of

    steps = df.withColumn("__dt", micros(ts) - F.lag(micros(ts)).over(over(keys, order))).filter("__dt is not null")
    return upper_median_of(steps, keys, "__dt", "__m").select(*keys, (F.col("__m") / 1e6).alias("cadence_s"))


def band_join(points: DataFrame, bands: DataFrame, keys: list[str], at: str, lo: str, hi: str, width: int, how: str = "inner") -> DataFrame:
    """Points within [lo, hi] of a band of the same series (whole numbers).

    Time is cut into cells of ``width``; bands are repeated for the cells they
    reach, so it is an equi join on series and cell."""
    cell = lambda x: F.floor(F.col(x) / F.lit(width))
    wide = bands.withColumn("__cell", F.explode(F.sequence(cell(lo), cell(hi))))
    wide = wide.select(*[F.col(k).alias(f"__{k}") for k in keys], *[x for x in wide.columns if x not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("__c") == F.col("__cell"), F.col(at).between(F.col(lo), F.col(hi))]
    return points.withColumn("__c", cell(at)).join(wide, on, how).drop("__c", "__cell", *[f"__{k}" for k in keys])


QS = (0.1, 0.25, 0.5, 0.75, 0.9)


def moving_quantiles(df: DataFrame, keys: list[str], ts: str, x: str, width_s: float, step_s: float, interval_s: float, min_cover: float = 0.5, qs=QS) -> DataFrame:
    """(keys, center_us, n, q): exact quantiles in windows closed at both ends
    around a grid of centres; windows with less than ``min_cover`` of the expected
    rows are left out."""
    half, step = round(width_s * 5e5), round(step_s * 1e6)
    points = df.withColumn("__t", micros(ts))
    span = points.groupBy(*keys).agg(F.min("__t").alias("__a"), F.max("__t").alias("__b"))
    fits = F.col("__a") + half <= F.col("__b") - half + 1
    grid = span.filter(fits).withColumn("center_us", F.explode(F.sequence(F.col("__a") + half, F.col("__b") - half + 1, F.lit(step).cast("long"))))
    bands = grid.select(*keys, "center_us", (F.col("center_us") - half).alias("__lo"), (F.col("center_us") + half).alias("__hi"))
    joined = band_join(points.select(*keys, "__t", F.col(x).alias("__x")), bands, keys, "__t", "__lo", "__hi", 2 * half)
    out = joined.groupBy(*keys, "center_us").agg(F.count("__x").alias("n"), quantile("__x", qs).alias("q"))
    return out.filter(F.col("n") >= F.lit(min_cover * width_s / interval_s))


def episodes(df: DataFrame, keys: list[str], at: str, x: str, threshold: float, step_us: int, min_us: int) -> DataFrame:
    """Neighbouring grid points with x >= threshold and steps of at most 1.5
    steps; (keys, start_us, end_us, duration_us, max_x), each end half a step wider."""
    w = over(keys, [at])
    high = df.filter(F.col(x) >= threshold)
    new = F.coalesce((F.col(at) - F.lag(at).over(w) > F.lit(int(1.5 * step_us))).cast("long"), F.lit(0).cast("long"))
    return _close(high.withColumn("__new", new), keys, at, x, step_us, min_us)


def _close(rows: DataFrame, keys: list[str], at: str, x: str, step_us: int, min_us: int) -> DataFrame:
    w = over(keys, [at]).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("__e", F.sum("__new").over(w)).groupBy(*keys, "__e").agg(F.min(at).alias("a"), F.max(at).alias("b"), F.max(x).alias("max_x"))
    out = out.withColumn("duration_us", F.col("b") - F.col("a") + F.lit(step_us)).filter(F.col("duration_us") >= min_us)
    half = F.lit(step_us // 2)
    return out.select(*keys, (F.col("a") - half).alias("start_us"), (F.col("b") + half).alias("end_us"), "duration_us", "max_x")


def moving_median(df: DataFrame, keys: list[str], order: list[str], x: str, width: int, out: str = "median") -> DataFrame:
    """Centred, odd width; the ends are padded with the first and last value."""
    h = width // 2
    w = over(keys, order)
    around, whole = w.rowsBetween(-h, h), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    i, n = F.row_number().over(w), F.count(F.lit(1)).over(whole)
    before, after = F.greatest(F.lit(0), h - i + 1), F.greatest(F.lit(0), (i + h - n).cast("int"))
    values = F.concat(F.array_repeat(F.first(x).over(whole), before), F.collect_list(x).over(around), F.array_repeat(F.last(x).over(whole), after))
    return df.withColumn(out, F.element_at(F.sort_array(values), h + 1))


def _array_quantile(values: Column, n: int, q: float) -> Column:
    """Quantile of a sorted array of n values."""
    pos = q * (n - 1)
    lo = int(pos)
    a = F.element_at(values, lo + 1)
    return a if lo == pos else a + (F.element_at(values, lo + 2) - a) * F.lit(pos - lo)


def causal_features(df: DataFrame, keys: list[str], order: list[str], x: str, widths: list[int], threshold: float) -> DataFrame:
    """For each width of last values (padded on the left with the first):
    p10, median, p90, median distance from the median, share above the threshold."""
    w = over(keys, order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = df
    for n in widths:
        missing = F.greatest(F.lit(0), F.lit(n) - F.row_number().over(w))
        values = F.concat(F.array_repeat(F.first(x).over(whole), missing), F.collect_list(x).over(w.rowsBetween(1 - n, 0)))
        out = out.withColumn("__v", F.sort_array(values)).withColumn("__m", _array_quantile(F.col("__v"), n, 0.5))
        away = F.sort_array(F.transform("__v", lambda v: F.abs(v - F.col("__m"))))
        out = out.withColumns({
            f"p10_{n}": _array_quantile(F.col("__v"), n, 0.1), f"median_{n}": F.col("__m"), f"p90_{n}": _array_quantile(F.col("__v"), n, 0.9),
            f"mad_{n}": _array_quantile(away, n, 0.5), f"above_{n}": F.size(F.filter("__v", lambda v: v > threshold)) / F.lit(float(n)),
        }).drop("__v", "__m")
    return out


def surrounding(df: DataFrame, keys: list[str], order: list[str], wanted: Column, value: str | Column) -> DataFrame:
    """Adds prev and next, the value at the nearest row before and after at
    which ``wanted`` holds (rows themselves not counted)."""
    v = F.when(wanted, c(value))
    # Both look back, one from each end: frames that reach forward are built anew for each row.
    back = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    ahead = lambda w: F.last(v, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumns({"prev": ahead(over(keys, order)), "next": ahead(back)})


def nearest_row(df: DataFrame, keys: list[str], ts: str, at: Column) -> DataFrame:
    """The row nearest to a time; of equals the earlier one."""
    best = F.min_by(F.struct(*df.columns), F.struct(F.abs(micros(ts) - at), micros(ts)))
    return df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(best.alias("r")).select("r.*")


def monotonic_times(df: DataFrame, keys: list[str], order: list[str], dt: str, start_s: int, out: str = "t") -> DataFrame:
    """Running sum of steps in whole seconds, moved up where it wouldn't grow."""
    w = over(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    i = F.row_number().over(over(keys, order)).cast("long")
    raw = F.round(F.sum(dt).over(w)).cast("long") + F.lit(start_s)
    return df.withColumn("__i", i).withColumn("__r", raw - F.col("__i")).withColumn(out, F.max("__r").over(w) + F.col("__i")).drop("__i", "__r")
