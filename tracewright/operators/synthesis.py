"""Synthetic series with known truth (O31-O38): levels, pools, resampling, steps."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import robust_sigma, upper_median_of
from ..scratch import settled
from .windows import band_join, in_parts, numbered, over, running_before, with_position

#: Defaults of the design.
DELTAS, HOURS, REPEATS = (2.0, 3.0, 5.0, 10.0, 20.0), (1.0, 6.0, 48.0), 2


class RunningMedian:
    """Median of the values so far: the lower half in one heap, the upper in another."""

    def __init__(self, values: np.ndarray):
        self.low: list[float] = []  # negated
        self.high: list[float] = []
        for x in values.tolist():
            self.add(x)

    def add(self, x: float) -> None:
        heapq.heappush(self.high, -heapq.heappushpop(self.low, -x))
        if len(self.high) > len(self.low):
            heapq.heappush(self.low, -heapq.heappop(self.high))

    def value(self) -> float:
        return -self.low[0] if len(self.low) > len(self.high) else (self.high[0] - self.low[0]) / 2


def level_starts(m: np.ndarray, threshold: float, dwell: int) -> list[int]:
    """Where levels begin.  The least and greatest of the next ``dwell`` values say at
    once whether they all lie over or under the median of the level so far."""
    ahead = np.lib.stride_tricks.sliding_window_view(m, dwell)
    least, most = ahead.min(axis=1), ahead.max(axis=1)
    starts, so_far, t = [0], RunningMedian(m[:dwell]), dwell
    while t < len(ahead):
        level = so_far.value()
        side = int(least[t] - level >= threshold) - int(level - most[t] >= threshold)
        if not side:
            so_far.add(float(m[t]))
            t += 1
            continue
        near = np.flatnonzero(side * (m[starts[-1] : t] - level) < threshold)
        begin = starts[-1] + int(near[-1]) + 1  # some value is near the median of all
        starts.append(begin)
        so_far, t = RunningMedian(m[begin : begin + dwell]), begin + dwell
    return starts


def segment_levels(y: np.ndarray, width: int = 9, threshold: float = 1.5, dwell: int = 5) -> np.ndarray:
    """Level of each value.  A level ends where the moving median and the next
    ``dwell`` - 1 all lie ``threshold`` or more away on one side; the new one begins
    as far back as that held."""
    if len(y) < 2 * dwell:
        return np.full(len(y), np.median(y) if len(y) else np.nan)
    half = max(3, width | 1) // 2
    m = np.median(np.lib.stride_tricks.sliding_window_view(np.pad(y, half, mode="edge"), 2 * half + 1), axis=1)
    parts = np.split(y, level_starts(m, threshold, dwell)[1:])
    return np.concatenate([np.full(len(p), np.median(p)) for p in parts])


def with_levels(rows: DataFrame, keys: list[str], order: list[str], x: str, **how) -> DataFrame:
    """O31 for all series: adds level and residual (grouped function; sequential)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        level = segment_levels(pdf[x].to_numpy(float), **how)
        return pdf.assign(level=level, residual=pdf[x].to_numpy(float) - level)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", level double, residual double"
    return rows.groupBy(*keys).applyInPandas(run, schema)


def pool(levelled: DataFrame, keys: list[str], spike_min: float = 3.0, k_spike: float = 6.0, degraded_ms: float = 2.0, min_rows: int = 200) -> DataFrame:
    """Base level, base regime and spikes of series with enough rows."""
    n = levelled.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.percentile("level", 0.1).alias("__b0")).filter(F.col("__n") >= min_rows)
    rows = levelled.join(n, keys)
    base = rows.filter(F.col("level") < F.col("__b0") + 2).groupBy(*keys).agg(F.percentile("level", 0.5).alias("__b"))
    sigma = robust_sigma(levelled, keys, "residual", "__s")
    rows = rows.join(base, keys, "left").join(sigma, keys).withColumn("base", F.coalesce("__b", "__b0"))
    limit = F.greatest(F.lit(spike_min), F.lit(k_spike) * F.col("__s"))
    return rows.withColumns({"base_regime": F.col("level") - F.col("base") < degraded_ms, "spike": F.col("residual") > limit}).drop("__n", "__b0", "__b", "__s")


def densest_band(values: np.ndarray, width: float = 1.99) -> tuple[float, float]:
    """O32, crude mode: the first of the bands of levels that hold most values."""
    v = np.sort(values)
    counts = np.searchsorted(v, v + width, "left") - np.arange(len(v))
    lo = float(v[int(counts.argmax())])
    return lo - 1e-9, lo + width


def acf(segments: list[np.ndarray], lags: int) -> np.ndarray:
    """A17 in memory, for choosing a block length."""
    every = np.concatenate(segments)
    mu, var = every.mean(), every.var()
    out = np.full(lags, np.nan)
    for k in range(1, lags + 1):
        pairs = [(s[:-k] - mu) * (s[k:] - mu) for s in segments if len(s) > k]
        if var > 0 and pairs:
            out[k - 1] = np.concatenate(pairs).mean() / var
    return out


def resample_plan(spans: list[tuple[int, int]], n: int, length: int, seed: int, whole_blocks: bool = True) -> pd.DataFrame:
    """Moving-block plan (idx, src_idx, seam): random starts with replacement.
    spans: contiguous stretches of the pool as [first, last + 1)."""
    rng = np.random.default_rng(seed)
    starts = np.concatenate([np.arange(a, max(a, b - length) + (1 if not whole_blocks or b - a >= length else 0)) for a, b in spans])
    if not len(starts):
        starts = np.array([a for a, _ in spans])
    ends = {a: b for a, b in spans}
    first = np.array(sorted(ends))
    src, seam = [], []
    while len(src) < n:
        s = int(rng.choice(starts))
        stop = min(s + length, ends[int(first[np.searchsorted(first, s, "right") - 1])])
        seam += [len(src) > 0] + [False] * (stop - s - 1)
        src += range(s, stop)
    return pd.DataFrame({"idx": np.arange(n), "src_idx": np.array(src[:n], np.int64), "seam": seam[:n]})


def choose_length(x: np.ndarray, spans: list[tuple[int, int]], candidates: list[int], lags: int, seed: int, tolerance: float = 0.05) -> int:
    """The shortest block length whose resampled correlations stay within the
    tolerance of the pool's, else the nearest."""
    real = acf([x[a:b] for a, b in spans], lags)
    best = (np.inf, candidates[-1])
    for length in sorted(candidates):
        plan = resample_plan(spans, len(x), length, seed)
        gap = float(np.nanmax(np.abs(acf([x[plan["src_idx"].to_numpy()]], lags) - real)))
        if gap <= tolerance:
            return length
        best = min(best, (gap, length))
    return best[1]


def apply_plan(pool_rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of the pool in the order of a plan (both with src_idx)."""
    return plan.join(pool_rows, "src_idx")


def drawn(below, *what) -> Column:
    """A number under ``below`` that only depends on ``what`` (text of it, md5): draws
    that are the same on every executor and every run."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(w).cast("string") if isinstance(w, str) else w for w in what])), 1, 12), 16, 10).cast("long"), F.greatest(below, F.lit(1)))


def chosen_draws(src: DataFrame, keys: list[str], length: int, seed: int, spike: str, fail: str, tries: int = 30, tolerance: float = 0.25) -> DataFrame:
    """(keys, attempt, deviation): the first of ``tries`` draws whose shares of spikes
    and of failures are within ``tolerance`` of the series' own (relative; a share that is
    nothing must stay under 0.001), else the nearest, the first of equals.
    src: (keys, src_idx, and the two flags).

    Draws are a dimension: a block's counts are differences of running counts, so a draw
    costs a row a block, not a row a row."""
    w = over(keys, ["src_idx"])
    run = src.select(*keys, F.col("src_idx").alias("__at"), *[(F.sum(F.col(c).cast("long")).over(w)).alias(n) for c, n in ((spike, "__s"), (fail, "__f"))])
    size = run.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.max("__s").alias("__ns"), F.max("__f").alias("__nf"))
    blocks = size.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(tries)))).withColumn("__b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / length))))
    blocks = blocks.withColumn("__first", _start(F.col("__n"), length, seed, keys))
    rows = F.least(F.lit(length).cast("long"), F.col("__n") - F.col("__b") * length, F.col("__n") - F.col("__first"))
    blocks = blocks.withColumns({"__k": rows, "__last": F.col("__first") + rows - 1, "__before": F.col("__first") - 1})
    at = lambda at_, s, f: run.select(*keys, F.col("__at").alias(at_), F.col("__s").alias(s), F.col("__f").alias(f))
    both = blocks.join(at("__last", "__s1", "__f1"), [*keys, "__last"]).join(at("__before", "__s0", "__f0"), [*keys, "__before"], "left")
    zero = F.lit(0).cast("long")
    told = both.groupBy(*keys, "attempt").agg(F.sum("__k").alias("__k"), *[F.sum(F.col(f"__{c}1") - F.coalesce(f"__{c}0", zero)).alias(f"__{c}") for c in "sf"], *[F.first(c).alias(c) for c in ("__n", "__ns", "__nf")])

    def off(c: str) -> Column:
        own, got = F.col(f"__n{c}") / F.col("__n"), F.col(f"__{c}") / F.col("__k")
        return F.when(own > 1e-9, F.abs(got - own) / own).when(got < 1e-3, 0.0).otherwise(1.0)

    told = told.withColumn("deviation", F.greatest(off("s"), off("f")))
    best = F.min(F.struct((F.col("deviation") > tolerance).alias("o"), F.when(F.col("deviation") > tolerance, F.col("deviation")).otherwise(0.0).alias("d"), "attempt", "deviation")).alias("t")
    return told.groupBy(*keys).agg(best).select(*keys, F.col("t.attempt").alias("attempt"), F.col("t.deviation").alias("deviation"))


def _start(n: Column, length: int, seed: int, keys: list[str]) -> Column:
    """First row of block __b in a draw (column attempt)."""
    return drawn(n - length + 1, F.lit(seed), *keys, "__b", "attempt")


def resampled(rows: DataFrame, keys: list[str], order: list[str], x: str, t: str, length: int, seed: int, level: str | None = None, spike: str | None = None, fail: str | None = None, tries: int = 30) -> DataFrame:
    """O34 for all series at once: (keys, idx, src_idx, seam, dt_us, x, jump).

    A series of n rows is drawn again as blocks of ``length`` neighbouring rows with
    starts drawn with replacement; only the blocks' starts are planned, and exploded to
    rows where they run.  With flags of spikes and failures the draw is the one that
    ``chosen_draws`` names, else the first.  Inside a block the real time step is kept; a
    block's first step is drawn from the series' steps of half to one and a half of the
    upper median (which stands in if there are none).  jump: step of the level at a seam
    (null elsewhere).  Rows are numbered and stepped by parts: no task sorts a series."""
    flags = [F.col(c).alias(n) for c, n in ((spike, "__spike"), (fail, "__fail")) if c]
    placed = numbered(rows.select(*keys, *[F.col(o).alias(f"__o{i}") for i, o in enumerate(order)], F.unix_micros(F.col(t).cast("timestamp")).alias("__t"), F.col(x).alias("__x"), F.col(level or x).alias("__l"), *flags), keys, [f"__o{i}" for i in range(len(order))], "src_idx")
    part = Window.partitionBy(*keys, "__part").orderBy("src_idx")
    src = in_parts(placed, "src_idx", 1).withColumn("__dt", F.col("__t") - F.lag("__t").over(part)).filter("not __copy")
    src = settled(src.select(*keys, "src_idx", "__part", "__x", "__l", "__dt", *[n for n in ("__spike", "__fail") if n in placed.columns]), "source")
    middle = settled(upper_median_of(src.filter("__dt is not null"), keys, "__dt", "__mid"), "steps")
    usual = src.join(middle, keys).filter((F.col("__dt") > 0.5 * F.col("__mid")) & (F.col("__dt") < 1.5 * F.col("__mid")))
    usual = running_before(usual.select(*keys, "__part", "src_idx", F.col("__dt").alias("__drawn")), keys, "src_idx", {"__k": F.lit(1).cast("long")}).select(*keys, "__k", "__drawn")
    size = src.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).join(usual.groupBy(*keys).agg(F.count(F.lit(1)).alias("__m")), keys, "left").join(middle, keys, "left")
    if len(flags) == 2:
        size = size.join(chosen_draws(src, keys, length, seed, "__spike", "__fail", tries).drop("deviation"), keys)
    else:
        size = size.withColumn("attempt", F.lit(1))
    blocks = size.withColumn("__b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / length))))
    blocks = blocks.withColumns({"__start": _start(F.col("__n"), length, seed, keys), "__k": drawn(F.coalesce("__m", F.lit(1)), F.lit(seed), *keys, "__b", F.lit("dt"))})
    # A series has one row of sizes: its blocks are dealt out before they become rows.
    blocks = blocks.repartition(*keys, "__k").join(usual, [*keys, "__k"], "left")
    plan = blocks.withColumn("__o", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(length - 1).cast("long")))).withColumns({"idx": F.col("__b") * length + F.col("__o"), "src_idx": F.col("__start") + F.col("__o")})
    plan = plan.filter((F.col("idx") < F.col("__n")) & (F.col("src_idx") < F.col("__n"))).select(*keys, "idx", "src_idx", "__o", "__drawn", "__mid")
    out = plan.join(src.drop("__part"), [*keys, "src_idx"]).withColumn("seam", (F.col("__o") == 0) & (F.col("idx") > 0))
    dt = F.when(F.col("__o") > 0, F.col("__dt")).otherwise(F.coalesce("__drawn", "__mid"))
    out = in_parts(out.select(*keys, "idx", "src_idx", "seam", dt.alias("dt_us"), F.col("__x").alias(x), "__l"), "idx", 1)
    jump = F.when(F.col("seam"), F.col("__l") - F.lag("__l").over(Window.partitionBy(*keys, "__part").orderBy("idx")))
    return out.withColumn("jump", jump).filter("not __copy").select(*keys, "idx", "src_idx", "seam", "dt_us", x, "jump")


def step_design(series: DataFrame, keys: list[str], seed: int, deltas=DELTAS, hours=HOURS, repeats: int = REPEATS, separation_h: float = 12.0, margin_h: float = 12.0, severe_ms: float = 5.0) -> DataFrame:
    """A design of steps for each series (keys, cycles_per_h, path_length):
    (keys, i0, i1, delta_ms, hop, kind).

    Every cell of the factorial is a row; its place in the series is the rank of a hash
    draw.  A gap (the separation, up to half as long again) goes before each step, so a
    step begins behind the gaps and lengths of those before it: a running sum."""
    cells = F.array(*[F.struct(F.lit(float(d)).alias("delta_ms"), F.lit(float(h)).alias("h"), F.lit(r).alias("rep")) for d in deltas for h in hours for r in range(repeats)])
    each = series.select(*keys, "cycles_per_h", "path_length", F.explode(cells).alias("cell")).select("*", "cell.*").drop("cell")
    draw = lambda below, what: drawn(below, F.lit(seed), *keys, F.col("delta_ms").cast("int"), F.col("h").cast("int"), "rep", F.lit(what))
    part, first = F.lit(1 << 20), F.greatest(F.lit(2), F.col("path_length") - 3)
    each = each.withColumns({
        "n": F.greatest(F.lit(1), F.round(F.col("h") * F.col("cycles_per_h")).cast("long")), "gap": F.round(separation_h * F.col("cycles_per_h") * (1 + draw(part, "gap") / (2.0 * (1 << 20)))).cast("long"),
        "hop": (first + draw(F.col("path_length") - first + 1, "hop")).cast("int"), "place": draw(F.lit(1 << 40), "place"),
    })
    w = over(keys, ["place", "delta_ms", "h", "rep"])
    i0 = F.round(margin_h * F.col("cycles_per_h")).cast("long") + F.sum(F.col("gap") + F.col("n")).over(w) - F.col("n")
    kind = F.when(F.col("delta_ms") >= severe_ms, "severa").otherwise("moderada")
    return each.select(*keys, i0.alias("i0"), (i0 + F.col("n") - 1).alias("i1"), "delta_ms", "hop", kind.alias("kind"))


def inject_steps(hops: DataFrame, plan: DataFrame, keys: list[str], idx: str = "idx", base: str | None = None, level: str | None = None, length: str | None = None, spike: str | None = None, floor_ms: float = 0.01) -> DataFrame:
    """Adds each step's delta to hops at or beyond its hop; rows carry the truth
    (delta_ms, regimen).  plan: keys, i0, i1, delta_ms, hop, kind; steps don't overlap.

    In this order: with ``spike`` (a row's excess, 0 if none) the last hop (``length``)
    loses it; with ``base`` and ``level`` (residual mode) hops from three before the last
    on move from their level to the base, never under ``floor_ms``; then the step."""
    steps = plan.withColumnRenamed("hop", "__at")
    out = band_join(hops, steps.withColumns({"__lo": F.col("i0"), "__hi": F.col("i1")}), keys, idx, "__lo", "__hi", 256, "left").drop("__lo", "__hi", "i0", "i1")
    value = F.col("rtt_ms")
    if spike:
        value = F.when(F.col("hop") == F.col(length), value - F.col(spike)).otherwise(value)
    if base and level:
        value = F.when(F.col("hop") >= F.greatest(F.lit(2), F.col(length) - 3), F.greatest(value + F.col(base) - F.col(level), F.lit(floor_ms))).otherwise(value)
    reached = F.col("hop") >= F.col("__at")
    return out.withColumns({
        "rtt_ms": value + F.when(reached, F.col("delta_ms")).otherwise(0.0), "regimen": F.coalesce("kind", F.lit("base")), "delta_ms": F.coalesce("delta_ms", F.lit(0.0)),
    }).drop("__at", "kind")


def simple_design(cyc: DataFrame, keys: list[str], changes: int, duration: int, seed: int, buffer: int = 5) -> DataFrame:
    """(keys, evento_id, i0, i1): changes more than ``buffer`` cycles apart.  Sorted
    hash draws over the room that is left, each moved behind the changes before it; a
    series without that room has none."""
    step = duration + buffer + 1
    room = cyc.groupBy(*keys).agg((F.count(F.lit(1)) - (changes * step - buffer - 1)).alias("__room")).filter("__room >= 0")
    each = room.withColumn("__e", F.explode(F.sequence(F.lit(1), F.lit(changes)))).withColumn("__d", drawn(F.col("__room") + 1, F.lit(seed), *keys, "__e", F.lit("change")))
    n = F.row_number().over(over(keys, ["__d", "__e"]))
    i0 = (F.col("__d") + (n - 1) * step).cast("long")
    return each.select(*keys, n.alias("evento_id"), i0.alias("i0"), (i0 + duration - 1).alias("i1"))


def inject_simple(cyc: DataFrame, plan: DataFrame, keys: list[str], order: list[str], delta_ms: float) -> DataFrame:
    """Adds delta_ms to the last hop's value within the changes; evento_id names them."""
    placed = with_position(cyc, keys, order, "__i")
    rows = band_join(placed, plan, keys, "__i", "i0", "i1", 256, "left").drop("__i", "i0", "i1")
    return rows.withColumn("last_rtt", F.when(F.col("evento_id").isNotNull(), F.col("last_rtt") + delta_ms).otherwise(F.col("last_rtt")))


def simple_truth(injected: DataFrame, keys: list[str], ts: str, delta_ms: float, digits: int = 3) -> DataFrame:
    """The truth of ``inject_simple``: a row for each change; means are rounded once, to ``digits``."""
    mean = F.avg(F.col("last_rtt") - delta_ms)
    return injected.filter("evento_id is not null").groupBy(*keys, "evento_id").agg(
        F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count(F.lit(1)).alias("duration_cycles"), F.round(mean, digits).alias("original_mean_rtt_ms"),
        F.round(mean + delta_ms, digits).alias("injected_mean_rtt_ms"), F.lit(float(delta_ms)).alias("magnitude_injected_ms"),
    )


def realism(real: DataFrame, synthetic: DataFrame, keys: list[str], real_order: list[str], order: list[str], x: str, tolerances: dict[str, float], spike_ms: float = 3.0) -> DataFrame:
    """(keys, metrica, pool_real, sintetico, estado): quantiles, mean, spread, robust
    sigma, correlation of neighbours and share of spikes (over the median by more than
    ``spike_ms`` and six sigma) of both, each with its tolerance ('' for the others)."""

    def summary(df: DataFrame, by: list[str], name: str) -> DataFrame:
        qs = (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)
        one = df.groupBy(*keys).agg(F.percentile(x, F.array(*[F.lit(q) for q in qs])).alias("q"), F.avg(x).alias("m"), F.stddev_pop(x).alias("s")).join(robust_sigma(df, keys, x, "sigma"), keys)
        pairs = df.withColumn("__next", F.lead(x).over(over(keys, by))).join(one, keys)
        more = pairs.groupBy(*keys).agg(
            F.try_divide(F.avg((F.col(x) - F.col("m")) * (F.col("__next") - F.col("m"))), F.first(F.col("s") * F.col("s"))).alias("acf1"),
            F.avg((F.col(x) - F.col("q")[2] > F.greatest(F.lit(spike_ms), 6 * F.col("sigma"))).cast("double")).alias("spikes"),
        )
        cells = [F.struct(F.lit(f"p{round(100 * q)}").alias("k"), F.col("q")[i].alias("v")) for i, q in enumerate(qs)]
        cells += [F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in (("media", "m"), ("std", "s"), ("sigma_robusta", "sigma"), ("acf1", "acf1"), ("tasa_picos", "spikes"))]
        return one.join(more, keys).select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, F.col("c.k").alias("metrica"), F.col("c.v").alias(name))

    both = summary(real, real_order, "pool_real").join(summary(synthetic, order, "sintetico"), [*keys, "metrica"])
    limit = F.lit(float(tolerances.get("", 1.0)))
    for k, v in tolerances.items():
        limit = F.when(F.col("metrica") == k, float(v)).otherwise(limit)
    return both.withColumn("estado", F.when(F.abs(F.col("pool_real") - F.col("sintetico")) <= limit, "OK").otherwise("REVISAR"))


def truth_changes(truth: DataFrame, keys: list[str], order: list[str], level: str, min_step: float = 0.05, delta_ms: float = 2.0, min_plateau: int = 5) -> DataFrame:
    """Boundaries where the true level moves: kind is bajo_umbral under
    ``delta_ms``, estructural if a plateau beside it is short, else evaluable."""
    w = over(keys, order)
    rows = truth.withColumns({"__i": F.row_number().over(w).cast("long") - 1, "step": F.col(level) - F.lag(level).over(w)})
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    cuts = rows.filter(F.abs("step") >= min_step).join(n, keys)
    v = over(keys, ["__i"])
    left = F.col("__i") - F.coalesce(F.lag("__i").over(v), F.lit(0))
    right = F.coalesce(F.lead("__i").over(v), F.col("__n")) - F.col("__i")
    kind = F.when(F.abs("step") < delta_ms, "bajo_umbral").when(F.least(left, right) < min_plateau, "estructural").otherwise("evaluable")
    return cuts.withColumns({"left": left, "right": right, "kind": kind}).drop("__i", "__n")
