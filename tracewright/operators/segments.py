"""Segmentation by a sticky HDP-HMM and what is read off its states.

The model is in ``hmm``: chunks of blocks over many tasks.  Everything before and after is windows,
joins, and small functions over a block's states or runs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import bhattacharyya, micros, route_change_class, segment_class
from ..functions.stats import pooled
from ..scratch import settled
from . import hmm
from .windows import band_join, numbered, over, with_runs


def block_series(series: DataFrame, found: DataFrame, excluded: DataFrame | None, keys: list[str], ts: str, min_rows: int = 10, trim: float = 0.0, cell_us: int = 86_400_000_000) -> DataFrame:
    """Rows of each block (both ends inside, length among the block's lengths,
    not excluded), for blocks with enough rows; ``trim`` cuts above a percentile."""
    rows = series if excluded is None else series.join(excluded, [*keys, ts], "left_anti")
    bands = found.withColumns({"__lo": micros("start_ts"), "__hi": micros("end_ts")})
    inside = band_join(rows.withColumn("__t", micros(ts)), bands, keys, "__t", "__lo", "__hi", cell_us).drop("__lo", "__hi", "__t")
    if "lengths" in found.columns and "length" in series.columns:
        inside = inside.filter(F.array_contains("lengths", F.col("length")))
    w = Window.partitionBy(*keys, "block_id")
    if trim > 0:
        inside = inside.withColumn("__cut", F.percentile("rtt_ms", trim / 100).over(w)).filter("rtt_ms <= __cut").drop("__cut")
    return inside.withColumn("__n", F.count(F.lit(1)).over(w)).filter(F.col("__n") >= min_rows).drop("__n")


def sticky_hmm(y: np.ndarray, starts: list[int], k: int = 15, laps: int = 100, trans_alpha: float = 0.5, start_alpha: float = 10.0, kappa: float = 1000.0, sf: float = 1.0, seed: int = 0) -> np.ndarray:
    """O18 in memory: states of concatenated sequences (``starts`` are their first places)."""
    s = hmm.Setting(k, laps, trans_alpha, start_alpha, kappa, sf)
    near = y[hmm.drawn_places(len(y), s, seed)] - y.mean()
    return hmm.fit_alone(hmm.Unit(y - y.mean(), starts), near, hmm.width_of(float(y.std()), s, len(y)), s)


def linked(mean: np.ndarray, std: np.ndarray, limit: float = 0.5) -> np.ndarray:
    """Each state's class by complete linkage on Bhattacharyya distances up to
    ``limit``: the matrix of distances between classes has, for a union, the greater of its
    parts' rows.  Classes are numbered by the least mean of their states."""
    v = np.maximum(std, 1e-6) ** 2
    both = v[:, None] + v
    far = 0.25 * (mean[:, None] - mean) ** 2 / both + 0.5 * np.log(both / (2 * np.sqrt(v[:, None] * v)))
    np.fill_diagonal(far, np.inf)
    of = np.arange(len(mean))
    while far.size and far.min() <= limit:
        a, b = np.unravel_index(far.argmin(), far.shape)  # of equal distances the first pair
        far[a] = far[:, a] = np.maximum(far[a], far[b])
        far[b] = far[:, b] = np.inf
        of[of == b] = a
    least = np.full(len(mean), np.inf)
    np.minimum.at(least, of, mean)
    rank = np.empty(len(mean), np.int64)
    rank[np.argsort(least, kind="stable")] = np.arange(len(mean))
    return rank[of]


def fuse_states(y: np.ndarray, states: np.ndarray, limit: float = 0.5) -> np.ndarray:
    """O19 on arrays."""
    ids, at = np.unique(states, return_inverse=True)
    n = np.bincount(at)
    mean = np.bincount(at, y) / n
    return linked(mean, np.sqrt(np.bincount(at, (y - mean[at]) ** 2) / n), limit)[at]


def smooth_runs(size: np.ndarray, value: np.ndarray, dwell: int, passes: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """O21 on run lengths: runs shorter than ``dwell`` take the value of the longer
    neighbour (left if equal) as it was when the pass began; until nothing is short or 20 passes."""
    for _ in range(passes if dwell > 1 else 0):
        short = size < dwell
        if len(size) <= 1 or not short.any():
            break
        left, right = np.concatenate([[-1], size[:-1]]), np.concatenate([size[1:], [-1]])
        near = np.where(left >= right, np.roll(value, 1), np.roll(value, -1))
        value = np.where(short, near, value)
        first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        size, value = np.add.reduceat(size, first), value[first]
    return size, value


def smooth_states(states: np.ndarray, dwell: int) -> np.ndarray:
    """O21 on states."""
    s = np.array(states)
    if not len(s):
        return s
    first = np.concatenate([[0], np.flatnonzero(np.diff(s)) + 1])
    size, value = smooth_runs(np.diff(np.append(first, len(s))), s[first], dwell)
    return np.repeat(value, size)


def fused(moments: DataFrame, limit: float | None) -> DataFrame:
    """(id, run, macros: each raw state's class) of ``hmm.moments``; a row a state goes in."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf["state"].to_numpy(np.int64)
        out = np.full(at.max() + 1, -1)
        order = np.argsort(at)
        m, sd = (pdf[c].to_numpy(float)[order] for c in ("m", "sd"))
        out[at[order]] = at[order] if limit is None else linked(m, sd, limit)
        return pd.DataFrame({"id": [pdf["id"].iloc[0]], "run": [pdf["run"].iloc[0]], "macros": [out]})

    return moments.groupBy("id", "run").applyInPandas(run, "id string, run int, macros array<long>")


def placed(rows: DataFrame, keys: list[str], order: list[str], x: str, sequence: str | None = None) -> DataFrame:
    """Settled rows with __id (their series), __pos, __head (begins a sequence) and __y."""
    one = rows.withColumns({"__id": F.to_json(F.struct(*keys)), "__y": F.col(x).cast("double")})
    if sequence:  # a range sort reads its rows twice, and sequences come out of windows
        one = settled(one, "sequences")
    at = numbered(one, "__id", [*([sequence] if sequence else []), *order], "__pos")
    first = F.col("__pos") == 0
    if sequence:
        first = F.coalesce(F.col(sequence) != F.lag(sequence).over(Window.partitionBy("__id").orderBy("__pos")), F.lit(True))
    return settled(at.withColumn("__head", first), "numbered")


def fitted(at: DataFrame, settings: list[hmm.Setting], seeds: list[int], chunk: int = hmm.CHUNK, taken: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """O18 over ``placed`` rows: ``hmm.fit``."""
    return hmm.fit(at.select(F.col("__id").alias("id"), F.col("__pos").alias("pos"), F.col("__y").alias("y"), F.col("__head").alias("head")), settings, seeds, chunk, taken)


def smoothed_runs(states: DataFrame, by: list[str], order: str, state: str, dwell: int) -> DataFrame:
    """O21 on runs: (by, i0, n, state) with i0 the first ``order`` of each run, smoothed and
    put together.  Rows become runs in a window; only runs meet in a group."""
    runs_ = with_runs(states, by, [order], [state], "__r").groupBy(*by, "__r").agg(F.min(order).alias("i0"), F.count(F.lit(1)).alias("n"), F.first(state).alias("state"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i0")
        size, value = smooth_runs(pdf["n"].to_numpy(np.int64), pdf["state"].to_numpy(np.int64), dwell)
        begin = int(pdf["i0"].iloc[0]) + np.concatenate([[0], np.cumsum(size)[:-1]])
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(size) for k in by}, "i0": begin, "n": size, "state": value})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in states.schema if f.name in by)
    return runs_.drop("__r").groupBy(*by).applyInPandas(run, f"{kinds}, i0 long, n long, state long")


def model_states(rows: DataFrame, keys: list[str], order: list[str], x: str, dwell: int = 3, fuse: float | None = 0.5, chunk: int = hmm.CHUNK, seed: int = 0, **model) -> DataFrame:
    """Adds state_raw and state; rows carry block_id and seq_id.  Sequences
    with one row are left out.  A block may span many tasks; fusing sees its states and
    smoothing its runs only."""
    by = [*keys, "block_id"]
    long = rows.withColumn("__m", F.count(F.lit(1)).over(Window.partitionBy(*by, "seq_id"))).filter("__m >= 2").drop("__m")
    at = placed(long, by, order, x, "seq_id")
    states, table = fitted(at, [hmm.Setting(**model)], [seed], chunk)
    each = states.join(fused(hmm.moments(states, table), fuse), ["id", "run"]).select(F.col("id").alias("__i"), "macros", F.col("chunk").alias("__c"), F.posexplode("states").alias("__p", "__s"))
    each = each.select("__i", (F.col("__c") * chunk + F.col("__p")).alias("__q"), F.col("__s").cast("long").alias("state_raw"), F.get("macros", F.col("__s").cast("int")).alias("macro"))
    told = settled(at.join(each, (F.col("__id") == F.col("__i")) & (F.col("__pos") == F.col("__q"))).drop("__i", "__q", "__y", "__head"), "states")
    found = smoothed_runs(told.select("__id", "seq_id", "__pos", "macro"), ["__id", "seq_id"], "__pos", "macro", dwell)
    bands = found.select("__id", F.col("i0").alias("__lo"), (F.col("i0") + F.col("n") - 1).alias("__hi"), "state")
    return band_join(told.drop("macro"), bands, ["__id"], "__pos", "__lo", "__hi", 4096).select(*rows.columns, "state_raw", "state")


def smoothed(rows: DataFrame, keys: list[str], order: list[str], state: str, dwell: int) -> DataFrame:
    """O21 on given states (whole numbers), per sequence."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pdf.assign(state=smooth_states(pdf[state].to_numpy(), dwell).astype("int64"))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "state") + ", state long"
    return rows.groupBy(*keys).applyInPandas(run, schema)


def change_points(rows: DataFrame, keys: list[str], order: list[str], state: str) -> DataFrame:
    """Rows whose state differs from the one before."""
    return rows.withColumn("prev_state", F.lag(state).over(over(keys, order))).filter(F.col("prev_state") != F.col(state))


def segments(rows: DataFrame, keys: list[str], order: list[str], state: str, x: str, ts: str, interval_s: float) -> DataFrame:
    """Runs of one state with their statistics; minutes are n times the interval."""
    r = with_runs(rows, keys, order, [state], "segment_id")
    out = r.groupBy(*keys, "segment_id", state).agg(
        F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.percentile(x, 0.5).alias("median"),
        F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
    )
    return out.withColumn("minutes", F.col("n") * F.lit(interval_s) / 60)


def references(rows: DataFrame, ref_keys: list[str], x: str) -> DataFrame:
    """P25 of each reference key."""
    return rows.groupBy(*ref_keys).agg(F.percentile(x, 0.25).alias("reference"))


def label_segments(segs: DataFrame, refs: DataFrame, ref_keys: list[str]) -> DataFrame:
    """Deviation of the median from the reference, and the class."""
    out = segs.join(refs, ref_keys, "left").withColumn("deviation", F.col("median") - F.col("reference"))
    return out.withColumn("kind", segment_class("minutes", "deviation"))


def group_segments(labelled: DataFrame, keys: list[str], order: list[str], by: list[str]) -> DataFrame:
    """Neighbouring segments of one kind and reference key, put together."""
    mean, std = pooled("n", "mean", "std")
    rows = with_runs(labelled, keys, order, by, "group_id")
    largest = F.max_by("median", F.struct(F.col("n"), -F.col("segment_id")))
    return rows.groupBy(*keys, "group_id", *by).agg(
        F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.sum("n").alias("n"), F.sum("minutes").alias("minutes"), mean.alias("mean"), largest.alias("median"), std.alias("std"),
        F.min("min").alias("min"), F.max("max").alias("max"), F.count(F.lit(1)).alias("n_segments"),
    )


def route_changes(members: DataFrame, keys: list[str], order: list[str], x: str, window: int = 10) -> DataFrame:
    """Change of level between neighbouring blocks: medians of the last and
    first ``window`` rows, or as many as the shorter block has.
    members: rows with block_id (consecutive numbers)."""
    by = [*keys, "block_id"]
    w = over(by, order)
    rows = members.withColumns({"__first": F.row_number().over(w), "__n": F.count(F.lit(1)).over(Window.partitionBy(*by))})
    rows = rows.withColumn("__last", F.col("__n") - F.col("__first") + 1)
    size = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(order[0]).alias("start_ts"))
    ahead = size.select(*keys, (F.col("block_id") - 1).alias("block_id"), F.col("n").alias("n_next"), "start_ts")
    borders = size.drop("start_ts").join(ahead, by).withColumn("k", F.least(F.lit(window), "n", "n_next"))
    before = rows.join(borders, by).filter("__last <= k").groupBy(*by).agg(F.percentile(x, 0.5).alias("before_ms"))
    first = borders.select(*keys, (F.col("block_id") + 1).alias("block_id"), "k")
    after = rows.join(first, by).filter("__first <= k").groupBy(*keys, (F.col("block_id") - 1).alias("block_id")).agg(F.percentile(x, 0.5).alias("after_ms"))
    out = borders.join(before, by).join(after, by).withColumn("delta_ms", F.col("after_ms") - F.col("before_ms"))
    return out.select(*keys, "block_id", (F.col("block_id") + 1).alias("next_block_id"), F.col("start_ts").alias("ts"), "before_ms", "after_ms", "delta_ms", F.col("k").alias("window"), route_change_class("delta_ms").alias("kind"))


def route_change_columns(changes: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Lengths and paths on both sides of each route change.
    found: blocks with block_id, length and path (an array)."""
    side = lambda id_, name: found.select(*keys, F.col("block_id").alias(id_), F.col("length").alias(f"longitud_{name}"), F.col("path").alias(f"ruta_{name}"))
    out = changes.join(side("block_id", "anterior"), [*keys, "block_id"], "left").join(side("next_block_id", "siguiente"), [*keys, "next_block_id"], "left")
    return out.withColumn("delta_saltos", F.col("longitud_siguiente") - F.col("longitud_anterior"))


def state_distances(rows: DataFrame, keys: list[str], state: str, x: str) -> DataFrame:
    """Bhattacharyya distance of each pair of a group's states."""
    s = rows.groupBy(*keys, F.col(state).alias("a")).agg(F.avg(x).alias("ma"), F.stddev_pop(x).alias("sa"))
    t = s.select(*keys, F.col("a").alias("b"), F.col("ma").alias("mb"), F.col("sa").alias("sb"))
    joined = s.join(t, [F.col("a") < F.col("b")] if not keys else keys).filter("a < b")  # one row a state
    return joined.select(*keys, "a", "b", bhattacharyya("ma", "sa", "mb", "sb").alias("distance"))


def variance_quality(segs: DataFrame, keys: list[str]) -> DataFrame:
    """Variance within and between segments and their ratio."""
    total = F.sum("n")
    within = F.sum(F.col("n") * F.col("std") * F.col("std")) / total
    mu = F.sum(F.col("n") * F.col("mean")) / total
    between = F.greatest(F.sum(F.col("n") * F.col("mean") * F.col("mean")) / total - mu * mu, F.lit(0.0))
    return segs.groupBy(*keys).agg(within.alias("within"), between.alias("between")).withColumn("ratio", F.try_divide(F.col("between"), F.col("within")))


def topology_near(points: DataFrame, events: DataFrame, keys: list[str], ts: str, ordinal: str, minutes: float = 15.0) -> DataFrame:
    """Change points with the first (by ordinal) event within some minutes."""
    half = round(minutes * 6e7)
    bands = events.select(*keys, F.col(ordinal).alias("__o"), "categoria", (micros(ts) - half).alias("__lo"), (micros(ts) + half).alias("__hi"))
    own = points.select(*keys, micros(ts).alias("__t")).distinct()
    near = band_join(own, bands, keys, "__t", "__lo", "__hi", 2 * half).groupBy(*keys, "__t").agg(F.min_by("categoria", "__o").alias("category"))
    out = points.withColumn("__t", micros(ts)).join(near, [*keys, "__t"], "left").drop("__t")
    return out.withColumn("topological", F.col("category").isNotNull())
