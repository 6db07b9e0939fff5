"""Scoring detections and labels against truth, and utility of synthetic data."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import is_ambiguous, micros, segment_class
from ..functions.stats import auroc, average_precision, precision_recall
from ..scratch import settled
from . import logistic
from .windows import band_join, over, with_runs


def match_nearest(a: np.ndarray, b: np.ndarray, tolerance: float) -> list[tuple[int, int]]:
    """One-to-one, nearest pairs first, ties by place."""
    by_time = np.argsort(b, kind="stable")
    lo, hi = np.searchsorted(b[by_time], a - tolerance), np.searchsorted(b[by_time], a + tolerance, "right")
    i = np.repeat(np.arange(len(a)), hi - lo)
    j = by_time[np.arange(len(i)) + np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo)] if len(i) else i
    gap = np.abs(b[j] - a[i])
    order = np.lexsort((j, i, gap))
    i, j, gap = i[order], j[order], gap[order]
    first = nearest_first(i, j, len(a), len(b))
    return list(zip(i[first].tolist(), j[first].tolist()))


def nearest_first(i: np.ndarray, j: np.ndarray, n: int, m: int) -> np.ndarray:
    """Places of the pairs (i under n, j under m; the best first) that a choice one by one
    from the front takes.

    In each round every pair that comes first for both of its ends is taken, and with it
    go all other pairs of these ends; that is the same choice, but many at a time."""
    taken, left = [np.empty(0, np.int64)], np.arange(len(i))
    front_i, front_j, used_i, used_j = np.empty(n, np.int64), np.empty(m, np.int64), np.zeros(n, bool), np.zeros(m, bool)
    while len(left):
        a, b = i[left], j[left]
        front_i[a[::-1]], front_j[b[::-1]] = left[::-1], left[::-1]
        both = left[(front_i[a] == left) & (front_j[b] == left)]
        taken.append(both)
        used_i[i[both]] = used_j[j[both]] = True
        left = left[~(used_i[a] | used_j[b])]
    return np.sort(np.concatenate(taken))


def near_pairs(group: np.ndarray, t: np.ndarray, own: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (of an own row, of another row) and distances of all pairs of a group within
    ``tolerance``, nearest first, then by places; rows stand by group and time."""
    at, found, k = np.arange(len(t)), [(np.empty(0, np.int64),) * 2], 1
    while len(at):
        at = at[at + k < len(t)]
        at = at[(group[at + k] == group[at]) & (t[at + k] - t[at] <= tolerance)]
        pair = at[own[at] != own[at + k]]
        found.append((np.where(own[pair], pair, pair + k), np.where(own[pair], pair + k, pair)))
        k += 1
    i, j = (np.concatenate(x) for x in zip(*found))
    gap = np.abs(t[j] - t[i])
    order = np.lexsort((j, i, gap))
    return i[order], j[order], gap[order]


def _reachable(truth: DataFrame, found: DataFrame, keys: list[str], t: str, reach: float) -> DataFrame:
    """(keys, __own, __other): times of both sides, in order, of each stretch of a series
    without a step over ``reach``; no pair within it reaches over such a step."""
    both = truth.select(*keys, F.col(t).cast("double").alias("__t"), F.lit(True).alias("__is")).unionByName(found.select(*keys, F.col(t).cast("double").alias("__t"), F.lit(False).alias("__is")))
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("__t"))
    step = F.coalesce((F.col("__t") - F.lag("__t").over(w) > reach).cast("long"), F.lit(0).cast("long"))
    cut = both.withColumn("__s", step).withColumn("__g", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    side = lambda own: F.sort_array(F.collect_list(F.when(F.col("__is") == F.lit(own), F.coalesce("__t", F.lit(float("nan"))))))
    return cut.groupBy(*keys, "__g").agg(side(True).alias("__own"), side(False).alias("__other")).drop("__g")


def _laid_out(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of pdf, time, own) of all times of the rows' stretches, by row and time."""
    n, m = (pdf[c].map(len).to_numpy(np.int64) for c in ("__own", "__other"))
    t = np.concatenate([np.empty(0), *pdf["__own"], *pdf["__other"]]).astype(float)
    row = np.concatenate([np.repeat(np.arange(len(pdf)), n), np.repeat(np.arange(len(pdf)), m)])
    own = np.arange(len(t)) < n.sum()
    order = np.lexsort((t, row))
    return row[order], t[order], own[order]


def _kinds(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for k in keys for f in df.schema if f.name == k)


def match_in_order(a: np.ndarray, b: np.ndarray, tolerance: float) -> int:
    """Each of a, in order, takes the nearest free one of b within the tolerance (the
    earlier of two); the number of matches.  What is taken points on to its neighbour on
    either side, so a look-up skips it."""
    a, b = np.sort(np.asarray(a, float)), np.sort(np.asarray(b, float))
    places, values, m, n = np.searchsorted(b, a).tolist(), b.tolist(), len(b), 0
    down, up = list(range(m + 1)), list(range(m + 1))  # down[j]: free one before place j, plus 1; up[j]: free one from j on

    def end(link: list[int], j: int) -> int:
        while link[j] != j:
            link[j] = link[link[j]]
            j = link[j]
        return j

    for t, p in zip(a.tolist(), places):
        i, j = end(down, p), end(up, p)
        before, after = t - values[i - 1] if i else np.inf, values[j] - t if j < m else np.inf
        if min(before, after) <= tolerance:
            k = i - 1 if before <= after else j
            down[k + 1], up[k], n = k, k + 1, n + 1
    return n


def match_events(truth: DataFrame, found: DataFrame, keys: list[str], t: str, tolerance: float, wide: float) -> DataFrame:
    """Every true and found time with its partner: result VP, desfase (matched
    only with the wide tolerance), FN or FP.  Series are cut where no pair reaches over,
    and many such stretches are matched at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            row, at, own = _laid_out(pdf)
            i, j, gap = near_pairs(row, at, own, max(tolerance, wide))
            close = np.flatnonzero(gap <= tolerance)
            first = close[nearest_first(i[close], j[close], len(at), len(at))]
            free = np.ones(len(at), bool)
            free[i[first]] = free[j[first]] = False
            rest = np.flatnonzero((gap <= wide) & free[i] & free[j])
            late = rest[nearest_first(i[rest], j[rest], len(at), len(at))]
            free[i[late]] = free[j[late]] = False
            lost, false = np.flatnonzero(free & own), np.flatnonzero(free & ~own)
            of = np.concatenate([row[i[first]], row[i[late]], row[lost], row[false]])
            out = pdf[keys].iloc[of].reset_index(drop=True)
            none = lambda x: np.full(len(x), np.nan)
            yield out.assign(
                result=np.repeat(np.array(["VP", "desfase", "FN", "FP"], object), [len(first), len(late), len(lost), len(false)]),
                t_true=np.concatenate([at[i[first]], at[i[late]], at[lost], none(false)]), t_found=np.concatenate([at[j[first]], at[j[late]], none(lost), at[false]]),
            )

    return _reachable(truth, found, keys, t, max(tolerance, wide)).mapInPandas(run, f"{_kinds(truth, keys)}, result string, t_true double, t_found double")


def event_causes(matches: DataFrame, truth: DataFrame, spikes: DataFrame, small: DataFrame, keys: list[str], t: str, near: float, tolerance: float) -> DataFrame:
    """(keys, result, t_true, t_found, structural, cause) of ``match_events``.

    truth: (keys, t, structural), structural null for those that can be found; of
    equal times the least counts.  A late match is a miss (detectado_con_desfase) and
    a false alarm (desfase_de_evento).  Other false alarms: within ``near`` of a spike,
    within ``tolerance`` of a change below the threshold, else without a cause."""
    kind = truth.groupBy(*keys, F.col(t).alias("t_true")).agg(F.min("structural").alias("structural"))
    known = matches.join(kind, [*keys, "t_true"], "left").withColumn("__us", F.round(F.col("t_found") * 1e6).cast("long"))
    known = known.select(*keys, "result", "t_true", "t_found", "structural", "__us", F.lit(None).cast("int").alias("__mark"))
    for n, marks in enumerate((spikes, small)):
        known = known.unionByName(marks.select(*keys, F.round(F.col(t) * 1e6).cast("long").alias("__us"), F.lit(n).alias("__mark")), allowMissingColumns=True)
    # The nearest mark on either side; both frames look back, one from each end of the series.
    ends = [w.rangeBetween(Window.unboundedPreceding, 0) for w in (Window.partitionBy(*keys).orderBy("__us"), Window.partitionBy(*keys).orderBy(F.desc("__us")))]
    at = [F.when(F.col("__mark") == n, F.col("__us")) for n in (0, 1)]
    known = known.withColumns({f"__before{n}": F.max(at[n]).over(ends[0]) for n in (0, 1)} | {f"__after{n}": F.min(at[n]).over(ends[1]) for n in (0, 1)}).filter("__mark is null")
    close = lambda n, reach: F.coalesce(F.col("__us") - F.col(f"__before{n}") <= round(reach * 1e6), F.lit(False)) | F.coalesce(F.col(f"__after{n}") - F.col("__us") <= round(reach * 1e6), F.lit(False))
    none, late = F.lit(None).cast("string"), F.col("result") == "desfase"
    miss = F.coalesce("structural", F.when(late, "detectado_con_desfase").otherwise("no_detectado"))
    why = F.when(late, "desfase_de_evento").when(close(0, near), "cerca_de_spike").when(close(1, tolerance), "cambio_subumbral").otherwise("sin_causa_identificada")
    side = lambda result, true, found, structural, cause: F.struct(F.lit(result).alias("result"), true.alias("t_true"), found.alias("t_found"), structural.alias("structural"), cause.alias("cause"))
    no, true, found, structural = F.lit(None).cast("double"), F.col("t_true"), F.col("t_found"), F.col("structural")
    hit, missed, false = side("VP", true, found, structural, none), side("FN", true, found, structural, miss), side("FP", no, found, none, why)
    rows = F.when(F.col("result") == "VP", F.array(hit)).when(late, F.array(missed, false)).when(F.col("result") == "FN", F.array(missed)).otherwise(F.array(false))
    return known.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def detection_scores(causes: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and rates of each series from ``event_causes``: precision over all
    found, recall over those that can be found, with late ones (recall_wide), over all
    (recall_all); justified: found ones that stand for a real change."""
    n = lambda c, name: F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(name)
    is_ = lambda r: F.col("result") == r
    open_ = F.col("structural").isNull()
    late = is_("FN") & (F.col("cause") == "detectado_con_desfase")
    real = is_("VP") | F.col("cause").isin("desfase_de_evento", "cambio_subumbral")
    out = causes.groupBy(*keys).agg(
        n(is_("VP") | is_("FN"), "n_true"), n(is_("VP") | is_("FP"), "n_found"), n(is_("VP"), "vp"), n(is_("VP") & open_, "vp_eval"), n(is_("FN"), "fn"), n(is_("FN") & ~open_, "fn_structural"),
        n(is_("FN") & open_, "fn_eval"), n(late, "late_eval"), n(is_("FP"), "fp"), n(is_("FP") & F.col("cause").isin("cerca_de_spike", "sin_causa_identificada"), "spurious"), n(real, "__real"),
    )
    share = lambda a, b: F.try_divide(F.expr(a).cast("double"), F.expr(b))
    p, r = share("vp", "n_found"), share("vp_eval", "vp_eval + fn_eval")
    return out.withColumns({
        "fn_real": F.expr("fn_eval - late_eval"), "precision": p, "precision_justified": share("__real", "n_found"), "recall_eval": r,
        "recall_wide": share("vp_eval + late_eval", "vp_eval + fn_eval"), "recall_all": share("vp", "n_true"), "f1": F.when((p > 0) & (r > 0), p * r * 2 / (p + r)),
    }).drop("__real")


def tolerance_curve(truth: DataFrame, found: DataFrame, keys: list[str], t: str, tolerances: list[float]) -> DataFrame:
    """Matches at each tolerance."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            row, at, own = _laid_out(pdf)
            i, j, gap = near_pairs(row, at, own, max(tolerances, default=0.0))
            matched = np.zeros((len(pdf), len(tolerances)), np.int64)
            for n, most in enumerate(tolerances):
                close = np.flatnonzero(gap <= most)
                np.add.at(matched[:, n], row[i[close[nearest_first(i[close], j[close], len(at), len(at))]]], 1)
            yield pdf[keys].assign(__m=list(matched), __n=pdf["__own"].map(len), __k=pdf["__other"].map(len))

    cut = _reachable(truth, found, keys, t, float(max(tolerances, default=0.0)))
    part = cut.mapInPandas(run, f"{_kinds(truth, keys)}, __m array<long>, __n long, __k long")
    sums = part.groupBy(*keys).agg(*[F.sum(F.col("__m")[n]).alias(f"__{n}") for n in range(len(tolerances))], F.sum("__n").alias("n_true"), F.sum("__k").alias("n_found"))
    each = F.explode(F.array(*[F.struct(F.lit(float(x)).alias("tolerance"), F.col(f"__{n}").alias("matched")) for n, x in enumerate(tolerances)])).alias("r")
    return sums.select(*keys, each, "n_true", "n_found").select(*keys, "r.tolerance", "r.matched", "n_true", "n_found")


def near_any(rows: DataFrame, marks: DataFrame, keys: list[str], t: str, reach: int) -> DataFrame:
    """Rows with a mark of the same series within ``reach`` (whole numbers)."""
    bands = marks.select(*keys, (F.col(t) - reach).alias("__lo"), (F.col(t) + reach).alias("__hi"))
    return band_join(rows, bands, keys, t, "__lo", "__hi", max(1, 2 * reach), "left_semi")


def segment_truth(segs: DataFrame, truth: DataFrame, keys: list[str], seg: str, t: str, lo: str, hi: str, level: str, cell: int) -> DataFrame:
    """True level of each segment (median within it) and its purity, the share
    less than 0.05 from that level."""
    inside = band_join(truth.select(*keys, t, F.col(level).alias("__v")), segs.select(*keys, seg, F.col(lo).alias("__lo"), F.col(hi).alias("__hi")), keys, t, "__lo", "__hi", cell)
    mid = inside.groupBy(*keys, seg).agg(F.percentile("__v", 0.5).alias("true_delta"))
    both = inside.join(mid, [*keys, seg])
    return both.groupBy(*keys, seg).agg(F.first("true_delta").alias("true_delta"), F.count(F.lit(1)).alias("n"), F.avg((F.abs(F.col("__v") - F.col("true_delta")) < 0.05).cast("double")).alias("purity"))


def score_labels(segs: DataFrame, minutes: str, delta: str, n: str, base_share: str, min_share: float = 0.25, min_n: int = 10, band: float = 0.5) -> DataFrame:
    """Expected class and status (no_identificable, micro, ambiguo, evaluado)."""
    status = F.when(F.col(base_share) < min_share, "no_identificable").when(F.col(n) < min_n, "micro").when(is_ambiguous(delta, band), "ambiguo").otherwise("evaluado")
    return segs.withColumns({"expected": segment_class(minutes, delta), "status": status})


def label_accuracy(scored: DataFrame, keys: list[str], obtained: str, n: str, purity: str) -> DataFrame:
    """Of ``score_labels``' rows: agreement of all, of those that count, plain and
    by cycles, and counts of the others; a rate without rows is null."""
    ok, at = F.col("expected") == F.col(obtained), lambda s: F.col("status") == s
    count = lambda c, name: F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(name)
    mean = lambda c, when, name: F.avg(F.when(when, c.cast("double"))).alias(name)
    own = at("evaluado")
    weighted = F.try_divide(F.sum(F.when(own & ok, F.col(n)).otherwise(0)).cast("double"), F.sum(F.when(own, F.col(n)))).alias("accuracy_cycles")
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_total"), mean(ok, F.lit(True), "accuracy_all"), count(own, "n"), mean(ok, own, "accuracy"), weighted, mean(F.col(purity), own, "purity"),
        count(own & (F.col(purity) < 0.9), "impure"), count(at("no_identificable"), "unidentifiable"), count(at("ambiguo"), "ambiguous"), count(at("ambiguo") & ok, "ambiguous_ok"),
        count(at("micro"), "micro"), count(at("micro") & ok, "micro_ok"),
    )


def cycle_labels(rows: DataFrame, segs: DataFrame, keys: list[str], t: str, lo: str, hi: str, kind: str, cell: int) -> DataFrame:
    """Adds label: 1 for rows within a segment of lasting degradation (both ends
    inside), else 0; a row in several segments stays one row."""
    bad = segs.filter(lasting_degradation(kind)).select(*keys, F.col(lo).alias("__lo"), F.col(hi).alias("__hi"))
    points = rows.select(*keys, t).distinct()
    hit = band_join(points, bad, keys, t, "__lo", "__hi", cell, "left_semi").withColumn("__hit", F.lit(1))
    return rows.join(hit, [*keys, t], "left").withColumn("label", F.coalesce("__hit", F.lit(0))).drop("__hit")


def lasting_degradation(kind: str):
    return F.col(kind).startswith("degradacion") & F.col(kind).contains("sostenida")


def degraded_share(segs: DataFrame, keys: list[str], kind: str, n: str) -> DataFrame:
    """(keys, segments, degraded_segments, degraded_pct): share of the cycles in
    segments of lasting degradation, null without cycles."""
    bad = lasting_degradation(kind)
    total = F.sum(F.coalesce(n, F.lit(0)))
    return segs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("segments"), F.sum(F.coalesce(bad, F.lit(False)).cast("long")).alias("degraded_segments"),
        F.try_divide(F.sum(F.when(bad, F.col(n)).otherwise(0)) * 100.0, total).alias("degraded_pct"),
    )


def base_share(truth: DataFrame, keys: list[str], regime: str) -> DataFrame:
    """Share of cycles in the base regime (without a regime: not), and whether 25 % are reached."""
    out = truth.groupBy(*keys).agg(F.avg(F.col(regime).eqNullSafe("base").cast("double")).alias("base_share"))
    return out.withColumn("identifiable", F.col("base_share") >= 0.25)


def coverage(cycles: DataFrame, found: DataFrame, keys: list[str], idx: str, min_block: int = 10) -> DataFrame:
    """Blocks, short blocks, and cycles outside all of them (i0, i1 inclusive)."""
    n = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("blocks"), F.sum((F.col("n_inside") < min_block).cast("long")).alias("short_blocks"))
    inside = band_join(cycles, found.select(*keys, "i0", "i1"), keys, idx, "i0", "i1", 4096, "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("__in"))
    total = cycles.groupBy(*keys).agg(F.count(F.lit(1)).alias("cycles"))
    zero = F.lit(0).cast("long")
    return total.join(n, keys, "left").join(inside, keys, "left").select(*keys, "cycles", F.coalesce("blocks", zero).alias("blocks"), F.coalesce("short_blocks", zero).alias("short_blocks"), (F.col("cycles") - F.coalesce("__in", zero)).alias("outside"))


def episode_scores(rows: DataFrame, keys: list[str], order: list[str], truth: str, predicted: str, min_run: int = 5, cover: float = 0.5) -> DataFrame:
    """Runs shorter than ``min_run`` don't count, predicted or true; a true
    episode is found if enough of it is predicted; false alarms are predicted runs
    without any true cycle (of a short episode either).  With a first column of ``order``
    that is a time, alarms_per_day is over the days from the first row to the last."""
    p = with_runs(rows, keys, order, [predicted], "__p")
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys, "__p"))
    p = p.withColumn("__keep", (F.col(predicted) == 1) & (size >= min_run))
    q = with_runs(p, keys, order, [truth], "__t")
    true = q.filter(F.col(truth) == 1).groupBy(*keys, "__t").agg(F.count(F.lit(1)).alias("n"), (F.avg(F.col("__keep").cast("double")) >= cover).cast("long").alias("hit")).filter(F.col("n") >= min_run)
    alarm = q.filter("__keep").groupBy(*keys, "__p").agg((F.max(F.col(truth)) == 0).cast("long").alias("false"))
    a = true.groupBy(*keys).agg(F.count(F.lit(1)).alias("episodes"), F.sum("hit").alias("found"))
    b = alarm.groupBy(*keys).agg(F.sum("false").alias("false_alarms"))
    zero = F.lit(0).cast("long")
    timed = dict(rows.dtypes)[order[0]].startswith(("timestamp", "date"))
    days = (F.max(micros(order[0])) - F.min(micros(order[0]))) / 86.4e9 if timed else F.lit(None).cast("double")
    series = rows.groupBy(*keys).agg(days.alias("__days"))
    out = series.join(a, keys, "left").join(b, keys, "left").select(*keys, "__days", *[F.coalesce(c, zero).alias(c) for c in ("episodes", "found", "false_alarms")])
    return out.withColumn("alarms_per_day", F.when(F.col("__days") > 0, F.col("false_alarms") / F.col("__days"))).drop("__days")


def blocked_cv(rows: DataFrame, keys: list[str], order: list[str], features: list[str], label: str, folds: int = 5, purge: int = 0) -> DataFrame:
    """Adds probability by contiguous folds, rows within ``purge`` of a fold left
    out of its training; one class in training gives that class's share, no row gives 0.
    The models of all folds of all series are fitted together (``logistic``)."""
    at = logistic.placed(rows, keys, order, features, label)
    series = at.groupBy("__id").agg(F.count(F.lit(1)).alias("__n")).withColumns({"__from": F.lit(0).cast("long"), "__rows": F.col("__n")})
    models = logistic.fit(at, logistic.folds(series, folds, purge), len(features))
    return logistic.asked(at, models, len(features)).select(*[c for c in rows.columns if c != "probability"], "probability")


def gradient_boosting(train: DataFrame, test: DataFrame, features: list[str], label: str, seed: int = 1) -> DataFrame:
    """Boosted trees (100 of depth 3); adds probability to the test rows."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    put = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="keep")
    model = GBTClassifier(featuresCol="__x", labelCol=label, maxDepth=3, maxIter=100, seed=seed).fit(put.transform(train))
    out = model.transform(put.transform(test)).withColumn("probability_1", vector_to_array("probability")[1])
    return out.drop("__x", "rawPrediction", "probability", "prediction").withColumnRenamed("probability_1", "probability")


def temporal_split(rows: DataFrame, keys: list[str], order: list[str], share: float, purge: int) -> DataFrame:
    """Adds part: train, purged or test, by position."""
    n, i = F.count(F.lit(1)).over(Window.partitionBy(*keys)), F.row_number().over(over(keys, order))
    cut = F.floor(n * F.lit(share))
    return rows.withColumn("part", F.when(i <= cut, "train").when(i <= cut + purge, "purged").otherwise("test"))


def train_reference(parts: DataFrame, keys: list[str], x: str, q: float = 0.1, of: str = "train") -> DataFrame:
    """Adds reference, the quantile of one part's rows, for every part."""
    ref = parts.filter(F.col("part") == of).groupBy(*keys).agg(F.percentile(x, q).alias("reference"))
    return parts.join(ref, keys, "left")


def scenarios(real: DataFrame, synthetic: DataFrame, keys: list[str], order: list[str], features: list[str], label: str, median: str, threshold: float = 2.0, folds: int = 5, purge: int = 0) -> DataFrame:
    """(keys, scenario, order, label, probability): TSTR learns from the synthetic
    rows, TRTR from the real rows of part train, regla is the plain rule; all three on
    the real rows of part test.  TSTS is the blocked validation within the synthetic
    rows.  A scenario whose training rows hold one class only has no rows.

    A series is numbered part by part, so a part is a range of places, and all models of
    all scenarios and series are fitted together (``logistic``)."""
    cols, width = list(dict.fromkeys([*keys, *order, *features, label, median])), len(features)
    both = real.select(*cols, "part").filter("part in ('train', 'test')").unionByName(synthetic.select(*cols, F.lit("synthetic").alias("part")))
    at = logistic.placed(both, keys, ["part", *order], features, label)
    mine = lambda name: F.col("part") == name
    ends = [e for k in ("train", "test", "synthetic") for e in (F.coalesce(F.min(F.when(mine(k), F.col("__pos"))), F.lit(0)).alias(f"{k}_from"), F.coalesce(F.max(F.when(mine(k), F.col("__pos"))) + 1, F.lit(0)).alias(f"{k}_to"))]
    own = F.when(mine("synthetic"), F.col("__y"))
    series = settled(at.groupBy("__id").agg(F.count(F.lit(1)).alias("__n"), *ends, (F.min(own) < F.max(own)).alias("__both")), "series")
    side = lambda name, k: series.select("__id", "__n", F.lit(name).alias("model"), F.col(f"{k}_from").alias("learn_from"), F.col(f"{k}_to").alias("learn_to"), F.lit(0).cast("long").alias("gap_from"), F.lit(0).cast("long").alias("gap_to"), F.col("test_from"), F.col("test_to"))
    parts = logistic.folds(series.filter("__both").withColumns({"__from": F.col("synthetic_from"), "__rows": F.col("synthetic_to") - F.col("synthetic_from")}), folds, purge)
    models = logistic.fit(at, side("TSTR", "synthetic").unionByName(side("TRTR", "train")).unionByName(parts), width)
    scored = logistic.asked(at, models.filter(F.col("model").startswith("fold") | ~F.col("one_class")), width)
    scored = scored.withColumn("scenario", F.when(F.col("__model").startswith("fold"), "TSTS").otherwise(F.col("__model")))
    rule = at.filter(mine("test")).withColumns({"scenario": F.lit("regla"), "probability": F.coalesce(F.col(median) >= threshold, F.lit(False)).cast("double")})
    out = [*keys, "scenario", *order, label, "probability"]
    return scored.select(*out).unionByName(rule.select(*out))


def scenario_scores(scored: DataFrame, keys: list[str], order: list[str], label: str, limit: float = 0.5, min_run: int = 5, cover: float = 0.5) -> DataFrame:
    """Of ``scenarios``' rows: prevalence, accuracy, that of the majority
    class, precision, recall, F1, AUROC, average precision and episodes.

    Four tables are made of the rows, so where a checkpoint folder is set they are
    written there once and the models are not fitted again for each."""
    by = [*keys, "scenario"]
    if scored.sparkSession.conf.get("spark.checkpoint.dir", None):
        scored = scored.checkpoint()
    rows = scored.withColumn("__hit", (F.col("probability") >= limit).cast("int"))
    n = lambda p, y, name: F.sum(((F.col("__hit") == p) & (F.col(label) == y)).cast("long")).alias(name)
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("prevalence"), n(1, 1, "tp"), n(1, 0, "fp"), n(0, 1, "fn"), n(0, 0, "tn"))
    counts = counts.withColumns({"majority": F.greatest(F.col("prevalence"), 1 - F.col("prevalence")), "accuracy": (F.col("tp") + F.col("tn")) / F.col("n"), **precision_recall("tp", "fp", "fn", zero=True)})
    # Equal probabilities are ranked by time.
    placed = rows.withColumn("__at", F.struct(*order))
    parts = (auroc(rows, by, "probability", label), average_precision(placed, by, "probability", label, "__at"), episode_scores(rows, by, order, label, "__hit", min_run, cover))
    for part in parts:
        counts = counts.join(part, by, "left")
    return counts


def one_at_a_time(values: dict[str, list[float]]) -> list[dict[str, float]]:
    """The first value of each list, then each other value with the rest left as they are."""
    base = {k: v[0] for k, v in values.items()}
    return [base, *[base | {k: x} for k, v in values.items() for x in v[1:]]]


def grid(values: dict[str, list[float]]) -> list[dict[str, float]]:
    """All combinations of the lists' values."""
    return [dict(zip(values, x)) for x in product(*values.values())]


def sweep(rows: DataFrame, keys: list[str], configs: list[dict], seeds: list[int], order: list[str], x: str, dwell: int = 4, fuse: float | None = 0.5, interval_s: float | None = None, chunk: int | None = None) -> DataFrame:
    """The model for each setting and seed; (keys, config_id, seed, states, macros,
    boundaries, n, per_day).  A setting's percentile, unless 0, cuts the values above it;
    boundaries count the rows that are left.  per_day: boundaries a day, a row lasting
    ``interval_s`` (null without it).  All runs of all series go through the model at once."""
    from . import hmm, segments

    few, size = rows.select(*dict.fromkeys([*keys, *order, x])), chunk or hmm.CHUNK

    def summary(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        n, s = (np.concatenate(pdf[c].tolist()) for c in ("n", "state"))
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))  # runs go on over chunks
        n, macros, total = np.add.reduceat(n, first), len(set(s.tolist())), int(n.sum())
        n, s = segments.smooth_runs(n, s[first], dwell)
        day = (len(n) - 1) / (total * interval_s / 86_400) if interval_s else None
        return pd.DataFrame([(*key, len(set(s.tolist())), macros, np.cumsum(n)[:-1], total, day)], columns=["id", "run", "states", "macros", "boundaries", "n", "per_day"])

    # A series and what each percentile leaves of it are series of their own, so that all runs go through one fit.
    cuts, own = sorted({float(c.get("percentile", 0.0)) for c in configs}), None
    for n, cut in enumerate(cuts):
        left = few
        if cut > 0:
            left = few.withColumn("__cut", F.percentile(x, cut / 100).over(Window.partitionBy(*keys))).filter(F.col(x) <= F.col("__cut"))
        left = left.withColumn("__cut", F.lit(n))
        own = left if own is None else own.unionByName(left)
    at = segments.placed(own, [*keys, "__cut"], order, x)
    chosen = [(i, c, s) for i, c in enumerate(configs) for s in seeds]
    settings = [hmm.Setting(**{k: v for k, v in c.items() if k != "percentile"}) for _, c, _ in chosen]
    runs = F.array(*[F.array(*[F.lit(r) for r, (_, c, _) in enumerate(chosen) if float(c.get("percentile", 0.0)) == cut]) for cut in cuts])
    named = at.filter("__pos = 0").select(*keys, "__id", F.explode(F.get(runs, "__cut")).alias("__run"))
    states, table = segments.fitted(at, settings, [s for *_, s in chosen], size, named.select(F.col("__id").alias("id"), F.col("__run").alias("run")))
    lengths = hmm.lengths(states, segments.fused(hmm.moments(states, table), fuse), size)
    out = lengths.groupBy("id", "run").applyInPandas(summary, "id string, run int, states int, macros int, boundaries array<long>, n long, per_day double")
    ids, seeds_ = F.array(*[F.lit(i) for i, *_ in chosen]), F.array(*[F.lit(s) for *_, s in chosen])
    out = named.join(out, (F.col("__id") == F.col("id")) & (F.col("__run") == F.col("run")))
    return settled(out.select(*keys, F.get(ids, "run").alias("config_id"), F.get(seeds_, "run").alias("seed"), "states", "macros", "boundaries", "n", "per_day"), "sweep-runs")


def seed_stability(runs: DataFrame, keys: list[str], tolerance: float = 2.0) -> DataFrame:
    """Per setting, over its seeds: mean number of boundaries, its range, least and
    most boundaries a day, and the mean pairwise F1 of boundaries."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        b = [np.asarray(x, float) for x in pdf.sort_values("seed")["boundaries"]]
        f1 = [2 * match_in_order(p, q, tolerance) / (len(p) + len(q)) if len(p) + len(q) else 1.0 for i, p in enumerate(b) for q in b[i + 1 :]]
        n, day = [len(x) for x in b], pdf["per_day"].astype(float)
        return pd.DataFrame([(*key, len(b), float(np.mean(n)), int(max(n) - min(n)), float(np.mean(f1)) if f1 else None, day.min(), day.max())], columns=[*keys, "config_id", "seeds", "mean_boundaries", "range", "f1", "least_per_day", "most_per_day"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.schema if f.name in keys)
    return runs.groupBy(*keys, "config_id").applyInPandas(run, f"{kinds}, config_id int, seeds int, mean_boundaries double, range int, f1 double, least_per_day double, most_per_day double")
