"""Blocks of stable routes and comparisons between them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import micros
from ..functions.stats import ks_two_samples, mode_first_seen, quantile
from .windows import band_join, over, runs, with_position, with_runs


def blocks(rows: DataFrame, keys: list[str], order: list[str], key: str, persistence: int = 4) -> DataFrame:
    """Runs of one route key that last, merged with the next such run of the
    same key whatever lies between.  (keys, block_id, key, i0, i1, start_ts,
    end_ts, n_inside, merged)"""
    kept = runs(rows, keys, order, [key], order[0]).filter(F.col("n") >= persistence)
    merged = with_runs(kept, keys, ["i0"], [key], "block_id")
    out = merged.groupBy(*keys, "block_id", key).agg(F.min("i0").alias("i0"), F.max("i1").alias("i1"), F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.count(F.lit(1)).alias("merged"))
    return out.withColumn("n_inside", F.col("i1") - F.col("i0") + 1)


def block_members(rows: DataFrame, found: DataFrame, keys: list[str], order: list[str], key: str, cell: int = 4096) -> DataFrame:
    """Rows with the block they lie in, and whether they are its own (same key)."""
    numbered = with_position(rows, keys, order, "__i").withColumnRenamed(key, "__key")
    return band_join(numbered, found, keys, "__i", "i0", "i1", cell).withColumn("own", F.col("__key").eqNullSafe(F.col(key)))


def block_table(rows: DataFrame, keys: list[str], order: list[str], key: str, persistence: int = 4) -> DataFrame:
    """O8 with fuera: cycles inside a block whose key differs."""
    found = blocks(rows, keys, order, key, persistence)
    own = block_members(rows, found, keys, order, key).groupBy(*keys, "block_id").agg(F.sum((~F.col("own")).cast("long")).alias("outside"))
    return found.join(own, [*keys, "block_id"])


def ranked_blocks(table: DataFrame, keys: list[str], cadence: DataFrame, min_cycles: int = 200, min_cover: float = 0.8) -> DataFrame:
    """The blocks with enough own cycles and coverage (all, if none has),
    with their rank by duration."""
    t = table.join(cadence, keys).withColumn("own", F.col("n_inside") - F.col("outside"))
    span = (micros("end_ts") - micros("start_ts")) / 1e6
    # Cycles that would fill the span; without a cadence those that are there.
    expected = F.when(F.col("cadence_s") > 0, F.try_divide(span, F.col("cadence_s")) + 1).otherwise(F.col("n_inside").cast("double"))
    t = t.withColumns({"duration_h": F.round(span / 3600, 1), "cover": F.try_divide(F.col("own").cast("double"), expected)})
    t = t.withColumn("eligible", (F.col("own") >= min_cycles) & F.coalesce(F.col("cover") >= min_cover, F.lit(False)))
    any_ok = F.max("eligible").over(Window.partitionBy(*keys))
    t = t.withColumn("__any", any_ok).filter(F.col("eligible") | ~F.col("__any"))
    w = Window.partitionBy(*keys).orderBy(F.desc("duration_h"), "block_id")
    return t.withColumns({"rank": F.row_number().over(w), "second_h": F.lead("duration_h").over(w)}).drop("__any")


def main_block(table: DataFrame, keys: list[str], cadence: DataFrame, min_cycles: int = 200, min_cover: float = 0.8) -> DataFrame:
    """The first of ``ranked_blocks``; ``tight`` if the second reaches 80 % of it."""
    t = ranked_blocks(table, keys, cadence, min_cycles, min_cover).filter("rank = 1")
    return t.withColumn("tight", F.coalesce(F.try_divide("second_h", "duration_h") >= 0.8, F.lit(False))).drop("rank")


def compare_samples(rows: DataFrame, keys: list[str], group: str, x: str, position: str, min_n: int = 10, min_share: float = 0.02, diff_ms: float = 1.0, diff_rel: float = 0.1, alpha: float = 0.01) -> DataFrame:
    """Each frequent group against the most frequent one: difference of
    medians, KS distance and probability, verdict."""
    counts = rows.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("__p"), F.percentile(x, 0.5).alias("median"))
    w = Window.partitionBy(*keys)
    counts = counts.withColumns({"__all": F.sum("n").over(w), "rank": F.row_number().over(w.orderBy(F.desc("n"), "__p"))})
    enough = counts.filter((F.col("rank") == 1) | (F.col("n") >= F.greatest(F.lit(min_n), F.ceil(F.lit(min_share) * F.col("__all")))))
    top = enough.filter("rank = 1").select(*keys, F.col(group).alias("__ref"), F.col("median").alias("__refm"))
    others = enough.filter("rank > 1")
    # The reference sample stands beside each other group: rows x groups of a series.
    ref_rows = rows.join(top, keys).filter(F.col(group) == F.col("__ref")).select(*keys, F.col(x).alias("__x"))
    pairs = others.select(*keys, F.col(group).alias("__g"))
    sample = rows.select(*keys, F.col(group).alias("__g"), F.col(x).alias("__x")).join(pairs, [*keys, "__g"]).withColumn("__first", F.lit(True))
    both = sample.unionByName(pairs.join(ref_rows, keys).withColumn("__first", F.lit(False)))
    ks = ks_two_samples(both, [*keys, "__g"], "__x", "__first").select(*keys, F.col("__g").alias(group), "d", "p")
    out = enough.join(top, keys).join(ks, [*keys, group], "left").withColumn("delta_ms", F.when(F.col("rank") > 1, F.col("median") - F.col("__refm")))
    limit = F.greatest(F.lit(diff_ms), F.lit(diff_rel) * F.least("median", "__refm"))
    differs = (F.col("p") < alpha) & (F.abs("delta_ms") >= limit)
    return out.select(*keys, group, "n", "median", "delta_ms", "d", "p", F.when(F.col("rank") == 1, "referencia").when(differs, "distinto").otherwise("equivalente").alias("verdict"))


def compare_pairs(rows: DataFrame, keys: list[str], group: str, x: str, position: str, min_n: int = 10, min_share: float = 0.005, diff_ms: float = 2.0, diff_rel: float = 0.0, alpha: float = 0.01) -> DataFrame:
    """(keys, a, b, delta_ms, d, p, equivalent): each pair of frequent groups, a
    the more frequent one (of equals the one seen first).

    Samples meet as counts of distinct values."""
    counts = rows.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("__p"), F.percentile(x, 0.5).alias("m"))
    w = Window.partitionBy(*keys)
    counts = counts.withColumns({"__all": F.sum("n").over(w), "r": F.row_number().over(w.orderBy(F.desc("n"), "__p"))})
    enough = counts.filter(F.col("n") >= F.greatest(F.lit(min_n), F.ceil(F.lit(min_share) * F.col("__all"))))
    side = lambda s: enough.select(*keys, *[F.col(c).alias(f"__{to}{s}") for c, to in ((group, "v"), ("m", "m"), ("r", "r"))])
    pairs = side("a").join(side("b"), keys).filter("__ra < __rb")  # pairs of a series' frequent groups
    values = rows.filter(F.col(x).isNotNull()).groupBy(*keys, F.col(group).alias("__g"), F.col(x).alias("__x")).agg(F.count(F.lit(1)).alias("__n"))
    both = pairs.select(*keys, "__va", "__vb", F.explode(F.array(F.struct(F.col("__va").alias("g"), F.lit(True).alias("f")), F.struct(F.col("__vb").alias("g"), F.lit(False).alias("f")))).alias("s"))
    both = both.select(*keys, "__va", "__vb", F.col("s.g").alias("__g"), F.col("s.f").alias("__first")).join(values, [*keys, "__g"])
    ks = ks_two_samples(both, [*keys, "__va", "__vb"], "__x", "__first", "__n").select(*keys, "__va", "__vb", "d", "p")
    out = pairs.join(ks, [*keys, "__va", "__vb"]).withColumn("delta_ms", F.col("__mb") - F.col("__ma"))
    differs = (F.col("p") < alpha) & (F.abs("delta_ms") >= F.greatest(F.lit(diff_ms), F.lit(diff_rel) * F.least("__ma", "__mb")))
    return out.select(*keys, F.col("__va").alias("a"), F.col("__vb").alias("b"), "delta_ms", "d", "p", (~differs).alias("equivalent"))


def equivalence_classes(pairs: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """Complete linkage in order of frequency.  pairs: (keys, a, b, equivalent);
    members: (keys, value, n, path; rank, if equal n aren't to go by value).  A value joins the first class that it is
    equivalent to in every member with the same path; unknown pairs don't join.

    Grouped function: a series has a handful of lengths."""

    def run(key: tuple, own: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("rank") if "rank" in own else own.sort_values(["n", "value"], ascending=[False, True])
        path = dict(zip(own["value"], own["path"]))
        same = {frozenset((a, b)) for a, b, e in zip(known["a"], known["b"], known["equivalent"]) if e}
        classes: list[list[int]] = []
        for v in own["value"]:
            fit = next((k for k in classes if all(frozenset((v, m)) in same and path[v] == path[m] for m in k)), None)
            if fit is None:
                classes.append([v])
            else:
                fit.append(v)
        rows = [(*key, v, k[0], len(k) > 1) for k in classes for v in k]
        return pd.DataFrame(rows, columns=[*keys, "value", "clase", "fusionada"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema if f.name in keys)
    pairs = pairs.select(*[F.col(c).alias(c) for c in pairs.columns])  # both may stem from one table
    return members.groupBy(*keys).cogroup(pairs.groupBy(*keys)).applyInPandas(run, f"{kinds}, value int, clase int, fusionada boolean")


def alternation(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Share of steps that change the value, the share expected from the
    frequencies alone, and the mean run length."""
    w = over(keys, order)
    stepped = rows.withColumn("__d", (F.lag(value).over(w) != F.col(value)).cast("long"))
    seen = stepped.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("__d").alias("changes"))
    square = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("k")).groupBy(*keys).agg(F.sum(F.col("k") * F.col("k")).alias("sq"))
    both = seen.join(square, keys)
    return both.select(*keys, "n", F.try_divide(F.col("changes").cast("double"), F.col("n") - 1).alias("observed"), (1 - F.col("sq") / (F.col("n") * F.col("n"))).alias("expected"), (F.col("n") / (F.coalesce("changes", F.lit(0)) + 1)).alias("mean_run"))


def rtt_summary(rows: DataFrame, keys: list[str], x: str) -> DataFrame:
    """K7, K8: quantiles and ends per group."""
    return rows.groupBy(*keys).agg(F.count(x).alias("n"), quantile(x, [0.25, 0.5, 0.75, 0.95]).alias("q"), F.min(x).alias("min"), F.max(x).alias("max"))


def modal_path(rows: DataFrame, keys: list[str], path: str, position: str) -> DataFrame:
    return mode_first_seen(rows, keys, path, position, "modal_path")


def length_classes(rows: DataFrame, keys: list[str], group: str, x: str, path: str, position: str) -> DataFrame:
    """(keys, value, clase, fusionada): classes of lengths that are equivalent in
    every pair and have the same modal path; rare lengths stay alone."""
    known = compare_pairs(rows, keys, group, x, position).select(*keys, "a", "b", "equivalent")
    modal = modal_path(rows, [*keys, group], path, position).select(*keys, F.col(group).alias("value"), F.col("modal_path").alias("path"))
    counts = rows.groupBy(*keys, F.col(group).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("__p"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "__p"))
    members = counts.withColumn("rank", rank).drop("__p").join(modal, [*keys, "value"], "left")
    return equivalence_classes(known, members, keys)
