"""Mixing sources to target weights (operator 3): a time-varying curriculum.

Each source has a weight and a curve that says how its weight moves over
training time 0 to 1 (piecewise linear; each curve is scaled to integral one, so
the weights hold over the whole run).  Targets share the total by weight; none
may exceed ``repeats`` times its source's size, and what is over is shared again
among the rest (water-filling: with sources sorted by size over weight, the
level is the greatest quotient of what is left of the total and of the weights).

A source's documents stand in a fixed order (by hash of their id), one pass after
the other, until the target is reached; the last one counts with the words that
are still wanted.  A copy's place in its source's stream is a share of the
source's demand; inverting the integral of its curve gives the training time at
which that share is due, its position.  Documents are range-sorted by position.

Only DataFrame functions are used.  Running sums have two levels: hash buckets
within a source, then rows within a bucket, so a source that holds most rows is
dealt over many tasks.

Defined results: size is the number of words (null or blank: 0); the null source
is a source, last in order; sources without words have target 0; documents of
size 0 take 0 words and have no position; rows with null ids come first in their
source; repeated rows are each a document; texts of any length are read whole;
other columns, whatever their names, come back as they were; empty tables give
empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, rows_of, settle, text_of

#: What a word is, and the weights, repeating over sources in order.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: A document is used at most so many times.
REPEATS = 3
#: Curves, repeating like the weights: (time, relative weight) at each knot.
CURVES = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)


def integral(curve: tuple[tuple[float, float], ...]) -> list[tuple[float, float, float, float]]:
    """For each piece: time and integral where it begins, value there, slope;
    scaled to integral one."""
    total = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(curve, curve[1:]))
    out, done = [], 0.0
    for (t0, v0), (t1, v1) in zip(curve, curve[1:]):
        out.append((t0, done, v0 / total, (v1 - v0) / (t1 - t0) / total))
        done += (t1 - t0) * (v0 + v1) / 2 / total
    return out


def due_time(share: Column, curve: tuple[tuple[float, float], ...]) -> Column:
    """The time by which the curve's integral reaches ``share``."""
    out: Column | None = None
    for t, done, value, slope in integral(curve):
        r = share - F.lit(done)
        root = F.sqrt(F.greatest(F.lit(value * value) + F.lit(2 * slope) * r, F.lit(0.0)))
        piece = F.lit(t) + F.lit(2.0) * r / (F.lit(value) + root)
        out = piece if out is None else F.when(share >= F.lit(done), piece).otherwise(out)
    return out


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, kind, target) from (source, size) rows.  One row for
    each source is all that meets in one task."""
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    src = src.withColumn("kind", ((F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights)).cast("int"))
    weight = F.lit(float(weights[-1]))
    for i, w in list(enumerate(weights))[-2::-1]:
        weight = F.when(F.col("kind") == i, F.lit(float(w))).otherwise(weight)
    src = src.withColumns({"w": weight, "cap": F.col("source_size") * F.lit(repeats)})
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    left_w = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    src = src.withColumn("level", left.cast("double") / left_w)
    src = src.withColumn("level", F.max("level").over(everything))
    return src.select("source", "source_size", "kind", F.least(F.col("cap").cast("double"), F.col("w") * F.col("level")).alias("target"))


def plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, curves=CURVES, repeats: int = REPEATS) -> DataFrame:
    """(id, size, source_size, target, taken, start, kind, position) for every row;
    position is that of the first copy, null if none is taken."""
    base = df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"))
    base = settle(base.withColumn("h", F.coalesce(F.md5(F.col("id").cast("string")), F.lit(""))), "sizes").withColumn("b", F.substring("h", 1, 3))
    buckets = base.groupBy("source", "b").agg(F.sum("size").alias("n"))
    goals = targets(buckets.select("source", F.col("n").alias("size")), weights, repeats).withColumnRenamed("source", "s")
    before = buckets.withColumn("base", F.sum("n").over(Window.partitionBy("source").orderBy("b")) - F.col("n"))
    before = before.join(goals, F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), F.col("b").alias("c"), "base", "source_size", "kind", "target")
    rows = base.join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("b") == F.col("c")))
    order = Window.partitionBy("source", "b").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("start", F.col("base") + F.sum("size").over(order) - F.col("size"))
    wanted = F.floor("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(wanted / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")
    rest = wanted - passes * F.col("source_size")
    last = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("start")))
    rows = rows.withColumns({"passes": passes, "last": last})
    rows = rows.withColumn("taken", F.col("passes") * F.col("size") + F.col("last"))
    first = F.when(F.col("passes") > 0, F.col("size")).otherwise(F.col("last"))
    rows = rows.withColumn("position", F.when(F.col("taken") > 0, _position(F.col("start"), first, curves)))
    return rows.select("id", "source", "size", "source_size", "target", "taken", "start", "kind", "passes", "last", "position")


def _position(start: Column, words: Column, curves) -> Column:
    share = F.least((start.cast("double") + words.cast("double") / 2) / F.col("target"), F.lit(1.0))
    out = due_time(share, curves[-1])
    for i, curve in list(enumerate(curves))[-2::-1]:
        out = F.when(F.col("kind") == i, due_time(share, curve)).otherwise(out)
    return out


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, curves=CURVES, repeats: int = REPEATS, added: tuple[str, str, str] | None = ("copy", "words", "position")) -> DataFrame:
    """The mixed documents, a row for each copy, range-sorted by position: the
    columns of ``df``, then copy, words, position under the names in ``added`` (None:
    without them).  A copy that is only partly wanted has its first ``words`` words,
    one space between them.  Rows with one id, source and size take their places by
    their texts and other columns, so that reruns agree."""
    mixed = _in_order(df, plan(df, id_col, text_col, source_col, weights, curves, repeats), id_col, text_col, source_col, curves)
    text = F.col(quoted(text_col, "row."))
    cut = F.array_join(F.slice(F.split(F.regexp_replace(text, r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+"), 1, F.col("__c.words").cast("int")), " ")
    taken = F.when(F.col("__c.words") < F.col("__size"), cut).otherwise(text)
    columns = [(taken if c == text_col else F.col(quoted(c, "row."))).alias(c) for c in df.columns]
    named = [F.col(f"__c.{c}").alias(n) for c, n in zip(("copy", "words", "position"), added or ())]
    return mixed.select(*columns, *named)


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, curves=CURVES, repeats: int = REPEATS) -> DataFrame:
    """(id, size, source_size, target, taken, position) for every row, read off the
    range-sorted copies of the mix, which are written down in training order without
    their texts: the words of a row's copies together, and the place of its first.
    Rows of which the mix has no copy are added from the plan."""
    p = plan(df, id_col, text_col, source_col, weights, curves, repeats)
    copies = settle(_in_order(df, p, id_col, text_col, source_col, curves).select(F.col("__i").alias("id"), F.col("__o").alias("source"), F.col("__size").alias("size"), "__c.*"), "mixed")
    # Rows with words have a start of their own within their source.
    found = copies.groupBy("id", "source", "size", "start", "source_size", "target").agg(F.sum("words").alias("taken"), F.min("position").alias("position"))
    columns = ["id", "size", "source_size", "target", "taken", "position"]
    return found.select(*columns).unionByName(p.filter("taken = 0").select(*columns))


def _in_order(df: DataFrame, p: DataFrame, id_col: str, text_col: str, source_col: str, curves) -> DataFrame:
    """The rows of ``df`` (row) with each of their copies in the plan ``p`` (__c), range-sorted by position."""
    # Rows with one id, source and size are told apart by a number on both sides.
    p = p.filter("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") - F.when(F.col("last") > 0, 0).otherwise(1))))
    p = p.withColumn("words", F.when(F.col("copy") < F.col("passes"), F.col("size")).otherwise(F.col("last")))
    p = p.withColumn("position", _position(F.col("copy") * F.col("source_size") + F.col("start"), F.col("words"), curves))
    copies = p.groupBy("id", "source", "size", "start").agg(F.array_sort(F.collect_list(F.struct("copy", "words", "position", "start", "source_size", "target"))).alias("__copies"))  # at most ``repeats`` + 1 each
    copies = copies.withColumn("__m", F.row_number().over(Window.partitionBy("id", "source", "size").orderBy("start")))
    copies = copies.select(F.col("id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__s"), "__m", "__copies")
    text = F.col(quoted(text_col, "row."))
    own = rows_of(df).select("row", F.col(quoted(id_col, "row.")).alias("__i"), F.col(quoted(source_col, "row.")).cast("string").alias("__o"), F.regexp_count(text_of(quoted(text_col, "row.")), F.lit(WORD)).cast("long").alias("__size")).filter("__size > 0")
    comparable = [F.col(quoted(f.name, "row.")) for f in df.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    twin = Window.partitionBy("__i", "__o", "__size").orderBy(F.md5(text.cast("string")), F.xxhash64(*comparable))
    own = own.withColumn("__n", F.row_number().over(twin))
    same = F.col("__i").eqNullSafe(F.col("__id")) & F.col("__o").eqNullSafe(F.col("__source")) & (F.col("__size") == F.col("__s")) & (F.col("__n") == F.col("__m"))
    mixed = own.join(copies, same).withColumn("__c", F.explode("__copies"))
    # Ties in position and id are broken by what tells twins and copies apart.
    return mixed.orderBy("__c.position", "__i", "__o", "__size", "__n", "__c.copy")
