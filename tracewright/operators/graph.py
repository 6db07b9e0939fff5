"""The path graph over cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import known_asn


def ip_view(hops: DataFrame, keys: list[str], cycle: list[str]) -> DataFrame:
    """A node for each responding hop: node, layer, rtt_ms, ip."""
    return hops.filter("ip is not null and ip <> ''").select(*keys, *cycle, F.col("ip").alias("node"), F.col("hop").alias("layer"), "rtt_ms", "ip")


def fill_asn(hops: DataFrame, keys: list[str], cycle: list[str]) -> DataFrame:
    """Hops without a known AS between two of the same AS take it."""
    w = Window.partitionBy(*keys, *cycle).orderBy("hop")
    a = known_asn("asn")
    before, after = F.last(a, True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.first(a, True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return hops.withColumn("asn_filled", F.coalesce(a, F.when(before == after, before)))


def asn_view(hops: DataFrame, keys: list[str], cycle: list[str]) -> DataFrame:
    """Neighbouring hops of one AS are one node; rtt_ms is their median; next is the node behind.

    A cycle is folded hop by hop: hops without a known AS wait for the next known one, and
    join its node if the one before was of the same AS, else they are a node of their own."""
    rows = hops.filter("ip is not null and ip <> ''")
    rtt = dict(rows.dtypes)["rtt_ms"]
    path = F.sort_array(F.collect_list(F.struct("hop", known_asn("asn").alias("a"), F.col("rtt_ms").alias("r"))))
    none = F.expr(f"cast(array() as array<struct<a:string,r:array<{rtt}>>>)")
    node = lambda a, r: F.array(F.struct(a.alias("a"), r.alias("r")))
    waiting = lambda s: F.when(F.size(s["w"]) > 0, node(F.lit(None).cast("string"), s["w"])).otherwise(none)

    def put(s: Column, x: Column) -> Column:
        last, one, empty = F.try_element_at(s["v"], F.lit(-1)), F.array(x["r"]), F.slice(s["w"], 1, 0)
        same = F.slice(s["v"], 1, F.size(s["v"]) - 1)
        joined = F.concat(same, node(x["a"], F.concat(last["r"], s["w"], one)))
        known = F.when(last["a"] == x["a"], joined).otherwise(F.concat(s["v"], waiting(s), node(x["a"], one)))
        return F.struct(F.when(x["a"].isNull(), s["v"]).otherwise(known).alias("v"), F.when(x["a"].isNull(), F.concat(s["w"], one)).otherwise(empty).alias("w"))

    start = F.struct(none.alias("v"), F.expr(f"cast(array() as array<{rtt}>)").alias("w"))
    view = rows.groupBy(*keys, *cycle).agg(path.alias("__p")).select(*keys, *cycle, F.aggregate("__p", start, put, lambda s: F.concat(s["v"], waiting(s))).alias("__v"))
    view = view.select(*keys, *cycle, "__v", F.posexplode("__v").alias("__i", "__n"))
    name = lambda n: F.coalesce(F.concat(F.lit("AS"), n["a"]), F.lit("?"))
    behind = F.get("__v", F.col("__i") + 1)
    return view.select(*keys, *cycle, name(F.col("__n")).alias("node"), (F.col("__i") + 1).cast("long").alias("layer"), _median(F.col("__n.r")).alias("rtt_ms"), F.size("__n.r").cast("long").alias("hops"), F.when(behind.isNotNull(), name(behind)).alias("next"))


def _median(values: Column) -> Column:
    """Of an array, without its nulls; null if nothing is left."""
    v = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    n = F.size(v)
    at = lambda i: F.get(v, i.cast("int")).cast("double")
    return (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2


def nodes(view: DataFrame, keys: list[str], cycle: list[str]) -> DataFrame:
    """Cycles, modal layer (of equals the lowest), median rtt, times as last node.
    All of it comes from one count of equal rows."""
    last = F.col("next").isNull() if "next" in view.columns else F.max("layer").over(Window.partitionBy(*keys, *cycle)) == F.col("layer")
    equal = view.withColumn("__last", last.cast("long")).groupBy(*keys, "node", "layer", "rtt_ms").agg(F.count(F.lit(1)).alias("__n"), F.sum("__last").alias("__last"))
    equal = equal.withColumn("__k", F.sum("__n").over(Window.partitionBy(*keys, "node", "layer")))
    modal = F.min(F.struct((-F.col("__k")).alias("k"), "layer"))["layer"]
    return equal.groupBy(*keys, "node").agg(F.sum("__n").alias("n"), F.percentile("rtt_ms", 0.5, F.col("__n")).alias("median_rtt"), F.sum("__last").alias("n_last"), modal.alias("modal_layer"))


def edges(view: DataFrame, keys: list[str], cycle: list[str]) -> DataFrame:
    """How often one node follows another."""
    target = F.col("next") if "next" in view.columns else F.lead("node").over(Window.partitionBy(*keys, *cycle).orderBy("layer"))
    return view.withColumn("target", target).filter("target is not null").groupBy(*keys, F.col("node").alias("source"), "target").agg(F.count(F.lit(1)).alias("n"))
