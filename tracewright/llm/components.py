"""Connected components of a link table, without collecting it anywhere.

``forest`` shrinks the links found inside one task to a spanning forest, so a
group of n linked rows leaves the task as at most n - 1 links.  ``components``
joins the forests by alternating large-star and small-star steps: in each step a
node's neighbours are attached to the least of them, until every node hangs on
the least node of its component.  Steps are aggregates with map-side combining
and joins; each is settled in the shared folder, so nothing depends on a chain
of recomputations.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, unsettle


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a[i], b[i]) as (node, least node it is linked with), nodes that are
    that least node themselves left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        if np.array_equal(p, q):
            break
        low = np.minimum(p, q)
        np.minimum.at(root, p, low)
        np.minimum.at(root, q, low)
        while not np.array_equal(root, root[root]):
            root = root[root]
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has a link; root is the component's least node."""
    cur = settle(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "links")
    seen = None
    while True:
        state = cur.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(low.select(F.col("u").alias("w"), "m"), F.col("u") == F.col("w")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, cur = cur, settle(low.select("u", F.col("m").alias("v")).union(rest).distinct(), "links")
        unsettle(before)
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
