"""Approximate nearest neighbours (operator 6): a navigable small-world graph
for each shard, with the shards' results merged.

Distinct vectors are dealt by hash into shards of a bounded size.  A shard's
graph is hierarchical: each vector is on level 0 and, with falling chance, on
the levels above.  On each level vectors are inserted in order; a vector is tied
to its nearest earlier ones, thinned so that none is nearer to another chosen
one than to the vector itself, ties run both ways, and lists that grow too long
are thinned again.  The earlier neighbours are found exactly, which a bounded
shard allows.  Lists are flat arrays with -1 where a list ends early.

Largest inner product becomes nearness at one length: each vector gets one more
coordinate that brings all of a shard to the same norm.

A query descends greedily through the levels, then runs a beam over level 0; all
queries of a block go through the graph in step.  Scores are computed again from
the original vectors in double precision.  Shards only add candidates, so the
merge (best k over shards) loses nothing; what may be missed is missed inside a
shard.  Recall against brute force is measured in the tests.

Copies of a vector are one entry with its k + 1 least ids, which is exact: no
other copy can be among the k nearest.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do rows with a null id; vectors of another length
than the query's are no candidates; fewer candidates than k give fewer rows;
empty tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle
from .vectors import is_valid, keyed

SHARD_ROWS = 8192
QUERY_ROWS = 1024
#: Ties chosen for a vector on its insertion; lists hold twice as many.
DEGREE = 16
#: Nearest earlier vectors that a vector's ties are chosen from.
CHOICE = 64
#: Width of the beam.
BEAM = 128
SEED = 6


def _thin(x: np.ndarray, of: np.ndarray, choice: np.ndarray, near: np.ndarray, degree: int) -> np.ndarray:
    """For each row of ``of`` up to ``degree`` of its choice (nearest first, -1
    where there is none): those nearer to it than to any taken before, then the
    nearest of the rest."""
    out = np.full((len(of), degree), -1, np.int32)
    for at in range(0, len(of), 512):
        rows = slice(at, at + 512)
        c, s = choice[rows], near[rows]
        n = len(c)
        taken = np.full((n, degree), -1, np.int32)
        count = np.zeros(n, np.int64)
        passed = np.zeros(c.shape, bool)
        for k in range(c.shape[1]):
            live = (c[:, k] >= 0) & (count < degree)
            if not live.any():
                continue
            r = np.flatnonzero(live)
            width = max(1, int(count[r].max()))
            t = taken[r][:, :width]
            between = np.einsum("ijk,ik->ij", x[t], x[c[r, k]])
            fits = ~((between > s[r, k][:, None]) & (t >= 0)).any(1)
            good = r[fits]
            taken[good, count[good]] = c[good, k]
            count[good] += 1
            passed[r[~fits], k] = True
        for k in range(c.shape[1]):  # room that is left goes to the nearest of the rest
            r = np.flatnonzero(passed[:, k] & (count < degree))
            taken[r, count[r]] = c[r, k]
            count[r] += 1
        out[rows] = taken
    return out


def _level(x: np.ndarray) -> np.ndarray:
    """Neighbour lists of one level, for vectors in the order of insertion."""
    n = len(x)
    width = min(CHOICE, max(1, n - 1))
    choice, near = np.full((n, width), -1, np.int32), np.full((n, width), -np.inf, np.float32)
    for at in range(0, n, 1024):
        stop = min(n, at + 1024)
        s = x[at:stop] @ x[:stop].T
        s[np.arange(stop)[None, :] >= np.arange(at, stop)[:, None]] = -np.inf
        w = min(width, stop)
        part = np.argpartition(-s, w - 1, axis=1)[:, :w] if w < stop else np.broadcast_to(np.arange(stop), s.shape).copy()
        v = np.take_along_axis(s, part, 1)
        order = np.argsort(-v, axis=1, kind="stable")
        part, v = np.take_along_axis(part, order, 1), np.take_along_axis(v, order, 1)
        choice[at:stop, :w] = np.where(np.isfinite(v), part, -1)
        near[at:stop, :w] = v
    own = _thin(x, np.arange(n), choice, near, DEGREE)
    # Both directions; lists longer than 2 * DEGREE are thinned.
    a, k = np.nonzero(own >= 0)
    b = own[a, k]
    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    s = np.einsum("ij,ij->i", x[src], x[dst])
    order = np.lexsort((dst, -s, src))
    src, dst, s = src[order], dst[order], s[order]
    size = np.bincount(src, minlength=n)
    col = np.arange(len(src)) - np.repeat(np.cumsum(size) - size, size)
    lists = np.full((n, 2 * DEGREE), -1, np.int32)
    fits = size[src] <= 2 * DEGREE
    lists[src[fits], col[fits]] = dst[fits]
    long = np.flatnonzero(size > 2 * DEGREE)
    if len(long):
        keep = (col < 4 * CHOICE) & ~fits
        place = np.zeros(n, np.int64)
        place[long] = np.arange(len(long))
        c, v = np.full((len(long), 4 * CHOICE), -1, np.int32), np.full((len(long), 4 * CHOICE), -np.inf, np.float32)
        c[place[src[keep]], col[keep]] = dst[keep]
        v[place[src[keep]], col[keep]] = s[keep]
        lists[long] = _thin(x, long, c, v, 2 * DEGREE)
    return lists


def build(vecs: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(augmented vectors, members of each level, neighbour lists of each level).
    Lists hold places among the level's members; members are in order."""
    scale = np.abs(vecs).max()
    v = vecs / scale
    norm = (v * v).sum(1)
    x = np.concatenate([v, np.sqrt(np.maximum(norm.max() - norm, 0))[:, None]], 1).astype(np.float32)
    rng = np.random.default_rng(SEED)
    top = np.floor(-np.log(1 - rng.random(len(x))) / math.log(DEGREE)).astype(int)
    top[0] = max(top.max(), 1)  # the entry is on every level
    members = [np.flatnonzero(top >= k) for k in range(top.max() + 1)]
    return x, members, [_level(x[m]) for m in members]


def search(index: tuple[np.ndarray, list[np.ndarray], list[np.ndarray]], queries: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores (-1: none) of up to ``beam`` vectors near each query."""
    x, members, lists = index
    q = np.concatenate([queries / np.abs(queries).max(1, keepdims=True), np.zeros((len(queries), 1))], 1).astype(np.float32)
    at = np.zeros(len(q), np.int64)  # the first member of each level is the same vector
    for m, nb in zip(members[:0:-1], lists[:0:-1]):
        at = np.searchsorted(m, at)
        best = np.einsum("ij,ij->i", x[m[at]], q)
        moving = np.arange(len(q))
        while len(moving):
            n = nb[at[moving]]
            s = np.where(n >= 0, np.einsum("ijk,ik->ij", x[m[n]], q[moving]), -np.inf)
            k = s.argmax(1)
            v = s[np.arange(len(moving)), k]
            up = v > best[moving]
            moving, n, k, v = moving[up], n[up], k[up], v[up]
            at[moving], best[moving] = n[np.arange(len(moving)), k], v
        at = m[at]
    nb, n_q, width = lists[0], len(q), min(beam, len(x))
    ids, scores, done = np.full((n_q, width), -1, np.int32), np.full((n_q, width), -np.inf, np.float32), np.zeros((n_q, width), bool)
    ids[:, 0], scores[:, 0] = at, np.einsum("ij,ij->i", x[at], q)
    seen = np.zeros((n_q, len(x)), bool)
    seen[np.arange(n_q), at] = True
    while True:
        open_ = np.where(done | (ids < 0), -np.inf, scores)
        k = open_.argmax(1)
        r = np.flatnonzero(np.isfinite(open_[np.arange(n_q), k]))
        if not len(r):
            return ids, scores
        done[r, k[r]] = True
        n = nb[ids[r, k[r]]]
        fresh = (n >= 0) & ~seen[r[:, None], n]
        seen[np.broadcast_to(r[:, None], n.shape)[fresh], n[fresh]] = True
        s = np.where(fresh, np.einsum("ijk,ik->ij", x[n], q[r]), -np.inf).astype(np.float32)
        all_s = np.concatenate([scores[r], s], 1)
        all_i = np.concatenate([ids[r], np.where(fresh, n, -1)], 1)
        all_d = np.concatenate([done[r], np.zeros(n.shape, bool)], 1)
        top = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
        scores[r], ids[r], done[r] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_i, top, 1), np.take_along_axis(all_d, top, 1)


INDEX_SCHEMA = "dim int, shard long, n long, vecs binary, ids binary, ends binary, levels array<struct<members binary, lists binary>>"


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["h1", "h2"])  # an order without meaning, the same on each run
    vecs = np.array(pdf["vec"].tolist(), "<f4")
    _, members, lists = build(vecs.astype(np.float64))
    ids = [np.asarray(i, "<i8") for i in pdf["ids"]]
    return pd.DataFrame({
        "dim": [int(pdf["dim"].iloc[0])], "shard": [int(pdf["shard"].iloc[0])], "n": [len(pdf)], "vecs": [vecs.tobytes()],
        "ids": [np.concatenate(ids).tobytes()], "ends": [np.cumsum([len(i) for i in ids]).astype("<i8").tobytes()],
        "levels": [[{"members": m.astype("<i4").tobytes(), "lists": nb.astype("<i4").tobytes()} for m, nb in zip(members, lists)]],
    })


def _shards(n: int) -> int:
    return max(1, math.ceil(n / SHARD_ROWS))


def build_index(df: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, int]:
    """(one row for each shard, number of shards) over every valid row."""
    rows = keyed(df, id_col, vec_col).filter(is_valid("vec") & F.col("id").isNotNull())
    least = rows.withColumn("rn", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).filter(F.col("rn") <= k + 1)
    entries = settle(least.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.first("vec").alias("vec")), "entries")
    shards = _shards(entries.count())
    dealt = entries.withColumns({"dim": F.size("vec"), "shard": F.pmod("h1", F.lit(shards)).cast("long")})
    return settle(dealt.groupBy("dim", "shard").applyInPandas(_build, INDEX_SCHEMA), "index"), shards


def _search_pairs(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                dim = int(row.dim)
                vecs = np.frombuffer(row.vecs, "<f4").reshape(int(row.n), dim).astype(np.float64)
                norm = ((vecs / np.abs(vecs).max()) ** 2).sum(1)
                x = np.concatenate([vecs / np.abs(vecs).max(), np.sqrt(np.maximum(norm.max() - norm, 0))[:, None]], 1).astype(np.float32)
                members = [np.frombuffer(v["members"], "<i4") for v in row.levels]
                lists = [np.frombuffer(v["lists"], "<i4").reshape(len(m), -1) for v, m in zip(row.levels, members)]
                ids, ends = np.frombuffer(row.ids, "<i8"), np.frombuffer(row.ends, "<i8")
                q_ids = np.asarray(row.q_ids, np.int64)
                q = np.frombuffer(row.q_vecs, "<f4").reshape(len(q_ids), dim).astype(np.float64)
                places, _ = search((x, members, lists), q)
                out = []
                for at, (own, found) in enumerate(zip(q_ids, places)):
                    p = np.sort(found[found >= 0])
                    score = (vecs[p] * q[at]).sum(1)
                    size = ends[p] - np.where(p > 0, ends[p - 1], 0)
                    ids_at = np.repeat(ends[p] - size, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    cand, sc = ids[ids_at], np.repeat(score, size)
                    other = cand != own
                    cand, sc = cand[other], sc[other]
                    best = np.lexsort((cand, -sc))[:k]
                    out.append(pd.DataFrame({"query_id": own, "vec_id": cand[best], "score": sc[best]}))
                yield pd.concat(out)

    return run


def nearest(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query row."""
    index, shards = build_index(df, k, id_col, vec_col)
    queries = settle(keyed(df.filter(is_query), id_col, vec_col).filter(is_valid("vec") & F.col("id").isNotNull()).select("id", "vec", F.size("vec").alias("dim")), "queries")
    blocks = max(1, math.ceil(queries.count() / QUERY_ROWS))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        return pd.DataFrame({"dim": [int(pdf["dim"].iloc[0])], "q_ids": [pdf["id"].tolist()], "q_vecs": [np.array(pdf["vec"].tolist(), "<f4").tobytes()]})

    packed = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).groupBy("dim", "block").applyInPandas(pack, "dim int, q_ids array<long>, q_vecs binary")
    asked = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>")))
    found = index.join(asked, ["dim", "shard"]).repartition(F.col("shard"), F.hash("q_ids")).mapInPandas(_search_pairs(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
