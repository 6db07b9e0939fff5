"""Embedding near-duplicates (operator 8) with randomised-rotation binary codes.

Vectors are turned by one random rotation and reduced to the signs of their
coordinates; with each code x of a vector o its correction factor f = <x, o> is
stored.  For a query q, S = <x, q> / f estimates <o, q> without bias.  The error is
<e, q> * sqrt(1 - f^2) / f, with e the direction of x outside o; e is at right angles
to o, so |<e, q>| is never above sqrt(1 - <o, q>^2), and by the rotation's chance it
stays under ``DEVIATIONS`` / sqrt(dim - 1) of that but for less than one pair in
10^12.  The smaller of the two is the confidence bound: pairs whose estimate is under
the threshold by more than the bound there are settled by the code alone; all others
are computed again from the original vectors in double precision.  Up to 57
dimensions the bound is the certain one.

Candidates come from cells: each distinct vector goes to the nearest of a number
of centres (spherical k-means on a bounded sample, which sets the work and not the
result).  If o lies in the cell of c and q in that of d, a pair within distance r
needs |q - bisector of c and d| <= r, that is <q, d> - <q, c> <= r * |c - d|, and the
same for o with c and d exchanged.  A cell is compared with another one only if it
holds vectors for which that is true, and only these vectors are compared: exact
for any centres.  Clustered vectors leave few pairs of cells; vectors without any
clusters in many dimensions leave all.  Cells that hold more than a block are dealt
into blocks, so a cell with most vectors is not one task.  A task returns for each
vector how many rows it is linked with, and a spanning forest; pairs never leave
it.  Copies of a vector are one entry with a weight.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing, like rows with a null id (whose component_id is
null and kept false); vectors of different lengths don't link; repeated rows are rows
of their own; empty tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, unsettle
from .components import components, forest
from .vectors import is_valid, keyed

#: Distinct vectors in a block, on average.  Sets a task's memory, not the result.
BLOCK_ROWS = 8192
#: Centres of a vector length, at most, and sampled vectors they are fitted on, at most.
MAX_CENTRES, FIT_ROWS = 4096, 20_000
TILE = (1024, 4096)
SEED = 20
#: 2 exp(-x^2 / 2) < 10^-12.
DEVIATIONS = 7.53


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(SEED + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed codes, correction factors <x, o>, rotated vectors) of unit rows."""
    turned = unit @ rotation(unit.shape[1])
    factors = np.abs(turned).sum(1) / math.sqrt(unit.shape[1])
    return np.packbits(turned > 0, axis=1), factors, turned


def _unit(raw: bytes, n: int) -> np.ndarray:
    v = np.frombuffer(raw, "<f4").astype(np.float64).reshape(n, -1)
    v = v / np.abs(v).max(1, keepdims=True)  # squares of components stay finite
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _threshold(factors: np.ndarray, dim: int, least: float) -> np.ndarray:
    """For each code the least <x, q> of a pair with <o, q> >= ``least``: the estimate may
    be under it by the bound, which shrinks as <o, q> grows, so ``least`` decides."""
    f = np.clip(factors, 0.0, 1.0)
    chance = min(1.0, DEVIATIONS / math.sqrt(max(1, dim - 1)))
    return f * least - chance * np.sqrt(1 - f * f) * math.sqrt(1 - least * least)


def centres(sample: np.ndarray, n: int, rounds: int = 6) -> np.ndarray:
    """n unit centres of unit vectors, by spherical k-means from evenly spaced ones."""
    c = sample[np.linspace(0, len(sample) - 1, min(n, len(sample))).astype(int)]
    for _ in range(rounds):
        own = (sample @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, own, sample)
        size = np.sqrt((total * total).sum(1, keepdims=True))
        c = np.where(size > 1e-9, total / np.maximum(size, 1e-9), c)
    return c


def _visits(unit: np.ndarray, own: int, c: np.ndarray, reach: float) -> np.ndarray:
    """(rows, cells) True where a vector of cell ``own`` can have a partner in the cell."""
    near = unit @ c.T
    apart = np.sqrt(np.maximum(0.0, 2 - 2 * c @ c[own]))
    return near[:, own, None] - near <= reach * apart + 1e-9  # the margin covers rounding


BLOCK_SCHEMA = "dim int, cell long, sub long, n long, ids binary, weights binary, vecs binary, codes binary, factors binary, visits array<long>"


def _compare(a, b, c: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """Links between two packed blocks (or inside one), summed up: ids, weights
    linked to each, and each one's root."""
    same = (a["cell"], a["sub"]) == (b["cell"], b["sub"])
    dim, reach = int(a["dim"]), math.sqrt(2 - 2 * threshold)
    ua, ub = _unit(a["vecs"], a["n"]), _unit(b["vecs"], b["n"])
    ids_a, ids_b = np.frombuffer(a["ids"], "<i8"), np.frombuffer(b["ids"], "<i8")
    wa, wb = np.frombuffer(a["weights"], "<i8"), np.frombuffer(b["weights"], "<i8")
    # Only vectors that can have a partner in the other cell.
    ra, rb = np.arange(len(ua)), np.arange(len(ub))
    if a["cell"] != b["cell"]:
        both = c[[int(a["cell"]), int(b["cell"])]]
        ra, rb = np.flatnonzero(_visits(ua, 0, both, reach)[:, 1]), np.flatnonzero(_visits(ub, 1, both, reach)[:, 0])
    bits = np.unpackbits(np.frombuffer(a["codes"], np.uint8).reshape(len(ua), -1)[ra], axis=1, count=dim)
    signs = bits.astype(np.float32) * 2 - 1
    turned = (ub[rb] @ rotation(dim)).astype(np.float32)
    least = ((_threshold(np.frombuffer(a["factors"], "<f8")[ra], dim, threshold) - 1e-4) * math.sqrt(dim)).astype(np.float32)  # the margin covers single precision
    na, nb = np.zeros(len(ua), np.int64), np.zeros(len(ub), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for i in range(0, len(ra), TILE[0]):
        for j in range(i // TILE[1] * TILE[1] if same else 0, len(rb), TILE[1]):
            s, t = slice(i, i + TILE[0]), slice(j, j + TILE[1])
            x, y = np.nonzero(signs[s] @ turned[t].T >= least[s, None])
            x, y = ra[s][x], rb[t][y]
            if same:
                later = y > x
                x, y = x[later], y[later]
            for at in range(0, len(x), 1 << 16):
                u, v = x[at : at + (1 << 16)], y[at : at + (1 << 16)]
                ok = np.einsum("ij,ij->i", ua[u], ub[v]) >= threshold
                u, v = u[ok], v[ok]
                if len(u):
                    na += np.bincount(u, wb[v], len(ua)).astype(np.int64)
                    nb += np.bincount(v, wa[u], len(ub)).astype(np.int64)
                    found.append(forest(ids_a[u], ids_b[v]))
    ids = np.concatenate([ids_a, ids_b])
    n = np.concatenate([na, nb])
    if found:
        node, root = forest(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
    else:
        node = root = np.empty(0, np.int64)
    return ids[n > 0], n[n > 0], node, root


def _fitted(distinct: DataFrame) -> dict[int, np.ndarray]:
    """Centres for each vector length that fills more than one block; at most one length
    for each ``BLOCK_ROWS`` vectors is collected, and ``FIT_ROWS`` vectors of it."""
    sizes = distinct.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK_ROWS).collect()
    out = {}
    for r in sorted(sizes):
        own = distinct.filter(F.size("vec") == r["dim"])
        some = own.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("vec").collect()
        raw = np.array([x["vec"] for x in some], "<f4")
        out[int(r["dim"])] = centres(_unit(raw.tobytes(), len(raw)), min(MAX_CENTRES, math.ceil(r["n"] / BLOCK_ROWS)))
    return out


def link_summary(distinct: DataFrame, threshold: float) -> DataFrame:
    """Rows (id, n, root): n rows linked to id in one pair of blocks (root null),
    or a link id - root of a spanning forest (n null).

    distinct: id, vec, weight; ids and vectors each once.
    """
    spark, reach = distinct.sparkSession, math.sqrt(2 - 2 * threshold)
    shared = spark.sparkContext.broadcast(_fitted(distinct))  # at most MAX_CENTRES for a length
    single = np.zeros((1, 1))

    def place(batches):
        for b in batches:
            cells = np.zeros(len(b), np.int64)
            for dim, at in b.reset_index(drop=True).groupby("dim").groups.items():
                c = shared.value.get(int(dim))
                if c is not None:
                    raw = np.array(b["vec"].iloc[at].tolist(), "<f4").tobytes()
                    cells[at] = (_unit(raw, len(at)) @ c.T).argmax(1)
            yield b.assign(cell=cells)

    placed = distinct.select("id", "vec", "weight", F.size("vec").alias("dim")).mapInPandas(place, "id long, vec array<float>, weight long, dim int, cell long")
    placed = settle(placed, "cells")
    full = placed.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("subs")).filter("subs > 1")
    # At most one row for each BLOCK_ROWS vectors; the rows of a full cell stay where they are.
    dealt = placed.join(F.broadcast(full), ["dim", "cell"], "left").withColumn("sub", F.pmod(F.xxhash64("id"), F.coalesce("subs", F.lit(1)))).drop("subs")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        dim, cell = int(pdf["dim"].iloc[0]), int(pdf["cell"].iloc[0])
        raw = np.array(pdf["vec"].tolist(), "<f4").tobytes()
        unit = _unit(raw, len(pdf))
        codes, factors, _ = encode(unit)
        c = shared.value.get(dim)
        reached = np.zeros(1 if c is None else len(c), bool)
        for at in range(0, len(unit) if c is not None else 0, 1024):
            reached |= _visits(unit[at : at + 1024], cell, c, reach).any(0)
        reached[cell] = True
        return pd.DataFrame({
            "dim": [dim], "cell": [cell], "sub": [int(pdf["sub"].iloc[0])], "n": [len(pdf)], "ids": [pdf["id"].to_numpy("<i8").tobytes()], "weights": [pdf["weight"].to_numpy("<i8").tobytes()],
            "vecs": [raw], "codes": [codes.tobytes()], "factors": [factors.astype("<f8").tobytes()], "visits": [np.flatnonzero(reached).tolist()],
        })

    packed = settle(dealt.groupBy("dim", "cell", "sub").applyInPandas(pack, BLOCK_SCHEMA), "blocks")
    unsettle(placed)
    # Pairs of blocks by their keys alone: both must reach the other's cell.
    known = packed.select("dim", "cell", "sub", F.explode("visits").alias("to"))
    one, two = known.alias("one"), known.alias("two")
    there = (F.col("one.dim") == F.col("two.dim")) & (F.col("one.to") == F.col("two.cell")) & (F.col("two.to") == F.col("one.cell"))
    key = lambda x: F.struct(F.col(f"{x}.cell").alias("cell"), F.col(f"{x}.sub").alias("sub"))
    pairs = one.join(two, there).filter(key("one") <= key("two")).select(F.col("one.dim").alias("dim"), key("one").alias("lo"), key("two").alias("hi"))
    ends = pairs.select(F.col("dim").alias("d"), "lo", "hi", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("own"))
    sides = ends.join(packed.drop("visits"), (F.col("d") == F.col("dim")) & (F.col("own.cell") == F.col("cell")) & (F.col("own.sub") == F.col("sub"))).select("dim", "lo", "hi", "cell", "sub", "n", "ids", "weights", "vecs", "codes", "factors")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["cell", "sub"]).drop(columns=["lo", "hi"]).to_dict("records")
        ids, n, node, root = _compare(rows[0], rows[-1], shared.value.get(int(rows[0]["dim"]), single), threshold)
        return pd.concat([pd.DataFrame({"id": ids, "n": n, "root": None}), pd.DataFrame({"id": node, "n": None, "root": root})]).astype("Int64")

    return sides.groupBy("dim", "lo", "hi").applyInPandas(run, "id long, n long, root long")


def near_duplicates(df: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) for every row."""
    source = keyed(df, id_col, vec_col).withColumn("valid", is_valid("vec") & F.col("id").isNotNull())
    rows = settle(source.select("id", "h1", "h2", "valid"), "vector-keys")
    distinct = settle(source.filter("valid").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.first("vec").alias("vec"), F.count(F.lit(1)).alias("weight")), "distinct-vectors")
    links = settle(link_summary(distinct, threshold), "vector-links")
    roots = components(links.filter("root is not null"), "id", "root").select(F.col("node").alias("id"), F.col("root"))
    counts = links.filter("n is not null").groupBy("id").agg(F.sum("n").alias("n"))
    of_entry = distinct.select("h1", "h2", "id", "weight").join(counts, "id", "left").join(roots, "id", "left")
    of_entry = of_entry.select("h1", "h2", F.lit(True).alias("valid"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    out = rows.join(of_entry, ["h1", "h2", "valid"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
