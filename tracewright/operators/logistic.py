"""Logistic regression with an L2 penalty (O43), for many models at once.

Rows are numbered over their series, and a model is a row of places: it learns from
[learn_from, learn_to) without [gap_from, gap_to), and is asked on [test_from, test_to).
So a fold with its purge is one gap, and a side of a scenario one range.  All models take
their Newton steps together: a job goes over the rows once, put together as arrays (``packed``),
each adds to the sums (gradient and Hessian) of the models that it teaches, tasks add up first what they hold,
and the steps are solved on the sums, a few numbers a model.  What has converged is left
out of later rounds.  No task holds a long series or fold of one; a series of at most
``ALONE`` rows is one bounded group, which saves it the jobs.

Null or NaN in a feature or label: the row teaches nothing, and without a feature its
probability is null.  Learning rows of one class (or none) give a model without weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import dropped, settled
from .windows import numbered

#: Added to the spread and to the weight of a row, bound of the exponent, last step.
SPREAD, WEIGHT, EXPONENT, STEP = 1e-9, 1e-6, 30.0, 1e-6
#: Models of up to this many numbers in all (8 MB) go to every task; more meet the rows by a shuffle.
SENT = 1 << 20
#: Rows of a series that meet in one task of that shuffle.
PART = 1 << 17
#: A series of up to this many rows takes all its steps in one group (about 10 MB of numbers).
ALONE = 1 << 17
PLACES = ["learn_from", "learn_to", "gap_from", "gap_to", "test_from", "test_to"]


def placed(rows: DataFrame, keys: list[str], order: list[str], features: list[str], label: str) -> DataFrame:
    """Settled rows with __id (their series), __pos, __x and __y (both null if unusable)."""
    x = F.array(*[F.col(c).cast("double") for c in features])
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v))
    y = F.nanvl(F.col(label).cast("double"), F.lit(None).cast("double"))
    one = rows.withColumns({"__id": F.to_json(F.struct(*keys)), "__x": F.when(whole, x), "__y": y})
    one = settled(one, "features")  # a range sort reads its rows twice
    out = settled(numbered(one, "__id", order, "__pos"), "places")
    dropped(one)
    return out


def folds(series: DataFrame, n: int, purge: int) -> DataFrame:
    """Models of contiguous folds over the places [__from, __from + __rows) of a series."""
    cut = lambda k: F.when(k == n, F.col("__rows")).otherwise(F.floor(k * (F.col("__rows") / n)))
    at = series.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumns({"test_from": F.col("__from") + cut(F.col("__k")), "test_to": F.col("__from") + cut(F.col("__k") + 1)})
    return at.filter("test_from < test_to").select(
        "__id", "__n", F.concat(F.lit("fold "), F.col("__k")).alias("model"), F.col("__from").alias("learn_from"), (F.col("__from") + F.col("__rows")).alias("learn_to"),
        (F.col("test_from") - purge).alias("gap_from"), (F.col("test_to") + purge).alias("gap_to"), "test_from", "test_to",
    )


def _few(n: int, width: int) -> bool:
    return n * (3 * width + len(PLACES) + 6) <= SENT


def beside(rows: DataFrame, models: DataFrame, width: int, n: int | None = None) -> DataFrame:
    """Each row with the models (``n``, if counted) of its series.  Few models are sent to the
    rows; many meet them by series and part, so that a long series is many groups."""
    if _few(models.count() if n is None else n, width):
        return rows.join(F.broadcast(models), "__id")
    dealt = models.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / PART))))
    return rows.withColumn("__part", F.floor(F.col("__pos") / PART)).join(dealt, ["__id", "__part"]).drop("__part")


def inside(low: str, high: str) -> Column:
    return (F.col("__pos") >= F.col(low)) & (F.col("__pos") < F.col(high))


def lessons(rows: DataFrame, models: DataFrame, width: int, n: int | None = None) -> DataFrame:
    """(row, model) for each row that the model learns from."""
    usable = rows.filter("__x is not null and __y is not null").select("__id", "__pos", "__x", "__y")
    return beside(usable, models, width, n).filter(inside("learn_from", "learn_to") & ~inside("gap_from", "gap_to"))


def begun(rows: DataFrame, models: DataFrame, width: int) -> DataFrame:
    """Models with learned (rows), share of class 1, mean and spread of each feature, weights of zero; one class: done."""
    each = lambda f: F.array(*[f(F.col("__x")[i]) for i in range(width)])
    facts = lessons(rows, models, width).groupBy("__id", "model").agg(
        F.count(F.lit(1)).alias("learned"), F.avg("__y").alias("share"), (F.min("__y") == F.max("__y")).alias("done"),
        each(F.avg).alias("mean"), each(lambda v: F.stddev_pop(v) + SPREAD).alias("spread"),
    )
    nothing = F.array(*[F.lit(0.0)] * width)
    return models.join(facts, ["__id", "model"], "left").withColumns({
        "learned": F.coalesce("learned", F.lit(0).cast("long")), "share": F.coalesce("share", F.lit(0.0)), "done": F.coalesce("done", F.lit(True)), "mean": F.coalesce("mean", nothing), "spread": F.coalesce("spread", nothing),
        "weights": F.array(*[F.lit(0.0)] * (width + 1)),
    }).withColumn("one_class", F.col("done"))


def exponent(width: int) -> Column:
    terms = " + ".join(["weights[0]", *[f"weights[{i + 1}] * (__x[{i}] - mean[{i}]) / spread[{i}]" for i in range(width)]])
    return F.expr(f"greatest(-{EXPONENT}D, least({EXPONENT}D, {terms}))")


def newton_sums(rows: DataFrame, models: DataFrame, width: int, n: int | None = None) -> DataFrame:
    """(__id, model, gradient, hessian): sums over the rows that a model learns from, at its
    weights and without the penalty; the constant first, the Hessian row by row from its diagonal on."""
    at = lessons(rows, models, width, n).select("__id", "model", "__y", (1 / (1 + F.exp(-exponent(width)))).alias("__p"), F.expr(f"array(1D, {', '.join(f'(__x[{i}] - mean[{i}]) / spread[{i}]' for i in range(width))})").alias("__z"))
    k = range(width + 1)
    at = at.selectExpr("__id", "model", "__y - __p AS __e", f"__p * (1 - __p) + {WEIGHT}D AS __v", *[f"__z[{i}] AS __z{i}" for i in k])
    gradient, hessian = [f"sum(__e * __z{i})" for i in k], [f"sum(__v * __z{i} * __z{j})" for i in k for j in k if i <= j]
    return at.groupBy("__id", "model").agg(F.expr(f"array({', '.join(gradient)})").alias("gradient"), F.expr(f"array({', '.join(hessian)})").alias("hessian"))


def packed(rows: DataFrame, width: int) -> DataFrame:
    """Settled rows that can teach, put together by Arrow batch and series (__id, __at, __label,
    __values: feature by feature), so that a step works on arrays and not on rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(k, g["__pos"].to_numpy(), g["__y"].to_numpy(), g.iloc[:, 3:].to_numpy(float).T.ravel()) for k, g in b.groupby("__id")]
            yield pd.DataFrame(found, columns=["__id", "__at", "__label", "__values"])

    usable = rows.filter("__x is not null and __y is not null").select("__id", "__pos", "__y", *[F.col("__x")[i].alias(f"__x{i}") for i in range(width)])
    return settled(usable.mapInPandas(run, "__id string, __at array<long>, __label array<double>, __values array<double>"), "packed")


def _teach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What the rows of a pack add to the sums of the models of their series."""
    for b in batches:
        found = []
        for r in b.itertuples(index=False, name=None):
            id_, pos, y, x, models = r
            x = np.reshape(x, (-1, len(pos)))
            for m in models:
                learn = (pos >= m["learn_from"]) & (pos < m["learn_to"]) & ~((pos >= m["gap_from"]) & (pos < m["gap_to"]))
                if not learn.any():
                    continue
                z = np.vstack([np.ones(learn.sum()), (x[:, learn] - np.array(m["mean"])[:, None]) / np.array(m["spread"])[:, None]])
                p = 1 / (1 + np.exp(-np.clip(np.array(m["weights"]) @ z, -EXPONENT, EXPONENT)))
                hessian = (z * (p * (1 - p) + WEIGHT)) @ z.T
                found.append((id_, m["model"], z @ (y[learn] - p), hessian[np.triu_indices(len(z))]))
        yield pd.DataFrame(found, columns=["__id", "model", "gradient", "hessian"])


def newton_sums_of(packs: DataFrame, models: DataFrame, width: int) -> DataFrame:
    """``newton_sums`` of ``packed`` rows, for models few enough to be sent to them."""
    own = models.groupBy("__id").agg(F.collect_list(F.struct("model", *PLACES[:4], "weights", "mean", "spread")).alias("__models"))
    at = packs.join(F.broadcast(own), "__id").mapInPandas(_teach, "__id string, model string, gradient array<double>, hessian array<double>")
    add = lambda name, n: F.array(*[F.sum(F.col(name)[i]) for i in range(n)]).alias(name)
    return at.groupBy("__id", "model").agg(add("gradient", width + 1), add("hessian", (width + 1) * (width + 2) // 2))


def stepped(w: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights (models x features) after a Newton step on the sums, and which have converged."""
    k = w.shape[1]
    r, full, (i, j) = np.r_[0.0, np.full(k - 1, penalty)], np.zeros((len(w), k, k)), np.triu_indices(k)
    full[:, i, j] = full[:, j, i] = hessian
    step = np.linalg.solve(full + np.diag(r), (gradient - r * w)[:, :, None])[:, :, 0]
    return w + step, np.abs(step).max(axis=1) < STEP


def _solve(penalty: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            go = b["gradient"].notna().to_numpy()
            if go.any():
                w, done = stepped(*(np.array(b.loc[go, c].tolist(), float) for c in ("weights", "gradient", "hessian")), penalty)
                weights, all_done = b["weights"].tolist(), b["done"].to_numpy().copy()
                all_done[go] = done
                for at, new in zip(np.flatnonzero(go), w):
                    weights[at] = new
                b = b.assign(weights=weights, done=all_done)
            yield b.drop(columns=["gradient", "hessian"])

    return run


def _alone(penalty: float, rounds: int):
    """All steps of the models of one short series."""

    def run(rows: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
        pos, x, y = rows["__pos"].to_numpy(), np.array(rows["__x"].tolist(), float), rows["__y"].to_numpy(float)
        weights, all_done = models["weights"].tolist(), models["done"].tolist()
        for at, m in enumerate(models.itertuples()):
            learn = (pos >= m.learn_from) & (pos < m.learn_to) & ~((pos >= m.gap_from) & (pos < m.gap_to))
            z = np.column_stack([np.ones(learn.sum()), (x[learn] - m.mean) / m.spread])
            w, done, (i, j) = np.array([m.weights], float), np.array([m.done]), np.triu_indices(z.shape[1])
            for _ in range(rounds):
                if done[0]:
                    break
                p = 1 / (1 + np.exp(-np.clip(z @ w[0], -EXPONENT, EXPONENT)))
                hessian = (z * (p * (1 - p) + WEIGHT)[:, None]).T @ z
                w, done = stepped(w, (z.T @ (y[learn] - p))[None], hessian[i, j][None], penalty)
            weights[at], all_done[at] = w[0], bool(done[0])
        return models.assign(weights=weights, done=all_done)

    return run


def fit(rows: DataFrame, models: DataFrame, width: int, penalty: float = 1.0, rounds: int = 50) -> DataFrame:
    """Settled models (``begun``'s columns) with weights on standardised features; the constant
    bears no penalty.  A series of at most ``ALONE`` rows takes all its steps in one group;
    the longer ones take a job a step.  Both make the same steps."""
    start = settled(begun(rows, settled(models, "ranges"), width), "models")
    few = F.col("__n") <= ALONE
    usable = rows.filter("__x is not null and __y is not null").select("__id", "__pos", "__x", "__y")
    usable = usable.join(start.filter(few & ~F.col("done")).select("__id").distinct(), "__id", "left_semi")
    short = usable.groupBy("__id").cogroup(start.filter(few & ~F.col("done")).groupBy("__id")).applyInPandas(_alone(penalty, rounds), start.schema)
    now = settled(short.unionByName(start.filter(~few | F.col("done"))), "models")
    dropped(start)
    packs = None
    for _ in range(rounds):
        left = now.filter(~few & ~F.col("done"))
        n = left.count()
        if not n:
            break
        if _few(n, width):
            long = left.select("__id").distinct()
            packs = packed(rows.join(F.broadcast(long), "__id", "left_semi"), width) if packs is None else packs
            sums = newton_sums_of(packs, left, width)
        else:
            sums = newton_sums(rows, left, width, n)
        with_sums = now.join(sums, ["__id", "model"], "left")
        new = settled(with_sums.mapInPandas(_solve(penalty), now.schema), "models")
        dropped(now)
        now = new
    if packs is not None:
        dropped(packs)
    return now


def asked(rows: DataFrame, models: DataFrame, width: int) -> DataFrame:
    """Rows with __model and probability for each model that is asked on them: one class
    gives its share.  Other columns of the rows may have the names of a model's."""
    own = [c for c in rows.columns if c not in ("__id", "__pos", "__x", "__y", "probability")]
    packed = rows.select("__id", "__pos", "__x", F.struct(*own).alias("__row"))
    p = 1 / (1 + F.exp(-exponent(width)))
    at = beside(packed, models, width).filter(inside("test_from", "test_to"))
    at = at.withColumn("__p", F.when(F.col("one_class"), F.col("share")).when(F.col("__x").isNotNull(), p))
    return at.select("__row.*", F.col("model").alias("__model"), F.col("__p").alias("probability"))
