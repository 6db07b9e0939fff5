"""Quality classifier (operator 7): hierarchical empirical Bayes over sites.

A logistic classifier turns a text into log odds of being good.  Each site's
share of good documents is a posterior mean: the sites' expected counts (sums of
document probabilities) are shrunk toward the level above, paths (source and
language) toward their host (source) and hosts toward the corpus.  How hard is
read from the data: the beta-binomial strength by moments over the sites of a
level.  A site with few documents stays near its parent, one with many speaks
for itself.  A document's posterior adds to its own log odds how its path's
prior differs from the corpus's.  Everything but the fit is grouped aggregation.

The classifier is fitted on at most ``fit_rows`` labelled rows (those with the
smallest hash of their id); all statistics of sites cover all documents.

Defined results: a null text counts as empty; null sources and languages are
sites of their own; repeated rows count as often as they stand there; labels
that are null or name no document are not used; without both labels in the fit
the classifier says nothing (log odds 0); texts of any length are read whole;
empty tables give empty tables; other columns, whatever their names, are ignored
by the classifier and come back as they were from ``keep_good``.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted, rows_of, settle, small_batches, text_of, unsettle, working_on

#: Labelled rows that the classifier is fitted on, at most.
FIT_ROWS = 20_000
#: Site tables up to this many rows are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 50_000
#: Most that a site can add to or take from a document's log odds.
SITE_PULL = 2.0

_SYMBOLS = re.compile(r"([#$%&*!?=~^+<>@_\-])\1+").findall
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
_CLASS[[9, 10, 11, 12, 13, 32]] = 5


def features(text: str) -> list[float]:
    """Shares that tell prose from junk in any language; the first is constant."""
    words = text.split()
    n = len(words)
    if not n:
        return [1.0] + [0.0] * 12 + [1.0]
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    other, lower, upper, digit, high, _ = np.bincount(_CLASS[raw], minlength=6).tolist()
    letters = max(1, lower + upper + high)
    distinct = Counter(words)
    lines = [x for x in text.split("\n") if x]
    return [
        1.0, upper / letters, digit / letters, other / letters, sum(1 for w in words if len(w) > 1 and w.isupper()) / n,
        len(_SYMBOLS(text)) / n, text.count("|") / n, sum(1 for a, b in zip(words, words[1:]) if a == b) / n,
        max(distinct.values()) / n, len(distinct) / n, 1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, len(lines) / n), np.log1p(n) / 10, 0.0,
    ]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps on standardised columns; returned
    for the columns as they are."""
    mean, scale = x.mean(0), x.std(0)
    mean[0], scale[0] = 0, 1
    scale[scale < 1e-9] = 1
    z = (x - mean) / scale
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * len(y) / 100 + 1e-3)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    w = w / scale
    w[0] -= mean @ w - mean[0] * w[0]
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> np.ndarray:
    """Weights of the classifier, from a bounded sample of labelled rows."""
    small_batches(docs.sparkSession)
    usable = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    usable = usable.join(docs.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")  # labels of absent documents take no seats
    sample = usable.orderBy(F.md5(F.col("id").cast("string")), "id").limit(fit_rows)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(sample), "id")  # at most fit_rows

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts])

    # One text for each id; md5 of the text breaks ties between repeated ids.
    found = rows.select("id", "y", F.md5("text").alias("m"), of("text").alias("x")).groupBy("id").agg(F.min(F.struct("m", "y", "x")).alias("r")).select("r.y", "r.x").collect()
    if len({r["y"] for r in found}) < 2:
        return np.zeros(14)
    order = sorted((tuple(r["x"]), int(r["y"])) for r in found)  # sums don't depend on the order rows came in
    return fit_logistic(np.array([x for x, _ in order]), np.array([y for _, y in order], float))


def evidence(weights: np.ndarray, text: Column) -> Column:
    """Log odds of being good, from the text alone."""

    @F.pandas_udf(T.DoubleType())
    def of(texts: pd.Series) -> pd.Series:
        working_on("quality")
        return pd.Series([float(np.clip(np.dot(features(t), weights), -20, 20)) for t in texts], dtype="float64")

    return of(text)


def _shrunk(sites: DataFrame, n: str, good: str, parent: str) -> Column:
    """Posterior mean of each site's share around ``parent``, with the strength
    that the spread of the sites about their parents asks for."""
    share = F.col(good) / F.col(n)
    p = F.col(parent)
    s = sites.agg(
        F.sum(F.col(n) * (share - p) ** 2).alias("between"), F.sum(p * (1 - p)).alias("noise"),
        F.sum(F.col(n) * p * (1 - p)).alias("total"),
    ).first()
    # E[n (share - p)^2] = p(1-p) (1 + (n - 1) rho); rho = 1 / (strength + 1).
    extra = (s["between"] or 0.0) - (s["noise"] or 0.0)
    room = (s["total"] or 0.0) - (s["noise"] or 0.0)
    rho = min(max(extra / room if room > 0 else 0.0, 1e-4), 0.5)
    strength = 1 / rho - 1
    return (F.col(good) + F.lit(strength) * p) / (F.col(n) + F.lit(strength))


def site_priors(evidences: DataFrame, host: str, path: str) -> tuple[DataFrame, float]:
    """((host, path, host_prior, path_prior), corpus share) from a column ``evidence``."""
    paths = settle(evidences.groupBy(F.col(host).alias("host"), F.col(path).alias("path")).agg(F.count(F.lit(1)).alias("n"), F.sum(1 / (1 + F.exp(-F.col("evidence")))).alias("good")), "sites")
    total = paths.agg(F.sum("n"), F.sum("good")).first()
    share = min(max(total[1] / total[0], 1e-6), 1 - 1e-6) if total[0] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good")).withColumn("corpus", F.lit(share))
    hosts = hosts.withColumn("host_prior", _shrunk(hosts, "host_n", "host_good", "corpus"))
    both = paths.join(hosts.select(F.col("host").alias("h"), "host_prior"), F.col("host").eqNullSafe(F.col("h"))).drop("h")
    priors = settle(both.withColumn("path_prior", _shrunk(both, "n", "good", "host_prior")).select("host", "path", "host_prior", "path_prior"), "priors")
    unsettle(paths)
    return priors, share


def with_posterior(df: DataFrame, priors: DataFrame, share: float, host: Column, path: Column, evidence: Column) -> DataFrame:
    """Adds __host_prior, __path_prior and __posterior to rows with evidence."""
    side = priors.select(F.col("host").alias("__h"), F.col("path").alias("__p"), F.col("host_prior").alias("__host_prior"), F.col("path_prior").alias("__path_prior"))
    if priors.count() <= BROADCAST_ROWS:
        side = F.broadcast(side)
    joined = df.join(side, host.eqNullSafe(F.col("__h")) & path.eqNullSafe(F.col("__p")), "left").drop("__h", "__p")

    def logit(p: Column) -> Column:
        q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
        return F.log(q / (1 - q))

    shift = logit(F.col("__path_prior")) - F.lit(float(np.log(share / (1 - share))))
    odds = evidence + F.least(F.greatest(shift, F.lit(-SITE_PULL)), F.lit(SITE_PULL))
    return joined.withColumn("__posterior", 1 / (1 + F.exp(-odds)))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: str = "source", path: str = "lang") -> DataFrame:
    """(id, host, path, evidence, host_prior, path_prior, posterior, kept) for every row."""
    weights = fit(docs, labels, id_col, text_col)
    scored = settle(docs.select(F.col(quoted(id_col)).alias("__id"), F.col(quoted(host)).alias("__host"), F.col(quoted(path)).alias("__path"), evidence(weights, text_of(text_col)).alias("evidence")), "evidence")
    priors, share = site_priors(scored, "__host", "__path")
    found = with_posterior(scored, priors, share, F.col("__host"), F.col("__path"), F.col("evidence"))
    return found.select(F.col("__id").alias(id_col), F.col("__host").alias(host), F.col("__path").alias(path), "evidence", F.col("__host_prior").alias("host_prior"), F.col("__path_prior").alias("path_prior"), F.col("__posterior").alias("posterior"), (F.col("__posterior") >= 0.5).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: str = "source", path: str = "lang") -> DataFrame:
    """The documents that the classifier doesn't reject, with their own columns and
    values, whatever these are called."""
    weights = fit(docs, labels, id_col, text_col)
    scored = rows_of(docs).withColumn("evidence", evidence(weights, text_of(quoted(text_col, "row."))))
    of_host, of_path = F.col(quoted(host, "row.")), F.col(quoted(path, "row."))
    priors, share = site_priors(scored.select(of_host.alias("__host"), of_path.alias("__path"), "evidence"), "__host", "__path")
    return with_posterior(scored, priors, share, of_host, of_path, F.col("evidence")).filter(F.col("__posterior") >= 0.5).select("row.*")
