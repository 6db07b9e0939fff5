"""Toxicity (operator 4): votes of the nearest labelled examples.

Texts are compared by exact TF-IDF cosine over words and the beginnings of words.
A term's TF-IDF weight is multiplied by how strongly the examples tie it to the
label: its likelihood ratio, where its share among toxic examples is the higher one
and the ratio passes what one term in a thousand reaches by chance, else nothing.
(Unweighted, neighbours share topics and not the label.)  No limit is set on terms.

The labelled examples are an inverted index with block maxima: examples are
numbered, cut into blocks, and each term stores the greatest weight it has in each
block.  A query adds up these maxima, looks at the blocks with the greatest bounds
first, and then at every other block whose bound reaches the k-th nearest found, so
the k nearest are exact.  Their votes, weighted by nearness and drawn toward the
examples' share of the label, give odds; a logistic curve fitted to the odds that
the examples get from each other (each without itself) turns them into calibrated
scores.  The neighbours are returned as evidence.  A text without any term of weight
is scored by the share of the label among examples without any.

The index holds at most ``fit_rows`` labelled documents (those with the smallest
hash of their id) outside the held-out fold; weights are fitted on them too.  Document
frequencies cover all documents.

Defined results: a null text counts as empty; texts of any length are read whole;
ties between neighbours go to the smaller id; labels that are null or name no
document are not used, and of documents that share an id one text is an example;
without both labels every score is the share of the label (0.5 if there are no
examples); repeated rows are scored each; empty tables give empty tables; other
columns, whatever their names, are ignored and come back from ``keep_clean``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import is_held_out, quoted, settle, small_batches, text_of, unsettle, working_on
from .quality import fit_logistic

#: Labelled rows in the index, at most.
FIT_ROWS = 6_000
#: Likelihood ratio that one term in a thousand reaches by chance.
CHANCE = 10.83
STEMS = (3, 4, 5, 6, 7)
#: Words that a worker remembers the terms of.
CACHED_WORDS = 200_000
BLOCK = 64
#: Blocks looked at before the others are held against the k-th nearest found.
FIRST_BLOCKS = 4
K = 16

_words = re.compile(r"[^\W\d_]+").findall


def terms(text: str) -> Counter:
    """Words (marked by a full stop) and beginnings of words, with their counts."""
    out: Counter = Counter()
    for w, n in Counter(_words(text.lower())).items():
        out[w + "."] += n
        for k in STEMS:
            if len(w) > k:
                out[w[:k]] += n
    return out


class Vocabulary:
    """Looks up only terms that count; remembers the words it has met."""

    def __init__(self, found: list[str]):
        self.whole = {t[:-1]: i for i, t in enumerate(found) if t.endswith(".")}
        self.stems = [(k, {t: i for i, t in enumerate(found) if len(t) == k and not t.endswith(".")}) for k in STEMS]
        self.stems = [(k, s) for k, s in self.stems if s]
        self.known: dict[str, tuple[int, ...]] = {}

    def of_word(self, w: str) -> tuple[int, ...]:
        found = [self.whole[w]] if w in self.whole else []
        found += [s[w[:k]] for k, s in self.stems if len(w) > k and w[:k] in s]
        if len(self.known) >= CACHED_WORDS:
            self.known.clear()
        self.known[w] = tuple(found)
        return self.known[w]

    def vector(self, text: str) -> dict[int, int]:
        out: dict[int, int] = {}
        known = self.known.get
        for w, n in Counter(_words(text.lower())).items():
            found = known(w)
            for i in self.of_word(w) if found is None else found:
                out[i] = out.get(i, 0) + n
        return out


def counts_of(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Terms and their counts, from pairs of 32-bit numbers."""
    pairs = np.frombuffer(raw, "<i4").reshape(-1, 2).astype(np.int64)
    return pairs[:, 0], pairs[:, 1]


def odds_of(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


class Index:
    """Block-max inverted index over unit TF-IDF vectors."""

    def __init__(self, ids: list[int], labels: list[int], vectors: list, idf: np.ndarray):
        """vectors: terms to counts, or arrays of both."""
        pairs = [(np.fromiter(v, np.int64, len(v)), np.fromiter(v.values(), np.int64, len(v))) if isinstance(v, dict) else v for v in vectors]
        self.idf = np.asarray(idf, float)
        order = sorted((i for i in range(len(ids)) if len(pairs[i][0])), key=lambda i: ids[i])
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.labels = np.array([labels[i] for i in order], np.int8)
        blank = [labels[i] for i in range(len(ids)) if not len(pairs[i][0])]
        self.share = (sum(labels) + 0.5) / (len(labels) + 1) if labels else 0.5
        self.blank = (sum(blank) + self.share) / (len(blank) + 1)
        self.blocks = max(1, -(-len(order) // BLOCK))
        self.curve = (0.0, 1.0)
        none = [np.empty(0, np.int64)]
        t = np.concatenate([pairs[i][0] for i in order] or none)
        place = np.repeat(np.arange(len(order)), [len(pairs[i][0]) for i in order])
        w = (1 + np.log(np.concatenate([pairs[i][1] for i in order] or none))) * self.idf[t]
        w /= np.sqrt(np.bincount(place, w * w, len(order)))[place]
        by_term = np.lexsort((place, t))
        t, self.where, self.weight = t[by_term], place[by_term].astype(np.int32), w[by_term]
        # For each term and block with an example of it, the greatest weight there.
        key = t * self.blocks + self.where // BLOCK
        cuts = np.flatnonzero(np.diff(key, prepend=-1))
        self.most = np.maximum.reduceat(self.weight, cuts) if len(cuts) else np.empty(0)
        self.most_at = (key[cuts] % self.blocks).astype(np.int32)
        #: term -> its stretch of where and weight, and of most_at and most
        self.postings: dict[int, tuple[int, int, int, int]] = {}
        seen, lo = np.unique(t, return_index=True)
        hi = [*lo[1:], len(t)]
        stretch = np.searchsorted(cuts, [*lo, len(t)]) if len(t) else [0]
        for k, term in enumerate(seen.tolist()):
            self.postings[term] = int(lo[k]), int(hi[k]), int(stretch[k]), int(stretch[k + 1])

    def unit(self, vector: dict[int, int]) -> dict[int, float]:
        w = {t: (1 + math.log(n)) * float(self.idf[t]) for t, n in sorted(vector.items())}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()} if norm else {}

    def nearest(self, vector: dict[int, int], k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """(places, cosines) of the k nearest examples with a positive cosine."""
        query = [(x, *self.postings[t]) for t, x in self.unit(vector).items() if t in self.postings]
        if not query:
            return np.empty(0, np.int64), np.empty(0)
        x = np.array([q[0] for q in query])
        stretches = lambda of, i: np.concatenate([of[q[i] : q[i + 1]] for q in query])
        times = lambda i: np.repeat(x, [q[i + 1] - q[i] for q in query])
        bound = np.bincount(stretches(self.most_at, 3), stretches(self.most, 3) * times(3), self.blocks)
        where, weight = stretches(self.where, 1), stretches(self.weight, 1) * times(1)
        block = where // BLOCK
        open_ = bound > 0
        if open_.sum() > FIRST_BLOCKS:
            first = np.argpartition(-bound, FIRST_BLOCKS - 1)[:FIRST_BLOCKS]
            inside = np.isin(block, first)
            s = np.bincount(where[inside], weight[inside])
            s = s[s > 0]
            if len(s) >= k:
                open_ = bound >= np.partition(s, len(s) - k)[len(s) - k] - 1e-9
        inside = open_[block]
        s = np.bincount(where[inside], weight[inside])
        places = np.flatnonzero(s > 0)
        sims = s[places]
        if len(places) > k:
            near = sims >= np.partition(sims, len(sims) - k)[len(sims) - k] - 1e-11
            places, sims = places[near], sims[near]
        best = np.lexsort((places, -np.round(sims, 12)))[:k]
        return places[best], sims[best]

    def votes(self, places: np.ndarray, sims: np.ndarray) -> float:
        """Log odds: votes by squares, so that many that are hardly near don't outweigh
        the prior share."""
        v = sims * sims / (1.1 - np.minimum(sims, 1.0))
        return odds_of((float(v @ self.labels[places]) + self.share) / (float(v.sum()) + 1))

    def without(self, example: int, vector: dict[int, int]) -> float | None:
        """The odds that an example gets from the others; None if it has no term."""
        if not vector:
            return None
        places, sims = self.nearest(vector, K + 1)
        other = self.ids[places] != example
        return self.votes(places[other][:K], sims[other][:K])

    def score(self, vector: dict[int, int]) -> tuple[float, np.ndarray, np.ndarray]:
        if not vector:
            return self.blank, np.empty(0, np.int64), np.empty(0)
        places, sims = self.nearest(vector)
        constant, slope = self.curve
        z = constant + slope * self.votes(places, sims)
        return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0))), places, sims


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_rows: int) -> DataFrame:
    """(id, y, text) of at most fit_rows labelled documents outside the held-out
    fold; of rows that share an id the text with the least md5 counts."""
    usable = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~is_held_out(id_col))
    one = usable.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    there = one.join(texts.select("id").distinct(), "id", "left_semi")  # labels of absent documents take no seats
    some = there.orderBy(F.md5(F.col("id").cast("string")), "id").limit(fit_rows)
    found = texts.join(F.broadcast(some), "id").groupBy("id").agg(F.first("y").alias("y"), F.min(F.struct(F.md5("text").alias("m"), "text")).alias("t"))  # at most fit_rows
    return found.select("id", "y", F.col("t.text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> tuple[Vocabulary, Index]:
    spark = docs.sparkSession
    small_batches(spark)
    rows = settle(_sample(docs, labels, id_col, text_col, label_col, fit_rows), "examples")

    def count_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n: dict[str, list[int]] = {}
            for y, text in zip(b["y"], b["text"]):
                for t in terms(text):
                    n.setdefault(t, [0, 0])[y] += 1
            yield pd.DataFrame({"term": list(n), "n0": [v[0] for v in n.values()], "n1": [v[1] for v in n.values()]})

    total = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    t0, t1 = total.get(0, 0), total.get(1, 0)
    ratios: dict[str, float] = {}
    if t0 and t1:
        counts = rows.mapInPandas(count_terms, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("a"), F.sum("n1").alias("b"))
        share = F.lit(float(t1)) / (t0 + t1)

        def part(n: Column, expected: Column) -> Column:
            return F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)

        a, b = F.col("a"), F.col("b")
        n = a + b
        ratio = 2 * (part(b, n * share) + part(a, n * (1 - share)) + part(t1 - b, (t0 + t1 - n) * share) + part(t0 - a, (t0 + t1 - n) * (1 - share)))
        tied = counts.withColumn("ratio", ratio).filter((F.col("ratio") > CHANCE) & (b / t1 > a / t0))
        ratios = {r["term"]: r["ratio"] for r in tied.select("term", "ratio").collect()}  # terms of the examples only
    found = sorted(ratios)
    vocabulary = Vocabulary(found)

    @F.pandas_udf(T.BinaryType())
    def vector(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array(sorted(vocabulary.vector(x).items()), "<i4").tobytes() for x in texts])

    vectors = settle(rows.select("id", "y", vector("text").alias("v")), "vectors")
    examples = sorted((r["id"], r["y"], bytes(r["v"])) for r in vectors.collect())  # at most fit_rows

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        working_on("toxicity")
        n: Counter = Counter()
        for b in batches:
            n[-1] += len(b)
            for text in b["text"]:
                n.update(vocabulary.vector(text).keys())
        if n:  # a partition may be empty
            yield pd.DataFrame({"t": list(n), "n": list(n.values())}).astype({"t": "int32", "n": "int64"})

    df = {r["t"]: r["n"] for r in docs.select(text_of(text_col).alias("text")).mapInPandas(frequencies, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()}  # a row for each term
    idf = np.array([(math.log((df.get(-1, 0) + 1) / (df.get(i, 0) + 1)) + 1) * ratios[t] for i, t in enumerate(found)])
    index = Index([e[0] for e in examples], [e[1] for e in examples], [counts_of(e[2]) for e in examples], idf)
    if t0 and t1:
        index.curve = _calibration(vectors, index)
    unsettle(rows, vectors)
    return vocabulary, index


def _calibration(vectors: DataFrame, index: Index) -> tuple[float, float]:
    """(constant, slope) of the logistic curve from the odds that examples get from the
    others to their labels; the odds as they are if the curve would turn them around."""
    shared = vectors.sparkSession.sparkContext.broadcast(index)  # bounded by fit_rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "z": [shared.value.without(int(i), dict(zip(*(x.tolist() for x in counts_of(v))))) for i, v in zip(b["id"], b["v"])]}).astype({"z": "float64"})

    got = [(r["y"], r["z"]) for r in vectors.mapInPandas(run, "y int, z double").collect() if r["z"] is not None and r["z"] == r["z"]]  # at most fit_rows
    shared.unpersist()
    if len({y for y, _ in got}) < 2:
        return 0.0, 1.0
    got.sort()
    constant, slope = fit_logistic(np.array([(1.0, z) for _, z in got]), np.array([y for y, _ in got], float)).tolist()
    return (constant, slope) if slope > 0 else (0.0, 1.0)


def score_of(docs: DataFrame, model: tuple[Vocabulary, Index], text: Column) -> Column:
    """struct(score, neighbours) for a text column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by fit_rows

    kind = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("neighbours", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("cosine", T.DoubleType())])))])

    @F.pandas_udf(kind)
    def of(texts: pd.Series) -> pd.DataFrame:
        working_on("toxicity")
        vocabulary, index = shared.value
        scores, near = [], []
        for text in texts:
            s, places, sims = index.score(vocabulary.vector(text))
            scores.append(s)
            near.append([{"id": int(index.ids[p]), "label": int(index.labels[p]), "cosine": float(c)} for p, c in zip(places, sims)])
        return pd.DataFrame({"score": pd.Series(scores, dtype="float64"), "neighbours": pd.Series(near, dtype="object")})

    return of(text)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, held_out, score, predicted, neighbours) for every row."""
    model = fit(docs, labels, id_col, text_col, label_col)
    scored = docs.select(F.col(quoted(id_col)).alias("__id"), is_held_out(id_col).alias("held_out"), score_of(docs, model, text_of(text_col)).alias("s"))
    return scored.select(F.col("__id").alias(id_col), "held_out", F.col("s.score").alias("score"), (F.col("s.score") >= 0.5).cast("int").alias("predicted"), F.col("s.neighbours").alias("neighbours"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The documents scored under 0.5, with their own columns."""
    model = fit(docs, labels, id_col, text_col, label_col)
    return docs.filter(score_of(docs, model, text_of(text_col)).getField("score") < 0.5)
