"""SimHash near-duplicates (operator 5) by multi-index hashing.

Fingerprints have 64 bits; two link if at most 4 differ.  The bits are cut into
three segments.  Four differences over three segments leave one segment with at
most one, so every link is found by looking up, for each segment, the Hamming
ball of radius one around its value (itself and each single flip) in a table of
the exact values, and checking the whole distance of what is found.

Equal fingerprints are one entry, so copies cost nothing.  Within a bucket the
links found are cut down to a spanning forest at once: no pairs are written.
What a bucket has to hold is its distinct fingerprints, 8 bytes each.

Defined results: a null or blank text has fingerprint zero and links like any
other; repeated rows stay rows of their own; rows with a null id get the
component's least id, or null if it has none; texts of any length are read
whole; empty tables give empty tables; other columns, whatever their names, are
ignored and come back as they were from ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted, rows_of, settle, small_batches, text_of, unsettle, working_on
from .components import components, forest

MAX_DIFFERENCE = 4
#: (lowest bit, bits) of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Pairs compared at once in a worker; bounds memory only.
CHUNK = 1 << 19

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str, width: int = 4, seed: int = 42) -> int:
    """Majority of each bit of the shingles' XXH64, as an unsigned number."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()  # splits at ASCII white space
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= width:
        shingles = [joined]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        starts = np.concatenate([[0], ends[:-1]])
        shingles = [joined[i:j] for i, j in zip(starts[: n - width + 1].tolist(), (ends[width - 1 :] - 1).tolist())]
    hashes = xxhash.xxh64_intdigest
    h = np.array([hashes(s, seed) for s in shingles], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp): the fingerprint as a signed 64-bit number."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        working_on("simhash")
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in b["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"id": b["id"], "fp": fp})

    source = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return source.mapInPandas(run, f"id {df.schema[id_col].dataType.simpleString()}, fp long").withColumnRenamed("id", id_col)


def fingerprint_of(text: Column, width: int = 4) -> Column:
    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64))

    return of(text)


def _linked(fp: np.ndarray, start: np.ndarray, tables: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside buckets: bucket g holds fp[start[g] : start[g] + size[g]], of
    which the first tables[g] are table entries and the others probes."""
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def check(i: np.ndarray, j: np.ndarray) -> None:
        ok = (i < j) & (np.bitwise_count(fp[i] ^ fp[j]) <= MAX_DIFFERENCE) & (fp[i] != fp[j])
        if ok.any():
            found.append(forest(fp[i[ok]], fp[j[ok]]))

    pairs = tables * size
    big = pairs > CHUNK
    for g in np.flatnonzero(big):
        s, t, n = start[g], tables[g], size[g]
        step = max(1, CHUNK // 4096)
        for a in range(s, s + t, step):
            i = np.arange(a, min(a + step, s + t))
            for b in range(a, s + n, 4096):
                j = np.arange(b, min(b + 4096, s + n))
                check(np.repeat(i, len(j)), np.tile(j, len(i)))
    small = np.flatnonzero(~big & (size > 1))
    at = 0
    while at < len(small):
        ends = np.cumsum(pairs[small[at:]])
        take = max(1, int(np.searchsorted(ends, CHUNK, "right")))
        g = small[at : at + take]
        n = pairs[g]
        own = np.repeat(np.arange(len(g)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        check(start[g][own] + k // size[g][own], start[g][own] + k % size[g][own])
        at += take
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return forest(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))


def _bucket_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by bucket, table entries first."""

    def links(held: list[pd.DataFrame]) -> pd.DataFrame:
        b = pd.concat(held) if len(held) > 1 else held[0]
        key, probe, fp = b["key"].to_numpy(np.int64), b["probe"].to_numpy(np.int8), b["fp"].to_numpy(np.int64).view(np.uint64)
        start = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
        size = np.diff(np.concatenate([start, [len(key)]]))
        tables = np.add.reduceat(1 - probe.astype(np.int64), start)
        x, y = _linked(fp, start, tables, size)
        return pd.DataFrame({"a": x.view(np.int64), "b": y.view(np.int64)})

    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        key = b["key"].to_numpy(np.int64)
        cut = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
        if cut or (held and held[-1]["key"].iloc[-1] != key[-1]):
            head = [*held, b.iloc[:cut]] if cut else held
            yield links(head)
            held = []
        held.append(b.iloc[cut:])
    if held:
        yield links(held)


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """(a, b): a spanning forest of the links between the fingerprints in ``fp``."""

    def segment(lo: int, bits: int):
        return F.expr(f"shiftrightunsigned(fp, {lo})").bitwiseAND(F.lit((1 << bits) - 1))

    def exact():
        return F.explode(F.array(*[segment(lo, bits) + F.lit(n << 32) for n, (lo, bits) in enumerate(SEGMENTS)])).alias("key")

    def flipped():
        # Of two values that differ in one bit, one has a 0 there: it asks for the
        # other.  So only zeros are flipped, and each link is looked up once.
        cells = []
        for n, (lo, bits) in enumerate(SEGMENTS):
            for bit in (1 << k for k in range(bits)):
                cells.append(F.when(segment(lo, bits).bitwiseAND(F.lit(bit)) == 0, segment(lo, bits) + F.lit(bit + (n << 32))))
        return F.explode(F.array_compact(F.array(*cells))).alias("key")

    entries, probes = distinct.select("fp", exact()), distinct.select("fp", flipped())
    every = entries.select("key", F.lit(0).cast("byte").alias("probe"), "fp").union(probes.select("key", F.lit(1).cast("byte"), "fp"))
    return every.repartition("key").sortWithinPartitions("key", "probe", "fp").mapInPandas(_bucket_links, "a long, b long")


def _classes(docs: DataFrame, id_col: str) -> DataFrame:
    """(fp, component_id) for each fingerprint in settled (id, fp) rows."""
    first = settle(docs.groupBy("fp").agg(F.min(id_col).alias("first")), "distinct")
    roots = components(fingerprint_links(first.select("fp")), "a", "b")
    linked = roots.join(first, roots["node"] == first["fp"]).select("node", "root", "first")
    of_root = linked.groupBy("root").agg(F.min("first").alias("least"))
    of_node = linked.join(of_root, "root").select(F.col("node").alias("fp"), "least")
    return first.join(of_node, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fingerprint, component_id) for every row."""
    docs = settle(fingerprints(df, id_col, text_col, width), "fingerprints")
    return docs.join(_classes(docs, id_col), "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """One row of each component, the one with the least id, with its own columns.

    Of rows that share that id the one with the least fingerprint, then the least
    md5 of text and columns, stays; rows with a null id stay only in components
    without any other.  An id that one row has settles it without its fingerprint;
    only rows with shared or null ids are fingerprinted again."""
    docs = settle(fingerprints(df, id_col, text_col, width), "fingerprints")
    classes = settle(_classes(docs, id_col), "classes")
    shared = docs.groupBy(F.col(id_col).alias("__id")).agg(F.count(F.lit(1)).alias("__rows"))
    least = docs.join(classes, "fp").filter(F.col(id_col).eqNullSafe(F.col("component_id")))
    # Where ids are null, one fingerprint of the component stands for it.
    chosen = least.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min("fp").alias("__fp")).join(shared, "__id")
    chosen = settle(chosen, "chosen")
    nameless = least.filter(F.col(id_col).isNull()).select(F.lit(None).cast(df.schema[id_col].dataType).alias("__id"), F.col("fp").alias("__fp")).distinct()
    own = F.col(quoted(id_col, "row."))
    rows = rows_of(df)
    single = rows.join(chosen.filter("__rows = 1").select("__id"), own == F.col("__id"), "left_semi")
    # The rest: few ids, so their rows alone meet their keys by id and fingerprint.
    keys = chosen.filter("__rows > 1").select("__id", "__fp").union(nameless)
    many = rows.join(keys.select("__id").distinct(), own.eqNullSafe(F.col("__id")), "left_semi")
    many = many.withColumn("__fp1", fingerprint_of(text_of(quoted(text_col, "row.")), width))
    many = many.join(keys, own.eqNullSafe(F.col("__id")) & (F.col("__fp1") == F.col("__fp")))
    comparable = [F.col(quoted(f.name, "row.")) for f in df.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    # Equal keys and texts come down to one candidate before rows meet.
    order = F.struct(F.md5(text_of(quoted(text_col, "row."))), F.xxhash64(*comparable))
    first = many.groupBy("__id", "__fp").agg(F.min_by("row", order).alias("row"))
    return single.select("row.*").union(first.select("row.*"))
