"""Best-fit packing (operator 10): documents into sequences of a fixed length.

Bulk-synchronous best fit, largest first.  Documents are cut into pieces, and the
pieces range-sorted: every piece gets its rank among those of its length.  A round
takes one range of lengths, from the longest down, each half as long as the one
before.  Its pieces and all gaps that can take one of them are dealt by rank to
tasks.  Each task sweeps over its pieces and gaps in order of size: the successor
of a piece, the smallest gap that still takes it, receives it; where several want
one gap, the lower rank wins and the others go on to the next; gaps shrink and stay
in the sweep; new sequences are opened only where no gap fits.  What is left of the
gaps goes back to the table of gaps, and the next round deals it anew.  Sizes are
whole numbers up to the capacity, so a sweep moves over runs of equal pieces and
equal gaps, not over single ones.

A task holds about ``TASK_ROWS`` pieces and gaps as pairs of numbers, whatever the
corpus holds; the number of rounds depends on the capacity alone, and every round
is settled, so a lost executor repeats its own task.  With one task the result is
best-fit decreasing; with more, a round leaves at most one open sequence more for
each, which the shorter pieces of later rounds fill.  Ranks come from two levels of
prefix sums, so one length that holds most pieces is not one task.

Defined results: a null text counts as empty, so the document is the end id
alone; texts of any length are encoded whole; empty tables give empty tables;
repeated rows and null ids are packed like any others, ties in length by id, piece
and checksum; columns other than the id and the text are ignored, whatever their
names.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import LATIN_LETTER, LATIN_NUMBER, LATIN_SPACE, NOT_LATIN, keeps, settle, small_batches, working_on

#: Fixed value: how the vocabulary's texts are split into words.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for texts below U+0300, where the standard library's faster engine
#: can express the classes.
LATIN_SPLIT = rf"{LATIN_LETTER}+|'(?:s|t|re|ve|m|ll|d)|{LATIN_NUMBER}|(?:[^\w{LATIN_SPACE}]|_)+"

CACHE_ENTRIES = 1_000_000
CACHED_CHARS = 48
#: Buckets that the ranks of one size are counted in.  A bucket is one window
#: group, so this only spreads work; the ranks are the same for any value.
RANK_BUCKETS = 512
#: Pieces and gaps of a round's task, on average.
TASK_ROWS = 100_000
#: The last range holds all lengths up to this.
SHORT = 16


class WordEncoder:
    """Ids of whole texts; each distinct word goes through the library once."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = regex.compile(SPLIT).findall
        self.latin_split = re.compile(LATIN_SPLIT).findall
        self.not_latin = re.compile(NOT_LATIN).search
        self.words: dict[str, bytes] = {}
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        words = self.words
        # Special strings are no words; the library itself does texts with them.
        lists = [None if any(s in t for s in self.special) else self._split(t) for t in texts]
        if len(words) > CACHE_ENTRIES:
            words.clear()
        found: set[str] = set()
        for ws in lists:
            if ws:
                found.update(ws)
        missing = list(found.difference(words))
        for at in range(0, len(missing), 5000):
            self._learn(missing[at : at + 5000])
        out = [self._whole(t) if ws is None else b"".join(map(words.__getitem__, ws)) for t, ws in zip(texts, lists)]
        for w in missing:
            if len(w) > CACHED_CHARS:
                del words[w]
        return out

    def _split(self, text: str) -> list[str]:
        if self.not_latin(text):
            return self.split(self.tokenizer.normalizer.normalize_str(text))
        return self.latin_split(text.lower())  # such texts are in NFC as they are

    def _learn(self, new: list[str]) -> None:
        """All words in one call; a word's last token, and only that, ends a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(ends) != len(new):
            self.words.update((w, self._whole(w)) for w in new)
            return
        raw = ids.tobytes()
        self.words.update((w, raw[a:b]) for w, a, b in zip(new, [0, *ends], ends))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


keeps("packing", encoder.cache_clear)


def pieces(df: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of each document: id, piece, start, length, ids_crc32 and, if
    asked for, the ids themselves as little-endian 32-bit binary."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        working_on("packing")
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows = []
            for doc, ids in zip(b["id"].array, enc.encode(b["text"].tolist())):
                ids += end
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row = (doc, n, at // 4, len(part) // 4, zlib.crc32(part))
                    rows.append((*row, part) if with_ids else row)
            yield pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return source.mapInPandas(run, schema).withColumnRenamed("id", id_col)


def sweep(counts: dict[int, int], room: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], dict[int, list[tuple[int, int]]], int]:
    """One task's sweep over runs.  counts: pieces by size; room: gaps by room, numbered
    from 0 by room.  Returns runs (size, first rank, last rank + 1, first sequence,
    offset): rank r of the run goes to sequence ``first sequence + r - first rank``;
    the gaps left by room as runs (first sequence, number); the number of sequences,
    of which those from sum(room) on are new.

    Gap runs hold consecutive sequences with the same room.  A size takes whole
    runs or splits one, and opens at most one run, so the runs alive stay within a
    few times the number of sizes.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # room -> runs (first sequence, number)
    rooms: list[int] = []  # sorted
    plan, sequences = [], 0

    def add(room: int, first: int, n: int) -> None:
        if room > 0:
            if room not in gaps:
                gaps[room] = []
                bisect.insort(rooms, room)
            gaps[room].append((first, n))

    for size in sorted(room):
        add(size, sequences, room[size])
        sequences += room[size]
    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                # New sequences, filled with as many of this size as they hold.
                each = capacity // size
                full, rest = divmod(left, each)
                for k in range(each):
                    if full:
                        plan.append((size, rank, rank + full, sequences, k * size))
                        rank += full
                    if k < rest:
                        plan.append((size, rank, rank + 1, sequences + full, k * size))
                        rank += 1
                if full:
                    add(capacity - each * size, sequences, full)
                if rest:
                    add(capacity - rest * size, sequences + full, 1)
                sequences += full + bool(rest)
                break
            found = rooms[at]
            first, n = gaps[found].pop()
            if not gaps[found]:
                del gaps[found], rooms[at]
            take = min(n, left)
            plan.append((size, rank, rank + take, first, capacity - found))
            add(found - size, first, take)
            if n > take:
                add(found, first + take, n - take)
            rank, left = rank + take, left - take
    return plan, gaps, sequences


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """The runs of a sweep without gaps to start with."""
    return sweep(counts, {}, capacity)[0]


def ranges(capacity: int) -> list[tuple[int, int]]:
    """The rounds' lengths (least, most), longest first."""
    out, most = [], capacity
    while most > SHORT:
        out.append((most // 2 + 1, most))
        most //= 2
    return [*out, (1, most)]


#: length: a piece's length or a gap's room; rank: -1 for a gap; offset: -1 for a gap.
PLACED = "length long, rank long, sequence_id long, offset long"


def _round(n: int, capacity: int):
    """The task of round ``n``: pieces with their places, and the gaps that are left."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "rank", "sequence_id"])
        length, rank, seq = (pdf[c].to_numpy(np.int64) for c in ("length", "rank", "sequence_id"))
        gap = rank < 0
        sizes, held = (dict(zip(*(x.tolist() for x in np.unique(length[m], return_counts=True)))) for m in (~gap, gap))
        plan, left, total = sweep(sizes, held, capacity)
        new = total - int(gap.sum())
        numbers = np.concatenate([seq[gap], (n << 56) + (int(pdf["task"].iloc[0]) << 32) + np.arange(new)])
        # Pieces are sorted by length and rank: a length's pieces stand together.
        sizes_at = dict(zip(sizes, np.cumsum([0, *sizes.values()]).tolist()))
        place, offset = np.empty((~gap).sum(), np.int64), np.empty((~gap).sum(), np.int64)
        for size, lo, hi, first, at in plan:
            s = slice(sizes_at[size] + lo, sizes_at[size] + hi)
            place[s], offset[s] = np.arange(first, first + hi - lo), at
        open_ = [(room, first + np.arange(k)) for room, runs in sorted(left.items()) for first, k in runs]
        rest = np.concatenate([np.empty(0, np.int64), *(x for _, x in open_)])
        rooms = np.concatenate([np.empty(0, np.int64), *(np.full(len(x), room) for room, x in open_)])
        return pd.DataFrame({
            "length": np.concatenate([length[~gap], rooms]), "rank": np.concatenate([rank[~gap], np.full(len(rest), -1)]),
            "sequence_id": numbers[np.concatenate([place, rest]).astype(np.int64)], "offset": np.concatenate([offset, np.full(len(rest), -1)]),
        })

    return run


def ranked(parts: DataFrame, id_col: str) -> DataFrame:
    """Adds __rank, from 0 within each length."""
    order = [F.col(c) for c in (id_col, "piece", "ids_crc32")]
    hashed = parts.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(RANK_BUCKETS)).cast("int"))
    by_bucket = hashed.groupBy("length", "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = by_bucket.select("length", "__b", (F.sum("__n").over(Window.partitionBy("length").orderBy("__b")) - F.col("__n")).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("length", "__b").orderBy(*order)) - 1 + F.col("__before")
    return hashed.join(before, ["length", "__b"]).withColumn("__rank", rank).select(*parts.columns, "__rank")


def pack(parts: DataFrame, capacity: int, id_col: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` of 1 to capacity.

    ``parts`` is read twice and must not change in between: settle it first.
    """
    rows = settle(ranked(parts, id_col), "ranked")
    bands = ranges(capacity)
    which = F.lit(len(bands) - 1)
    for n, (least, _) in list(enumerate(bands))[-2::-1]:
        which = F.when(F.col("length") >= least, n).otherwise(which)
    held = {r["band"]: r["n"] for r in rows.groupBy(which.alias("band")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each range
    empty = F.lit(-1).cast("long")
    gaps, placed = None, None
    for n, (least, most) in enumerate(bands):
        if n not in held:
            continue
        todo = rows.filter(F.col("length").between(least, most)).select(F.col("length").cast("long").alias("length"), F.col("__rank").cast("long").alias("rank"), empty.alias("sequence_id"))
        total = held[n]
        if gaps is not None:
            fits = gaps.filter(F.col("length") >= least)
            total += fits.count()
            todo = todo.union(fits.select("length", "rank", "sequence_id"))
        tasks = max(1, -(-total // TASK_ROWS))
        # By rank; lengths and sequences start at different tasks, so that few are not all in one.
        dealt = todo.withColumn("task", F.pmod(F.when(F.col("rank") >= 0, F.col("rank") + F.col("length")).otherwise(F.xxhash64("sequence_id")), F.lit(tasks)))
        done = settle(dealt.groupBy("task").applyInPandas(_round(n, capacity), PLACED), f"round-{n}")
        left = done.filter("rank < 0")
        gaps = left if gaps is None else left.union(gaps.filter(F.col("length") < least))
        now = done.filter("rank >= 0")
        placed = now if placed is None else placed.union(now)
    if placed is None:
        return parts.select("*", empty.alias("sequence_id"), empty.alias("offset"))
    placed = placed.select(F.col("length").alias("__l"), F.col("rank").alias("__r"), "sequence_id", "offset")
    return rows.join(placed, (F.col("length") == F.col("__l")) & (F.col("__rank") == F.col("__r"))).select(*parts.columns, "sequence_id", "offset")


def pack_documents(df: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut what is longer than ``capacity``, and pack.  One row for each
    piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(settle(pieces(df, tokenizer, capacity, end_id, id_col, text_col), "pieces"), capacity, id_col)
