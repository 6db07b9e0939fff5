"""Token counts (operator 1): the exact count at every prefix of a text.

A byte-pair encoding has the property that the last token of the encoding of a
prefix is the only vocabulary entry ``t`` that ends there, whose start is itself
the end of an encoded prefix, and that may stand next to that prefix's last
token.  So one left-to-right pass over a word fills a table
``count[j] = count[j - len(t)] + 1`` for all of its prefixes.  Words are joined
to whole texts by adding up differences, and the differences are what is stored:
one signed byte for each code point.  Every later question about truncation or
budgets is a running sum over that column; nothing is encoded again.

Defined results: a null text counts as empty (0 bytes, 0 tokens); empty tables
give empty tables; rows with equal or null ids are kept as they are; columns
other than the id and the text are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LATIN_LETTER, LATIN_NUMBER, LATIN_SPACE, LONG, NOT_LATIN, keeps, small_batches, working_on

#: Fixed value: how texts are split before merging (from the vocabulary's notes).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts below U+0300, where the standard library's faster engine
#: can express the classes.
LATIN_SPLIT = (
    rf"'(?:s|t|re|ve|m|ll|d)| ?{LATIN_LETTER}+| ?{LATIN_NUMBER}+| ?(?:[^\w{LATIN_SPACE}]|_)+"
    rf"|[{LATIN_SPACE}]+(?![^{LATIN_SPACE}])|[{LATIN_SPACE}]+"
)

#: Entries kept in a worker's word and pair tables before they start afresh.
#: They only save time; what is forgotten is computed again.
CACHE_ENTRIES = 1_000_000
CACHED_CHARS = 48


def _byte_letters() -> dict[int, str]:
    """Bytes to the letters that stand for them in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others, in order, for the
    code points from 256 on.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class _Words(dict):
    """word -> differences of the token count over its code points, as bytes."""

    def __init__(self, owner: "PrefixCounter"):
        super().__init__()
        self.owner = owner

    def __missing__(self, word: str) -> bytes:
        found = self.owner.word_deltas(word)
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = found
        return found


class PrefixCounter:
    """Exact prefix counts for a byte-level BPE vocabulary in tokenizers' format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.longest = max(map(len, self.vocab))
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for n, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = self.vocab[left], self.vocab[right]
            self.rank[a, b] = n
            self.parts[self.vocab[left + right]] = (n, a, b)
        self.letters = {b: c for b, c in _byte_letters().items()}
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.split = regex.compile(SPLIT).findall
        self.latin_split = re.compile(LATIN_SPLIT).findall
        self.not_latin = re.compile(NOT_LATIN).search
        self.runs = regex.compile(r"\s{2,}(?=\S)")
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words = _Words(self)
        self.pairs: dict[int, bool] = {}
        self.edges: dict[tuple[int, int], list[tuple[int, int, int]]] = {}

    def edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """The tokens at one side of ``token`` while it is merged together, from
        the whole to the byte: (token, rank it is made at, rank it is used up at)."""
        found = self.edges.get((token, side))
        if found is None:
            found, t, used = [], token, 1 << 60
            while True:
                made = self.parts.get(t)
                if made is None:
                    found.append((t, -1, used))
                    break
                found.append((t, made[0], used))
                t, used = made[side], made[0]
            self.edges[token, side] = found
        return found

    def may_follow(self, a: int, b: int) -> bool:
        """Whether no merge ever joins the last piece of ``a`` to the first of ``b``."""
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            known, rank = True, self.rank
            for x, made_x, used_x in self.edge(a, 2):
                for y, made_y, used_y in self.edge(b, 1):
                    n = rank.get((x, y))
                    # Merges of one rank run from the left: (x, y) loses to a merge
                    # that takes x from the left, and wins over one that takes y.
                    if n is not None and made_x <= n < used_x and made_y <= n <= used_y:
                        known = False
                        break
                if not known:
                    break
            if len(self.pairs) >= CACHE_ENTRIES:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def word_deltas(self, word: str) -> bytes:
        """The table of one pre-token, as differences over its code points."""
        raw = word.encode("utf-8", "surrogatepass")
        letters = self.letters
        s = "".join([letters[b] for b in raw])
        n, vocab, longest, pairs = len(s), self.vocab, self.longest, self.pairs
        count, last = [0] * (n + 1), [-1] * (n + 1)
        for j in range(1, n + 1):
            for i in range(max(0, j - longest), j):
                t = vocab.get(s[i:j])
                if t is not None:
                    if i:
                        ok = pairs.get(last[i] << 20 | t)
                        if ok is None:
                            ok = self.may_follow(last[i], t)
                        if not ok:
                            continue
                    last[j], count[j] = t, count[i] + 1
                    break
        if n != len(word):  # keep the ends of code points
            count = [0] + [count[j] for j in range(1, n + 1) if j == n or raw[j] & 0xC0 != 0x80]
        # No token is longer than 127 bytes here, so a step fits a signed byte.
        return bytes([(y - x) & 0xFF for x, y in zip(count, count[1:])])

    def total(self, word: str) -> int:
        return int(np.frombuffer(self.words[word], np.int8).sum(dtype=np.int64))

    def _plain(self, text: str) -> np.ndarray:
        """Differences for a text without special strings."""
        words, split = self.words, self.split if self.not_latin(text) else self.latin_split
        deltas = np.frombuffer(b"".join(map(words.__getitem__, split(text))), np.int8)
        runs = list(self.runs.finditer(text))
        if runs:
            # While a run of white space is the end of a prefix it is one piece;
            # once a word follows, its last character belongs to what follows.
            deltas = deltas.astype(np.int16)
            for m in runs:
                run, end = m.group(), m.end()
                d = self.total(run) - self.total(run[:-1]) - self.total(run[-1])
                if d:
                    deltas[end - 1] += d
                    deltas[end] -= d
        return deltas

    def deltas(self, text: str) -> np.ndarray:
        """int16 or int8: count of tokens at each code point's end, less the one before."""
        if not self.specials or not self.specials.search(text):
            return self._plain(text)
        parts, at = [], 0
        for m in self.specials.finditer(text):
            # Up to the last code point of a special string the prefix is plain text.
            before, mark = text[at : m.start()], m.group()
            d = self._plain(before + mark[:-1]).astype(np.int32)
            whole = int(d[: len(before)].sum()) + 1
            parts += [d, np.array([whole - int(d.sum())], np.int32)]
            at = m.end()
        parts.append(self._plain(text[at:]).astype(np.int32))
        return np.concatenate(parts)


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


keeps("token counts", counter.cache_clear)


SCHEMA = "id {id}, n_chars long, n_bytes long, n_tokens long, cut_chars long, prefix_deltas binary"


def token_table(df: DataFrame, tokenizer: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: id, n_chars, n_bytes, n_tokens, the code
    points of the longest prefix with at most ``limit`` tokens (cut_chars), and
    prefix_deltas, from which ``prefix_count`` answers for any prefix."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        working_on("token counts")
        c = counter(tokenizer)
        for b in batches:
            rows = []
            for text in b["text"]:
                d = c.deltas(text)
                counts = np.cumsum(d, dtype=np.int64)
                fits = np.flatnonzero(counts <= limit)
                small = d.astype(np.int8)
                if d.dtype != np.int8 and not np.array_equal(small, d):
                    raise OverflowError("a step of the token count does not fit a byte")
                rows.append((len(d), len(text.encode("utf-8", "surrogatepass")), int(counts[-1]) if len(d) else 0, int(fits[-1]) + 1 if len(fits) else 0, small.tobytes()))
            out = pd.DataFrame(rows, columns=["n_chars", "n_bytes", "n_tokens", "cut_chars", "prefix_deltas"])
            out.insert(0, "id", b["id"].to_numpy())
            yield out

    source = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return source.mapInPandas(run, SCHEMA.format(id=df.schema[id_col].dataType.simpleString())).withColumnRenamed("id", id_col)


@F.pandas_udf(LONG)
def prefix_count(deltas: pd.Series, chars: pd.Series) -> pd.Series:
    """Tokens of the first ``chars`` code points, from the stored differences."""
    return pd.Series([int(np.frombuffer(d, np.int8, count=min(int(n), len(d))).sum(dtype=np.int64)) for d, n in zip(deltas, chars)], dtype="int64")


@F.pandas_udf(LONG)
def longest_prefix(deltas: pd.Series, budget: pd.Series) -> pd.Series:
    """Code points of the longest prefix with at most ``budget`` tokens."""

    def one(d, n):
        fits = np.flatnonzero(np.cumsum(np.frombuffer(d, np.int8), dtype=np.int64) <= n)
        return int(fits[-1]) + 1 if len(fits) else 0

    return pd.Series([one(d, int(n)) for d, n in zip(deltas, budget)], dtype="int64")
