"""Licence scans (operator 2): TF-IDF cosine to templates, then inheritance.

Notices inside a text are found by comparing windows of words with licence
templates: sparse TF-IDF vectors over the templates' words, document frequencies
from all files scanned.  Only windows that hold a marking word (one that occurs
in few of the files) can reach the threshold, so only those are compared.  A
file is a licence file if its name says so or if nearly all its words belong to the
best notice.  Files without a notice of their own take the licence of the
nearest ancestor directory that holds a licence file: directories are joined by
path with all their ancestors, then files with their directory.

Defined results: a null text counts as empty; a null path has no directory, so
nothing is inherited; of several licences in one directory the one with the
higher score counts, ties to the smaller name; within a text likewise, ties to
the earlier place; repeated rows are kept; empty tables give empty tables; columns
other than id, path and text are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, small_batches

#: Notices by SPDX name.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights; CC0 1.0 Universal public domain dedication"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("LicenseRef-all-rights-reserved", "All rights reserved"),
    ("LicenseRef-public-domain", "This work is in the public domain"),
)
#: Names of licence files.
FILE_NAME = re.compile(r"^(?:licen[cs]es?|copying(?:\.lesser)?|unlicense|notice|copyright)(?:[.-][a-z0-9.-]*)?$", re.I)
THRESHOLD = 0.8
#: Parts that the rows of one directory are dealt into when they look up its licence.
SALTS = 16
#: Share of a text's words in its best notice from which on it is a licence file by content.
WHOLE = 0.9

_tokens = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*").finditer


def words(text: str) -> list[tuple[str, int, int]]:
    """Lower-case words with their places."""
    return [(m.group(), m.start(), m.end()) for m in _tokens(text.lower())]


_VOCABULARY = sorted({w for _, t in TEMPLATES for w, _, _ in words(t)})
_KNOWN = re.compile(r"(?<![a-z0-9])(?:" + "|".join(map(re.escape, sorted(_VOCABULARY, key=len, reverse=True))) + r")(?![a-z0-9])").findall


class Scanner:
    def __init__(self, frequency: dict[str, int], files: int):
        self.idf = {w: math.log((files + 1) / (frequency.get(w, 0) + 1)) + 1 for w in _VOCABULARY}
        self.unknown = math.log(files + 1) + 1
        self.templates = []
        for name, text in TEMPLATES:
            ws = [w for w, _, _ in words(text)]
            vec = {w: n * self.idf[w] for w, n in Counter(ws).items()}
            norm = math.sqrt(sum(x * x for x in vec.values()))
            self.templates.append((name, len(ws), {w: x / norm for w, x in vec.items()}))
        # Without its two heaviest words a template can't reach the threshold if
        # they carry more than 1 - threshold^2 of it; the words to look for are a
        # least set of heaviest words that no match can do without.
        self.markers: dict[str, list[int]] = {}
        for k, (_, _, vec) in enumerate(self.templates):
            rest = 1.0
            for w, x in sorted(vec.items(), key=lambda p: (-p[1], p[0])):
                self.markers.setdefault(w, []).append(k)
                rest -= x * x
                if rest < THRESHOLD**2 - 1e-9:
                    break

    def best(self, text: str) -> tuple[str | None, float, int, int, float]:
        """(licence, cosine, start, end, share of the words)."""
        ws = words(text)
        best: tuple[float, int, str, int] | None = None
        done: set[tuple[int, int]] = set()
        for at, (w, _, _) in enumerate(ws):
            for k in self.markers.get(w, ()):
                name, size, vec = self.templates[k]
                for lo in range(max(0, at - size + 1), at + 1):
                    if (k, lo) in done or lo + size > len(ws) and lo:
                        continue
                    done.add((k, lo))
                    part = Counter(x for x, _, _ in ws[lo : lo + size])
                    dot = norm = 0.0
                    for x, n in part.items():
                        weight = n * self.idf.get(x, self.unknown)
                        norm += weight * weight
                        dot += weight * vec.get(x, 0.0)
                    cos = round(dot / math.sqrt(norm), 9)
                    if cos >= THRESHOLD:
                        # Equal scores: the longer template, then the earlier place.
                        key = (cos, size, name, lo)
                        if best is None or (-cos, -size, name, lo) < (-best[0], -best[1], best[2], best[3]):
                            best = key
        if best is None:
            return None, 0.0, -1, -1, 0.0
        cos, size, name, lo = best
        last = min(lo + size, len(ws)) - 1
        return name, cos, ws[lo][1], ws[last][2], min(size, len(ws)) / len(ws)


def frequencies(texts: DataFrame) -> tuple[dict[str, int], int]:
    """Files with each template word (a fixed set), and the number of files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for b in batches:
            n[""] += len(b)
            for text in b["text"]:
                n.update(set(_KNOWN(text.lower())))
        if n:  # a partition may be empty
            yield pd.DataFrame({"w": list(n), "n": np.array(list(n.values()), np.int64)})

    found = {r["w"]: r["n"] for r in texts.mapInPandas(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()}
    return found, found.pop("", 0)


def scan(df: DataFrame, id_col: str, path_col: str, text_col: str) -> DataFrame:
    """Own notices: (id, path, license, score, start, end, whole) for every row;
    whole: the row is a licence file."""
    small_batches(df.sparkSession)
    source = df.select(F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known, files = frequencies(source.select("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(known, files)
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["text"]):
                name, score, lo, hi, share = scanner.best(text)
                base = path.rsplit("/", 1)[-1] if isinstance(path, str) else ""
                rows.append((name, score, lo, hi, name is not None and (share >= WHOLE or bool(FILE_NAME.match(base)))))
            out = pd.DataFrame(rows, columns=["license", "score", "start", "end", "whole"])
            out.insert(0, "path", b["path"].to_numpy())
            out.insert(0, "id", b["id"].to_numpy())
            yield out

    kind = df.schema[id_col].dataType.simpleString()
    return source.mapInPandas(run, f"id {kind}, path string, license string, score double, start int, end int, whole boolean")


def inherit(found: DataFrame) -> DataFrame:
    """(id, license, score, start, end, origin): origin is notice, inherited or null."""
    rows = found.withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).withColumn("dir", F.when(F.col("path").contains("/"), F.col("dir")))
    licensed = rows.filter("whole and dir is not null").groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("license").alias("l"))).alias("best"))
    licensed = licensed.select(F.col("dir").alias("ancestor"), F.col("best.l").alias("given"), (-F.col("best.s")).alias("given_score"))
    dirs = rows.filter("dir is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    ups = dirs.withColumn("depth", F.explode(F.sequence(F.lit(1), F.size(parts)))).withColumn("ancestor", F.array_join(F.slice(parts, 1, F.col("depth")), "/"))
    nearest = ups.join(licensed, "ancestor").groupBy(F.col("dir").alias("d")).agg(F.max_by(F.struct("given", "given_score"), "depth").alias("up"))
    # One directory may hold a third of all files: its one row is repeated for each salt.
    nearest = nearest.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id", "path"), F.lit(SALTS)).cast("int"))
    out = salted.join(nearest, (F.col("dir") == F.col("d")) & (F.col("salt") == F.col("s")), "left")
    own = F.col("license").isNotNull()
    return out.select(
        "id", F.coalesce("license", "up.given").alias("license"), F.when(own, F.col("score")).otherwise(F.coalesce("up.given_score", F.lit(0.0))).alias("score"),
        "start", "end", F.when(own, "notice").when(F.col("up").isNotNull(), "inherited").alias("origin"),
    )


def license_scan(df: DataFrame, id_col: str, path_col: str, text_col: str) -> DataFrame:
    """Each row's licence, its own or inherited."""
    return inherit(settle(scan(df, id_col, path_col, text_col), "notices"))
