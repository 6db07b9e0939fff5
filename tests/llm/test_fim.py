"""Fill-in-middle: against a plain version, with chunks of any size, and against SQL."""

import hashlib
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import fim, queries

from test_operators import DOCS, SMALL, odd_docs


def brute(doc_id, text, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, h = len(units), hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "plain" if not text or re.search("<[PSM]>", text) else "spm" if h4 % 100 < 50 else "psm"
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, n, form, *((None, None) if form == "plain" else (len(p), len(m))), sha(out), sha(text))


def texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(["a", "é", "日", "🙂", "\n", "\n", "<", "P", "S", ">", "<P", "\r", " ", "some words\n"]) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_composed_chunk_functions_equal_one_pass():
    r = random.Random(3)
    for text in [*texts(300, 1), "<P>", "a<S>\n", "<<M>", "\n" * 9]:
        data, cuts = text.encode(), sorted(r.randint(0, len(text.encode())) for _ in range(r.randint(0, 6)))
        parts = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)])]
        f, n = fim.scan(parts)
        state, units = fim.entries(f, n)
        assert units[-1] == len(re.findall(r"[^\n]*\n|[^\n]+", text))
        assert (state[-1] // 2 == fim.FOUND) == bool(re.search("<[PSM]>", text)), text
        for start in range(fim.STATES):  # each start state by itself, byte by byte
            at, count = start, 0
            for c in data:
                kind = fim.CLASSES[c]
                count, at = count + fim.BEGUN[kind, at], fim.AFTER[kind, at]
            whole, number = fim.scan([data])
            assert (whole[0, start], number[0, start]) == (at, count)


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_forms_cuts_and_round_trip(spark, chunk):
    rows = [(i if i % 9 else 5, t, None, None, None) for i, t in enumerate(texts(60, chunk))]
    own = ["row", "n", "form", "piece", "output", "h1", "no", "id"]
    docs = spark.createDataFrame(rows, DOCS).unionByName(odd_docs(spark).select("doc_id", "text", "lang", "source", "n_chars")).withColumns({c: F.lit("own") for c in own})
    if chunk == 1:
        docs = docs.filter("coalesce(length(text), 0) < 100")
    pieces = fim.fill_in_middle(docs, chunk=chunk)
    got = Counter(tuple(r) for r in fim.digests(*fim.outputs(docs, chunk=chunk)).collect())
    assert got == Counter(brute(r.doc_id, r.text) for r in docs.collect())
    assert max(len(r.output) for r in pieces.collect()) <= chunk + 9 or chunk == 1 << 16
    assert fim.digests(*fim.outputs(docs.limit(0))).count() == 0


def test_shares_of_forms(spark):
    docs = spark.createDataFrame([(i, "a\nb\nc") for i in range(400)], "doc_id long, text string")
    forms = Counter(r.form for r in fim.fill_in_middle(docs, fim_pct=50, spm_pct=20).collect())
    assert 150 < forms["plain"] < 250 and 20 < forms["spm"] < 70 and forms["psm"] > 120


def test_ids_past_doubles_next_to_nulls(spark):
    docs = spark.createDataFrame([(2**62 + 1, "x\ny"), (None, "x")], "doc_id long, text string")
    assert {r.doc_id for r in fim.fill_in_middle(docs).collect()} == {2**62 + 1, None}


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    got = queries.op13_fill_in_middle(spark, SMALL).toPandas().astype(object)
    want = con.execute(queries.ORACLE_SQL["op13_fill_in_middle"]).df().astype(object)
    plain = lambda d: sorted(tuple(None if x != x else x for x in r) for r in d[sorted(d.columns)].itertuples(index=False, name=None))
    assert sorted(got.columns) == sorted(want.columns) and repr(plain(got)) == repr(plain(want))
    assert np.all(got.restored_sha256 == want.restored_sha256)
