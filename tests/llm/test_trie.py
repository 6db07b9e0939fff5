"""Conversation trie: against a plain version and SQL, with parts cut anywhere."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tracewright.llm import queries, trie

from test_operators import SMALL

CONV = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - (abs(c) % 5) * (1 if c > 0 else -1), [])[:h] + ts[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    out = []
    for path, cs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = lambda q: [p for p in members if len(p) == len(q) + 1 and p[: len(q)] == q]
        saved = sum((len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) for p in below)
        ends = ",".join(map(str, sorted(c for c in cs if len(convs[c]) == len(path))))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(cs), len(path), parent, len(cs), len(kids(path)), sum(not kids(p) for p in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def odd_rows(seed):
    r = random.Random(seed)
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice(["", "é", "hello", None])) for c in range(-7, 30) for t in range(r.randint(1, 6))]
    rows += [(40 + i, t, "user", f"copy {t}") for i in range(12) for t in range(14)]  # copies
    rows += [(70, t, "user", f"long {t}") for t in range(60)] + [(71, t, "user", f"long {t}") for t in range(60)]
    rows += [(5, None, "user", "no turn"), (5, None, None, None), (5, 1, "user", "tie"), (5, 1, "user", "tie"), (None, 1, "user", "no conversation"), (90, 0, "user", "x" * 9000)]
    return rows


def whole_convs(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}


@pytest.mark.parametrize("small", [False, True])
def test_trie(spark, monkeypatch, small):
    if small:  # parts of two ids, buckets of three turns, every node hot
        for name, value in {"ENDS": 2, "BUCKET": 3, "HOT": 10**6}.items():
            monkeypatch.setattr(trie, name, value)
    rows = odd_rows(4 + small)
    df = spark.createDataFrame(rows, CONV).withColumns({c: F.lit("own") for c in ("node", "depth", "key", "n", "parent", "x")})
    assert Counter(tuple(r) for r in trie.conversation_trie(df, 5, 9).collect()) == brute(rebuilt(rows))
    if small:
        assert Counter(tuple(r) for r in trie.conversation_trie(df.repartition(3)).collect()) == brute(whole_convs(rows))
        assert trie.conversation_trie(df.limit(0), 5, 9).count() == 0
        one = [(3, 0, "user", "alone")]
        assert Counter(tuple(r) for r in trie.conversation_trie(spark.createDataFrame(one, CONV)).collect()) == brute(whole_convs(one))


def test_a_conversation_spans_parts(spark):
    """Numbers and ends over many range parts, one conversation with most rows, one node with most ends."""
    rows = [(1, t, "user", f"t{t % 7}") for t in range(300)] + [(c, 0, "user", "same") for c in range(2, 200)]
    df = spark.createDataFrame(rows, CONV)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.conv_id, r.depth): r for r in trie.conversation_trie(df).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == 302 and got[1, 300].n_children == 0 and got[1, 1].n_children == 1
    assert got[2, 1].n_convs == 198 and got[2, 1].saved_tokens == 197 * 4
    assert got[2, 1].ends_sha256 == hashlib.sha256(",".join(map(str, range(2, 200))).encode()).hexdigest()


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SMALL}/conversations.parquet'")
    want = con.execute(queries.ORACLE_SQL["op12_conversation_trie"])
    names = [c[0] for c in want.description]
    got = queries.op12_conversation_trie(spark, SMALL).select(names).collect()
    assert Counter(tuple(r) for r in got) == Counter(map(tuple, want.fetchall()))
