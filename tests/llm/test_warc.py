"""WARC packages: round trips, foreign packages, ZIP64, and the query against SQL."""

import base64
import hashlib
import io
import json
import random
import subprocess
import sys
import zipfile
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tracewright.llm import queries, warc

from test_operators import SMALL

PAGES = "page_id long, url string, html string"


def brute(rows, least):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2] or ""].append((r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    out = []
    for html, found in groups.items():
        data = html.encode()
        for k, (none, id_, *_) in enumerate(sorted(found)):
            first = sorted(found)[0]
            revisit = k > 0 and len(data) >= least
            digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
            out.append((None if none else str(id_), len(data), digest, "revisit" if revisit else "response", str(first[1]) if revisit and not first[0] else None))
    return Counter(out)


def odd_pages():
    rows = [(i, f"http://h/{i}", f"<p>page {i}</p>") for i in range(30)]
    rows += [(100 + i, f"http://h/é?{i}\r\nX: 1%41", "the same page of many") for i in range(40)]
    rows += [(7, "u", "twice"), (7, "u", "twice"), (7, None, "twice"), (None, None, "twice"), (None, "a", "alone"), (None, "b", "alone"), (8, "u", None), (9, "u", ""), (10, "u", "x\r\n\r\n日本" * 50_000), (2**62 + 1, "u", "\x00\x1f\x8b")]
    return rows


@pytest.mark.parametrize("least,member,package", [(0, 1 << 24, 1 << 27), (6, 300, 1500)])
def test_round_trip(spark, least, member, package):
    df = spark.createDataFrame(odd_pages(), PAGES).withColumns({c: F.lit("own") for c in ("id", "digest", "size", "payload", "n", "source")}).repartition(3)
    packages = warc.write_packages(df, "page_id", least, member_bytes=member, package_bytes=package)
    records = warc.read_packages(packages)
    assert Counter(tuple(r) for r in warc.digests(records).collect()) == brute(odd_pages(), least)
    texts = {r[2] or "" for r in odd_pages()}
    for r in records.collect():
        assert r.url in {x[1] for x in odd_pages()}
        assert (r.payload is None) == (r.type == "revisit") and (r.payload is None or r.payload.decode() in texts)
        if r.payload is not None:
            assert r.http_length == len(r.payload) and r.declared_digest == "sha1:" + base64.b32encode(hashlib.sha1(r.payload).digest()).decode()
    assert (packages.count() > 10) == bool(least)
    assert warc.digests(warc.read_packages(warc.write_packages(df.limit(0)))).count() == 0


def records(n):
    return [warc.warc_record("response", f"0-{i}", f"http://x/{i}", str(i), f"text {i} ".encode() * i, len(f"text {i} ") * i, "D") for i in range(n)]


def package_file(tmp_path, name, build, before=b"", **zip_args):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", **zip_args) as z:
        build(z)
    (tmp_path / name).write_bytes(before + data.getvalue())
    return f"file://{tmp_path / name}"


def test_foreign_packages(spark, tmp_path, monkeypatch):
    """Deflated and unindexed archives, plain and compressed indexes, bytes before the archive, a comment, ZIP64."""
    gz = [warc.gzipped(r) for r in records(20)]

    def indexed(z, index_name, wrap, method=zipfile.ZIP_STORED):
        z.writestr("archive/a.warc.gz", b"".join(gz), zipfile.ZIP_STORED)
        at, lines = 0, []
        for g in gz:
            lines.append(f"key 2020 {json.dumps({'offset': at, 'length': len(g), 'filename': 'a.warc.gz'})}\n")
            at += len(g)
        random.Random(1).shuffle(lines)
        z.writestr(index_name, wrap("".join(lines).encode()), method)
        z.writestr("pages/pages.jsonl", b"{}")
        z.comment = b"PK\5\6 a comment that looks like an end record"

    paths = [
        package_file(tmp_path, "plain.zip", lambda z: z.writestr("archive/a.warc", b"".join(records(20)))),
        package_file(tmp_path, "deflated.zip", lambda z: z.writestr("archive/a.warc", b"".join(records(20)), zipfile.ZIP_DEFLATED)),
        package_file(tmp_path, "unindexed.zip", lambda z: z.writestr("archive/a.warc.gz", b"".join(gz))),
        package_file(tmp_path, "deflated2.zip", lambda z: z.writestr("archive/a.warc.gz", b"".join(gz), zipfile.ZIP_DEFLATED)),
        package_file(tmp_path, "indexed.zip", lambda z: indexed(z, "indexes/i.cdxj", bytes), b"bytes before"),
        package_file(tmp_path, "index-gz.zip", lambda z: indexed(z, "indexes/i.cdxj.gz", lambda b: warc.gzipped(b[:99]) + warc.gzipped(b[99:]))),
        package_file(tmp_path, "index-deflated.zip", lambda z: indexed(z, "indexes/i.cdxj", bytes, zipfile.ZIP_DEFLATED)),
    ]
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    paths.append(package_file(tmp_path, "zip64.zip", lambda z: indexed(z, "indexes/i.cdxj", bytes), b"before"))
    assert b"PK\6\6" in (tmp_path / "zip64.zip").read_bytes()
    got = warc.read_packages(spark.createDataFrame([(p,) for p in paths], "package string")).collect()
    want = {(f"http://x/{i}", f"text {i} ".encode() * i) for i in range(20)}
    for p in paths:
        found = [(r.url, bytes(r.payload)) for r in got if r.package == p]
        assert len(found) == 20 and set(found) == want, p


def test_directory_in_small_blocks_and_broken_files(monkeypatch):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for i in range(50):
            z.writestr(f"archive/é{i}.warc", b"x" * i)
    raw = data.getvalue()
    read = lambda at, n: raw[at : at + n]
    monkeypatch.setattr(warc, "BLOCK", 7)
    found = list(warc.directory(read, len(raw)))
    assert [(n, s) for n, _, _, s, _ in found] == [(f"archive/é{i}.warc", i) for i in range(50)]
    assert all(raw[(a := warc.data_place(read, h)) : a + s] == b"x" * s for _, _, h, s, _ in found)
    for broken in (b"", b"no zip at all", raw[:-30], raw[:100] + raw[-60:]):
        with pytest.raises(ValueError):
            list(warc.directory(lambda at, n: broken[max(at, 0) : max(at, 0) + n], len(broken)))


def test_base32(spark):
    hexes = [hashlib.sha1(bytes([i])).hexdigest() for i in range(50)] + ["0" * 40, "f" * 40]
    got = spark.createDataFrame([(h,) for h in hexes], "h string").select("h", warc.base32(F.col("h")).alias("b")).collect()
    assert all(r.b == base64.b32encode(bytes.fromhex(r.h)).decode() for r in got)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SMALL}/pages.parquet'")
    want = con.execute(queries.ORACLE_SQL["op11_warc"])
    names = [c[0] for c in want.description]
    got = queries.op11_warc(spark, SMALL).select(names).collect()
    assert Counter(tuple(r) for r in got) == Counter(map(tuple, want.fetchall()))


def test_tables_settle_in_a_session_without_settings(tmp_path):
    """No checkpoint folder named, an empty configuration folder: a local session makes its own."""
    code = (
        "from pyspark.sql import SparkSession; from tracewright.llm import common\n"
        "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "assert s.conf.get('spark.checkpoint.dir', None) is None\n"
        "assert common.settle(s.range(5), 'x').count() == 5"
    )
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if not k.startswith("SPARK_") and k != "PYSPARK_SUBMIT_ARGS"} | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root}
    subprocess.run([sys.executable, "-c", code], check=True, env=env, cwd=tmp_path)
