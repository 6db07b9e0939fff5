"""Every query against its SQL on the smallest tables."""

import os
import subprocess
import sys

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        else:
            number = (int, float, np.integer, np.floating)
            df[c] = [None if x is None or x is pd.NaT or x is pd.NA or x != x else round(float(x), 5) if isinstance(x, number) and not isinstance(x, (bool, np.bool_)) else str(x) for x in df[c]]
    return sorted(map(repr, df.itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


OWN = [n for n in entry.queries() if not n.startswith(("op", "pipeline"))]


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = df.toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns) > 0
        return
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_entry_without_the_training_data_operators(tmp_path):
    """The rest imports and lists its queries when those are left out."""
    (tmp_path / "tracewright").mkdir()
    for d, _, files in os.walk(os.path.join(ROOT, "tracewright")):
        if os.path.basename(d) in ("llm", "__pycache__"):
            continue
        for f in files:
            to = tmp_path / os.path.relpath(os.path.join(d, f), ROOT)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_bytes(open(os.path.join(d, f), "rb").read())
    (tmp_path / "__spark_entry__.py").write_bytes(open(os.path.join(ROOT, "__spark_entry__.py"), "rb").read())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
