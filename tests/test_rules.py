"""Hand-computed values of the rules, and properties of the operators."""

import datetime as dt
import json
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewright.functions import expr, stats
from tracewright.operators import blocks, chains, evaluation, graph, hmm, logistic, paths, profile, reports, segments, synthesis, windows
from tracewright.plans import flow
from tracewright.sources import files, readers, sinks
from tracewright.streaming import flows

T0 = dt.datetime(2026, 1, 1)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_as_path_and_unknown_networks(spark):
    def path(asns):
        rows = [(1, [(i + 1, "x", a, 1.0) for i, a in enumerate(asns)])]
        return spark.createDataFrame(rows, "k int, path array<struct<hop: int, ip: string, asn: string, rtt: double>>").select(expr.as_path("path").alias("p")).first().p

    assert path(["", "10", "10", "unknown", "20"]) == ["10", "20"]
    assert path(["10", "Unknown", " 10 "]) == ["10"]
    assert path([None, "NaN", "NA", "none", "null"]) == []


def test_ladders(spark):
    cls = lambda m, d: value(spark, expr.segment_class(F.lit(float(m)), F.lit(d)))
    assert cls(61, 5.1) == "degradacion_severa_sostenida" and cls(61, -5.1) == "mejora_severa_sostenida"
    assert cls(31, 2.1) == "degradacion_moderada_sostenida" and cls(9, 11.0) == "pico_transitorio"
    assert cls(20, 0.9) == "regimen_base" and cls(20, 3.0) == "variacion_normal"
    assert [value(spark, expr.route_change_class(F.lit(x))) for x in (5.1, -2.1, 2.0)] == ["degradacion_severa", "mejora_moderada", "sin_cambio_relevante"]
    assert [value(spark, expr.severity(F.lit(x))) for x in (40.0, 40.1, 200.0, 200.1)] == ["light", "medium", "medium", "dark"]
    assert [value(spark, expr.is_ambiguous(F.lit(x))) for x in (1.5, 1.4, 2.5, 5.6)] == [True, False, True, False]
    assert value(spark, expr.percent(F.lit(1), F.lit(0))) == "n/d"


def test_bhattacharyya(spark):
    d = lambda *x: value(spark, expr.bhattacharyya(*[F.lit(float(v)) for v in x]))
    assert d(10, 1, 12, 1) == pytest.approx(0.5) and d(10, 1, 10, 2) == pytest.approx(0.1115717757) and d(30, 0.5, 35, 2) == pytest.approx(1.8474741365)


def test_times_and_windows(spark):
    assert value(spark, expr.parse_time(F.lit("2026-03-02 12:00"))) == value(spark, expr.parse_time(F.lit("2026-03-02 12:00:00"))) == dt.datetime(2026, 3, 2, 12)
    assert value(spark, expr.parse_time(F.lit("yesterday"))) is None
    w = value(spark, expr.view_window(expr.parse_time(F.lit("2026-03-02 12:00")), expr.parse_time(F.lit("2026-04-04 12:00"))))
    assert w.window_ms == 1_425_600_000 and w.center_ms == 1_773_878_400_000
    assert value(spark, expr.view_window(expr.parse_time(F.lit("2026-03-02 12:00")), expr.parse_time(F.lit("2026-03-02 12:00")))) is None
    assert value(spark, expr.hour_of(F.lit("2026-01-01 23:45:00").cast("timestamp_ntz"), 5.5)) == 5


def test_private_addresses(spark):
    ips = {"10.1.2.3": True, "172.16.0.1": True, "172.32.0.1": False, "192.168.1.1": True, "127.0.0.1": True, "169.254.1.1": True, "8.8.8.8": False, "2001:db8::1": False, "fe80::1": True, "2a00::1": False, "": False, "x": False}
    rows = spark.createDataFrame([(k,) for k in ips], "ip string").select("ip", expr.private_ip(F.col("ip")).alias("p"), expr.private_v4("ip").alias("v4")).collect()
    assert {r.ip: r.p for r in rows} == ips
    assert all(r.v4 == ips[r.ip] for r in rows if r.v4 is not None)
    assert expr.is_private_ip("2001:db8::1", verifier=False)


def test_ks(spark):
    def ks(a, b):
        rows = [(float(x), True) for x in a] + [(float(x), False) for x in b]
        r = stats.ks_two_samples(spark.createDataFrame(rows, "x double, first boolean").withColumn("k", F.lit(1)), ["k"], "x", "first").first()
        return r.d, r.p

    assert ks(range(10), range(100, 110)) == (1.0, pytest.approx(1.8879793657e-05))
    assert ks([1, 2, 3], [1, 2, 3]) == (0.0, 1.0)
    assert ks([1, 2, 3, 4], [3, 4, 5, 6]) == (0.5, pytest.approx(0.5344157192))
    assert value(spark, stats.ks_series(F.lit(0.8))) == pytest.approx(0.5441424116)


def test_aggregates(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0), (1, 4.0), (2, 7.0)], "k int, x double")
    assert {r.k: r.v for r in stats.upper_median_of(df, ["k"], "x", "v").collect()} == {1: 3.0, 2: 7.0}
    assert df.filter("k = 1").agg(stats.upper_median("x").alias("v")).first().v == 3.0
    q = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double").agg(stats.quantile("x", 0.25).alias("q"), stats.at_rank("x", 0.6).alias("r")).first()
    assert q.q == 1.5 and q.r == 2.0
    mean, std = stats.pooled("n", "m", "s")
    g = spark.createDataFrame([(10, 20.0, 1.0), (30, 22.0, 2.0)], "n int, m double, s double").agg(mean.alias("m"), std.alias("s")).first()
    assert (g.m, g.s) == (21.5, pytest.approx(2.0))
    scored = spark.createDataFrame([(0, 1, 0.9), (1, 0, 0.8), (2, 1, 0.8), (3, 0, 0.1)], "i int, y int, p double").withColumn("k", F.lit(1))
    assert stats.average_precision(scored, ["k"], "p", "y", "i").first().ap == pytest.approx(0.8333333333)
    assert stats.auroc(scored, ["k"], "p", "y").first().auroc == pytest.approx(0.875)
    assert stats.auroc(scored.filter("y = 1"), ["k"], "p", "y").first().auroc is None
    ties = spark.createDataFrame([(1, "b"), (2, "a"), (3, "a"), (4, "b"), (5, None)], "pos int, v string").withColumn("k", F.lit(1))
    assert stats.mode_first_seen(ties, ["k"], "v", "pos", "m").first().m == "b"


def times(minutes):
    return [T0 + dt.timedelta(minutes=m) for m in minutes]


def test_runs_blocks_and_gaps(spark):
    lengths = [8] * 5 + [9] + [8] * 4 + [9] * 3 + [8] * 4
    df = spark.createDataFrame([("s", t, n) for t, n in zip(times(range(17)), lengths)], "series_id string, cycle_ts timestamp_ntz, length int")
    r = paths.length_runs(df, ["series_id"], ["cycle_ts"], 4).groupBy("clase").count().collect()
    assert {x.clase: x["count"] for x in r} == {"sostenido": 3, "parpadeo": 1, "transitorio": 1}
    b = blocks.block_table(df, ["series_id"], ["cycle_ts"], "length", 4).collect()
    assert [(x.n_inside, x.outside, x.merged) for x in b] == [(17, 4, 3)]
    g = spark.createDataFrame([("s", t) for t in times([0, 90, 180 + 1 / 60])], "series_id string, cycle_ts timestamp_ntz")
    assert [x.seq_id for x in windows.with_sequences(g, ["series_id"], ["cycle_ts"], "cycle_ts", 90 * 60).orderBy("cycle_ts").collect()] == [0, 0, 1]
    n = windows.runs(df.withColumn("v", F.when(F.col("length") == 9, F.lit(None)).otherwise(1)), ["series_id"], ["cycle_ts"], ["v"], "cycle_ts")
    assert n.agg(F.sum("n")).first()[0] == 17 and n.count() == 5


def test_moving_median_pads_the_ends(spark):
    r = random.Random(1)
    for n in (1, 2, 5, 12):
        y = [r.random() for _ in range(n)]
        df = spark.createDataFrame([(1, i, v) for i, v in enumerate(y)], "k int, i int, x double")
        got = [x.median for x in windows.moving_median(df, ["k"], ["i"], "x", 5).orderBy("i").collect()]
        p = [y[0]] * 2 + y + [y[-1]] * 2
        assert got == [sorted(p[i : i + 5])[2] for i in range(n)]


def test_length_classes_equal_brute_force(spark):
    """Every pair of frequent lengths counts, and the modal paths."""
    g = np.random.default_rng(7)
    plan = {"a": [(8, 60, 30, "x"), (9, 50, 40, "x"), (10, 40, 40, "x"), (11, 30, 40, "y"), (12, 4, 40, "x"), (13, 20, 30, "x")], "b": [(int(n), int(g.integers(5, 60)), float(g.choice([30, 31, 33])), str(g.choice(["x", "y"]))) for n in range(5, 13)]}
    rows = [(s, n, round(float(g.normal(m, 1.0)), 1), p if i % 3 else "z") for s, groups in plan.items() for n, k, m, p in groups for i in range(k)]
    rows = [(*r, i) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "series_id string, length int, rtt_ms double, as_path string, pos long")
    got = {(r.series_id, r.value): (r.clase, r.fusionada) for r in blocks.length_classes(df, ["series_id"], "length", "rtt_ms", "as_path", "pos").collect()}
    want = {}
    for s in plan:
        by: dict = {}
        for _, n, v, p, _ in (r for r in rows if r[0] == s):
            by.setdefault(n, []).append((v, p))
        order = sorted(by, key=lambda n: (-len(by[n]), list(by).index(n)))
        total, classes = sum(map(len, by.values())), []

        def same(n, m):
            x, y = np.sort([v for v, _ in by[n]]), np.sort([v for v, _ in by[m]])
            at = np.union1d(x, y)
            d = np.abs(np.searchsorted(x, at, "right") / len(x) - np.searchsorted(y, at, "right") / len(y)).max()
            e = np.sqrt(len(x) * len(y) / (len(x) + len(y)))
            lam = (e + 0.12 + 0.11 / e) * d
            p = 2 * sum((-1) ** (k - 1) * np.exp(-2 * k * k * lam * lam) for k in range(1, 101))
            modal = [max((q for _, q in z), key=[q for _, q in z].count) for z in (by[n], by[m])]
            return min(len(x), len(y)) >= max(10, np.ceil(0.005 * total)) and modal[0] == modal[1] and not (p < 0.01 and abs(np.median(x) - np.median(y)) >= 2.0)

        for n in order:
            fit = next((c for c in classes if all(same(n, m) for m in c)), None)
            fit.append(n) if fit else classes.append([n])
        want |= {(s, n): (c[0], len(c) > 1) for c in classes for n in c}
    assert got == want
    assert got["a", 10] == (9, True) and got["a", 11] == (11, False) and got["a", 13] == (8, True)


def test_sweep_settings(spark, monkeypatch):
    """The registered sweep has the survey's settings and every series."""
    from tracewright.plans import series_queries

    seen = []
    monkeypatch.setattr(evaluation, "sweep", lambda rows, keys, configs, seeds, order, x, **_: seen.append((rows, configs, seeds)))
    monkeypatch.setattr(evaluation, "seed_stability", lambda runs, keys: runs)
    series_queries.parameter_sweep(spark, "/root/testdata/sf0.001")
    (rows, configs, seeds) = seen[0]
    assert [(c["sf"], c["kappa"], c["percentile"]) for c in configs] == [(20, 1000, 0), (5, 1000, 0), (1, 1000, 0), (20, 3000, 0), (20, 6000, 0), (20, 1000, 98)]
    assert all((c["k"], c["laps"]) == (15, 300) for c in configs) and seeds == [0, 1, 2]
    assert rows.count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_sweep_cuts_by_percentile(spark):
    g = np.random.default_rng(3)
    y = [*g.normal(30, 0.5, 120), *g.normal(40, 0.5, 120), 500.0, 500.0, 500.0]
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(y)], "series_id string, i int, x double")
    got = {r.config_id: r.boundaries for r in evaluation.sweep(df, ["series_id"], [{"percentile": p} for p in (0.0, 98.0)], [0], ["i"], "x", dwell=1).collect()}
    assert max(got[0]) == 240 and max(got[1]) == 120


def test_sweep_on_a_long_series(spark):
    """Overlapping states and 300 laps: six runs on 20,000 rows, each as if alone."""
    g = np.random.default_rng(7)
    y = 30 + g.exponential(1, 20_000) + np.repeat([0.0, 8.0] * 5, 2000)
    df = spark.createDataFrame(pd.DataFrame({"series_id": "s", "i": range(len(y)), "x": y, "z": "of no use"}))
    configs = [{"sf": sf, "kappa": 1000.0, "k": 15, "laps": 300, "percentile": 0.0} for sf in (20.0, 1.0)]
    began = time.time()
    got = {(r.config_id, r.seed): r for r in evaluation.sweep(df, ["series_id"], configs, [0, 1, 2], ["i"], "x").collect()}
    assert time.time() - began < 30
    assert len(got) == 6
    states = segments.smooth_states(segments.fuse_states(y, segments.sticky_hmm(y, [0], sf=1.0, laps=300, seed=2)), 4)
    assert got[1, 2].boundaries == (np.flatnonzero(np.diff(states)) + 1).tolist() and got[1, 2].states == len(set(states.tolist()))


def test_smoothing():
    s = lambda x, d=3: segments.smooth_states(np.array(x), d).tolist()
    assert s([0, 0, 1, 1]) == [0, 0, 1, 1]
    assert s([0, 0, 0, 1, 2, 2, 2, 2]) == [0, 0, 0, 2, 2, 2, 2, 2]
    assert s([0, 0, 0, 1, 1, 2, 2, 2]) == [0, 0, 0, 0, 0, 2, 2, 2]
    assert s([0, 1, 0, 1, 0, 0, 0]) == [0] * 7
    assert s([1, 2], 1) == [1, 2] and s([]) == []


def test_model_finds_plateaus(spark):
    g = np.random.default_rng(4)
    y = np.concatenate([g.normal(m, 0.5, n) for m, n in ((30, 120), (40, 60), (30, 90), (55, 50))])
    states = segments.smooth_states(segments.fuse_states(y, segments.sticky_hmm(y, [0], seed=0)), 3)
    cuts = (np.flatnonzero(np.diff(states)) + 1).tolist()
    assert len(cuts) == 3 and all(abs(a - b) <= 2 for a, b in zip(cuts, (120, 180, 270)))
    assert states[0] == states[200] and len(set(states.tolist())) == 3
    df = spark.createDataFrame([("a", 1, 0, i, float(v)) for i, v in enumerate(y)], "series_id string, block_id int, seq_id int, i int, rtt_ms double")
    out = segments.model_states(df, ["series_id"], ["i"], "rtt_ms").orderBy("i").collect()
    assert [r.state for r in out] == states.tolist()


@pytest.mark.parametrize("n, starts, stay", [(1, [0], 0.9), (700, [0, 1, 2, 300], 0.9), (5000, [0], 0.9999999), (900, list(range(0, 900, 2)), 0.5)])
def test_chunked_passes_equal_plain_ones(n, starts, stay):
    """Forward-backward in chunks, also where memory outlasts them and where states can't be reached."""
    g, k = np.random.default_rng(n), 4
    trans = np.full((k, k), (1 - stay) / (k - 1))
    np.fill_diagonal(trans, stay)
    trans[:, 3] = [0, 0, 0, 1]
    begin, far = np.array([0.5, 0.2, 0.3, 0.0]), -g.exponential(0.1, (n, k))
    far[::97] *= 5000
    like = np.exp(np.maximum(far - far.max(1, keepdims=True), -650.0))
    ch = chains.Chunks(starts, n)
    f, back, scale, ends = np.empty((k, n)), np.empty((k, n)), np.empty(n), np.full((k, len(ch.length)), 0.25)
    heads, seen = ends.copy(), np.ascontiguousarray(like[ch.rows].T)
    chains.forward(ch, seen, trans, np.repeat(begin[:, None], len(ch.length), 1), ends, f, scale)
    chains.backward(ch, seen, trans, np.ones_like(heads), heads, f, scale, back)
    got = np.empty((n, k))
    got[ch.rows] = (f * back).T
    want, pair = np.empty((n, k)), np.zeros((k, k))
    for a, b in zip(starts, [*starts[1:], n]):
        alpha, size = np.empty((b - a, k)), np.empty(b - a)
        for t in range(b - a):
            cur = (alpha[t - 1] @ trans if t else begin) * like[a + t]
            size[t] = cur.sum()
            alpha[t] = cur / size[t]
        beta = np.ones(k)
        for t in range(b - a - 1, -1, -1):
            beta *= alpha[t] > 0  # else those of states out of reach grow past all numbers
            want[a + t] = alpha[t] * beta
            ahead = like[a + t] * beta / size[t]
            if t:
                pair += alpha[t - 1][:, None] * trans * ahead
            beta = trans @ ahead
    assert sorted(ch.rows.tolist()) == list(range(n))
    assert np.allclose(got, want, rtol=1e-7, atol=1e-9)
    assert np.allclose(trans * chains.pairs(ch, f, seen * back / scale), pair, rtol=1e-7, atol=1e-9)


def row_by_row(y, m):
    """States of one sequence under a model, by plain forward-backward."""
    like = np.exp(np.maximum(-650, (e := m.level + m.slope * (y[:, None] - m.at) ** 2) - e.max(1, keepdims=True)))
    f, b = np.empty_like(like), np.ones_like(like)
    for t in range(len(y)):
        f[t] = (f[t - 1] @ m.trans if t else m.begin) * like[t]
        f[t] /= f[t].sum()
    for t in range(len(y) - 2, -1, -1):
        b[t] = m.trans @ (like[t + 1] * b[t + 1])
        b[t] /= b[t].sum()
    return (f * b).argmax(1)


def test_units_pass_messages_until_they_equal_one_pass():
    g = np.random.default_rng(2)
    y = np.concatenate([g.normal(v, 1.5, 150) for v in (0, 3, 0, 5, 3, 0)])
    s, k = hmm.Setting(k=6), 6
    whole = hmm.Unit(y, [0])
    m = hmm.Model.of(whole.guess(np.linspace(-1, 6, k), 1.0, None), len(y), s)
    want, _ = whole.expect(m, None, None)
    assert (whole.states() == row_by_row(y, m)).mean() > 0.999
    cuts = [0, 130, 131, 500, 900]
    parts = [hmm.Unit(y[a:b], [0], a > 0, b < 900) for a, b in zip(cuts, cuts[1:])]
    told = [(np.full(k, 1 / k), np.full(k, 1 / k))] * 4
    for _ in range(8):
        found = [u.expect(m, told[i - 1][0] if i else None, told[i + 1][1] if i < 3 else None) for i, u in enumerate(parts)]
        told = [u.told() for u in parts]
    assert np.concatenate([u.states() for u in parts]).tolist() == whole.states().tolist()
    assert np.allclose(sum(f.flat() for f, _ in found), want.flat(), rtol=1e-6, atol=1e-6)


def test_units_by_value_equal_units_by_row():
    """Values weighed once with the places of the rows, in a room of a step's arrays, against rows in one array."""
    g = np.random.default_rng(5)
    y = np.round(g.exponential(1.0, 3000), 2) + np.repeat([0.0, 8.0, 0.0], 1000)
    values, kinds = np.unique(y, return_inverse=True)
    units = [hmm.Unit(values, [0, 700], kinds=kinds), hmm.Unit(y, [0, 700])]
    first = [u.guess(np.linspace(0, 9, 6), 1.0, None) for u in units]
    m = hmm.Model.of(first[0], len(y), hmm.Setting(k=6))
    a, b = ([u.expect(m, None, None), u.states()] for u in units)
    assert np.array_equal(a[1], b[1]) and np.allclose(a[0][0].flat(), b[0][0].flat(), rtol=1e-12) and np.isclose(a[0][1], b[0][1])
    assert np.isclose(a[0][0].moments[1].sum(), y.sum()) and np.isclose(a[0][0].pair.sum(), len(y) - 2)
    ch = units[0].ch
    like = np.exp(np.maximum(-650, (e := m.level[:, None] + m.slope[:, None] * (y[ch.rows] - m.at[:, None]) ** 2) - e.max(0)))
    f, back, scale, ends = np.empty_like(like), np.empty_like(like), np.empty(len(y)), np.full((6, len(ch.length)), 1 / 6)
    chains.forward(ch, like, m.trans, np.repeat(m.begin[:, None], len(ch.length), 1), ends, f, scale)
    chains.backward(ch, like, m.trans, np.ones_like(ends), ends.copy(), f, scale, back)
    assert np.allclose(np.concatenate(units[0].f, 1), f, rtol=1e-7, atol=1e-12) and np.allclose((f * back).sum(1), a[0][0].moments[0], rtol=1e-7)


def test_a_series_of_many_chunks_has_the_states_of_one(spark):
    """Memoised rounds over chunks, with several sequences, against one task."""
    g = np.random.default_rng(8)
    level = np.repeat([30.0, 38.0, 30.0, 47.0, 38.0, 30.0], 400)
    df = spark.createDataFrame(pd.DataFrame({"k": "s", "block_id": 1, "seq_id": np.arange(2400) // 900, "i": range(2400), "x": level + g.normal(0, 1.0, 2400)}))
    one, many = ([(r.i, r.state) for r in segments.model_states(df, ["k"], ["i"], "x", chunk=c).orderBy("i").collect()] for c in (hmm.CHUNK, 350))
    assert one == many
    assert [len({s for _, s in one[a : a + 400]}) for a in range(0, 2400, 400)] == [1] * 6 and len({s for _, s in one}) == 3


def test_model_on_a_long_series():
    """Row by row in Python, 200,000 rows and 20 laps took 39 s."""
    g = np.random.default_rng(6)
    level = np.repeat(g.choice([30.0, 40.0, 55.0], 400), 500)
    began = time.time()
    states = segments.fuse_states(y := level + g.normal(0, 0.5, len(level)), segments.sticky_hmm(y, [0, 70_000], laps=20))
    assert time.time() - began < 15
    assert all(len(set(states[level == v].tolist())) == 1 for v in (30, 40, 55)) and len(set(states.tolist())) == 3


def test_fusing_joins_what_overlaps():
    g = np.random.default_rng(0)
    y = np.concatenate([g.normal(10, 1, 200), g.normal(10.1, 1, 200), g.normal(30, 1, 200)])
    assert set(segments.fuse_states(y, np.repeat([2, 0, 1], 200)).tolist()) == {0, 1}


def test_levels():
    y = np.concatenate([np.full(40, 30.0), np.full(30, 35.0), np.full(40, 30.0)])
    level = synthesis.segment_levels(y)
    assert level.tolist() == y.tolist()
    y[20] = 90.0
    assert (synthesis.segment_levels(y)[:40] == 30).all()
    assert (synthesis.segment_levels(np.array([1.0, 9.0, 2.0])) == 2.0).all()


def test_resampling_and_plans():
    plan = synthesis.resample_plan([(0, 50), (70, 120)], 200, 10, 3)
    src = plan["src_idx"].to_numpy()
    assert len(plan) == 200 and all(0 <= s < 50 or 70 <= s < 120 for s in src)
    jumps = np.flatnonzero(np.diff(src) != 1) + 1
    assert plan["seam"].to_numpy()[jumps].all() and plan.equals(synthesis.resample_plan([(0, 50), (70, 120)], 200, 10, 3))
    x = np.sin(np.arange(400) / 9)
    assert synthesis.choose_length(x, [(0, 400)], [6, 48, 200], 5, 1) in (6, 48, 200)
    lo, hi = synthesis.densest_band(np.array([1.0, 5.0, 5.5, 6.0, 6.9, 9.0]))
    assert lo == pytest.approx(5.0) and hi == pytest.approx(6.99)


def test_designs_are_apart_and_whole(spark):
    """Steps and changes: a full factorial a series, never overlapping, the same on reruns; series without room have none."""
    series = spark.createDataFrame([("a", 4.0, 8), ("b", 0.5, 3)], "k string, cycles_per_h double, path_length int")
    got = sorted(tuple(r) for r in synthesis.step_design(series, ["k"], 1).collect())
    assert got == sorted(tuple(r) for r in synthesis.step_design(series.repartition(3), ["k"], 1).collect())
    for k, per_h, hops in (("a", 4, range(5, 9)), ("b", 0.5, range(2, 4))):
        own = sorted(r[1:] for r in got if r[0] == k)
        assert sorted((d, n) for _, _, d, _, _ in own for n in [0])[::6] == [(d, 0) for d in synthesis.DELTAS] and len(own) == 30
        assert all(b[0] - a[1] - 1 >= round(12 * per_h) for a, b in zip(own, own[1:])) and all(r[3] in hops for r in own)
        assert {r[4] for r in own if r[2] >= 5} == {"severa"} and own[0][0] >= 2 * round(12 * per_h)
        assert sorted(r[1] - r[0] + 1 for r in own) == sorted([max(1, round(h * per_h)) for h in synthesis.HOURS] * 10)
    cyc = spark.createDataFrame([("a", i, 10.0) for i in range(100)] + [("c", i, 10.0) for i in range(71)] + [("d", i, 10.0) for i in range(72)], "k string, t int, last_rtt double")
    plan = synthesis.simple_design(cyc, ["k"], 3, 20, 42)
    found = sorted(tuple(r) for r in plan.collect())
    assert [(r[0], r[1]) for r in found] == [("a", 1), ("a", 2), ("a", 3), ("d", 1), ("d", 2), ("d", 3)] and all(b[2] - a[3] - 1 > 5 for a, b in zip(found, found[1:]) if a[0] == b[0]) and all(0 <= r[2] and r[3] < 100 for r in found)
    truth = synthesis.simple_truth(synthesis.inject_simple(cyc, plan, ["k"], ["t"], 5.0), ["k"], "t", 5.0).collect()
    assert len(truth) == 6 and all((r.duration_cycles, r.original_mean_rtt_ms, r.injected_mean_rtt_ms) == (20, 10.0, 15.0) for r in truth)


def test_residual_mode_and_spikes(spark):
    hops = spark.createDataFrame([("s", i, h, 10.0 + h, 4.0 if i == 1 else 0.0) for i in range(3) for h in range(1, 7)], "k string, idx long, hop int, rtt_ms double, excess double").withColumns({"base": F.lit(8.0), "level": F.lit(30.0), "len": F.lit(6)})
    plan = spark.createDataFrame([("s", 2, 2, 5.0, 6, "severa")], "k string, i0 long, i1 long, delta_ms double, hop int, kind string")
    got = {(r.idx, r.hop): r.rtt_ms for r in synthesis.inject_steps(hops, plan, ["k"], base="base", level="level", length="len", spike="excess").collect()}
    assert got[0, 2] == 12.0 and got[0, 3] == 0.01 and got[2, 6] == pytest.approx(5.01) and got[2, 5] == 0.01
    kept = {(r.idx, r.hop): r.rtt_ms for r in synthesis.inject_steps(hops, plan, ["k"], length="len", spike="excess").collect()}
    assert kept[1, 6] == 12.0 and kept[0, 6] == 16.0 and kept[2, 6] == 21.0


def test_matching_in_order_equals_the_plain_rule():
    r = random.Random(5)
    for _ in range(300):
        a, b = ([float(r.randint(0, 30)) / 2 for _ in range(r.randint(0, 12))] for _ in "ab")
        free, n = sorted(b), 0
        for t in sorted(a):
            near = min(free, key=lambda x: (abs(x - t), x), default=None)
            if near is not None and abs(near - t) <= 2:
                free.remove(near)
                n += 1
        assert evaluation.match_in_order(np.array(a), np.array(b), 2.0) == n
    began = time.time()
    assert evaluation.match_in_order(np.arange(200_000.0), np.arange(200_000.0) + 1.0, 2.0) == 200_000
    assert time.time() - began < 10


def test_injection_adds_only_where_it_should(spark):
    hops = spark.createDataFrame([("s", i, h, 10.0) for i in range(10) for h in (1, 2, 3)], "series_id string, idx long, hop int, rtt_ms double")
    plan = spark.createDataFrame([("s", 3, 5, 4.0, 2, "moderada")], "series_id string, i0 long, i1 long, delta_ms double, hop int, kind string")
    out = synthesis.inject_steps(hops, plan, ["series_id"]).collect()
    assert len(out) == 30
    for r in out:
        inside = 3 <= r.idx <= 5
        assert r.rtt_ms == (14.0 if inside and r.hop >= 2 else 10.0) and r.delta_ms == (4.0 if inside else 0.0) and r.regimen == ("moderada" if inside else "base")


def test_matching_is_one_to_one():
    r = random.Random(2)
    for _ in range(50):
        a, b = (np.array(sorted(r.uniform(0, 50) for _ in range(r.randint(0, 12)))) for _ in range(2))
        m = evaluation.match_nearest(a, b, 3.0)
        assert len({i for i, _ in m}) == len({j for _, j in m}) == len(m) and all(abs(a[i] - b[j]) <= 3 for i, j in m)
        pairs = sorted((abs(x - y), i, j) for i, x in enumerate(a) for j, y in enumerate(b) if abs(x - y) <= 3)
        ua, ub, want = set(), set(), []
        for _, i, j in pairs:
            if i not in ua and j not in ub:
                ua.add(i), ub.add(j), want.append((i, j))
        assert m == want
    assert evaluation.match_in_order(np.array([1.0, 2.0]), np.array([1.6]), 1.0) == 1


def whole_range(at):
    """One model over all rows of each series."""
    n, zero = F.count(F.lit(1)), F.lit(0).cast("long")
    return at.groupBy("__id").agg(n.alias("__n")).select("__id", "__n", F.lit("all").alias("model"), zero.alias("learn_from"), F.col("__n").alias("learn_to"), zero.alias("gap_from"), zero.alias("gap_to"), zero.alias("test_from"), F.col("__n").alias("test_to"))


def test_logistic_separates(spark):
    g = np.random.default_rng(1)
    x = g.normal(size=(400, 3))
    y = (x @ [2.0, -1.0, 0.0] + 0.5 + g.logistic(size=400) > 0).astype(float)
    rows = spark.createDataFrame([("s", i, *map(float, x[i]), float(y[i])) for i in range(400)], "series_id string, i long, a double, b double, c double, y double")
    at = logistic.placed(rows, ["series_id"], ["i"], ["a", "b", "c"], "y")
    m = logistic.fit(at, whole_range(at), 3).first()
    w, mu, sd = np.array(m.weights), np.array(m.mean), np.array(m.spread)
    assert np.allclose(mu, x.mean(0)) and np.allclose(sd, x.std(0) + 1e-9) and m.learned == 400 and m.share == pytest.approx(y.mean())
    z = np.column_stack([np.ones(400), (x - mu) / sd])
    gradient = z.T @ (y - 1 / (1 + np.exp(-z @ w))) - np.r_[0.0, w[1:]]
    assert np.abs(gradient).max() < 1e-3


def fitted_beside(x, y):
    """Brute force: the penalised optimum by many small steps on dense arrays."""
    mu, sd = x.mean(0), x.std(0) + 1e-9
    z, w = np.column_stack([np.ones(len(x)), (x - mu) / sd]), np.zeros(x.shape[1] + 1)
    for _ in range(20000):
        p = 1 / (1 + np.exp(-z @ w))
        w += 2.0 / len(x) * (z.T @ (y - p) - np.r_[0.0, w[1:]])
    return lambda q: 1 / (1 + np.exp(-np.column_stack([np.ones(len(q)), (q - mu) / sd]) @ w))


@pytest.mark.parametrize("sent, part, alone", [(1 << 20, 1 << 17, 1 << 17), (1 << 20, 16, 0), (0, 16, 20)])
def test_folds_learn_from_the_rest(spark, monkeypatch, sent, part, alone):
    """Every fold equals a model fitted beside, in one group or by jobs, whether models are
    sent or meet rows by a shuffle of parts; nulls, one class, one row, no row and clashing names have their results."""
    monkeypatch.setattr(logistic, "SENT", sent), monkeypatch.setattr(logistic, "PART", part), monkeypatch.setattr(logistic, "ALONE", alone)
    g = np.random.default_rng(4)
    n, purge = 103, 3
    x = g.normal(size=(n, 2))
    y = (x[:, 0] - x[:, 1] + g.normal(size=n) > 0).astype(float)
    rows = [("s", i, float(x[i, 0]), float(x[i, 1]), int(y[i]), "m") for i in range(n)]
    rows[20], rows[50] = ("s", 20, None, 1.0, 1, "m"), ("s", 50, float("nan"), 1.0, 0, "m")
    rows[70] = (*rows[70][:4], None, "m")
    rows += [("one", i, float(i), 0.0, 1, "m") for i in range(10)] + [("few", 0, 1.0, 1.0, 1, "m")] + [(None, i, float(i % 3), 0.0, i % 2, "m") for i in range(12)]
    schema = "series_id string, i long, a double, b double, y int, mean string"
    df = spark.createDataFrame(rows, schema)
    out = evaluation.blocked_cv(df, ["series_id"], ["i"], ["a", "b"], "y", 5, purge)
    assert out.columns == [*df.columns, "probability"]
    got = out.toPandas()
    assert len(got) == len(rows) and (got["mean"] == "m").all()
    s = got[got["series_id"] == "s"].sort_values("i")["probability"].to_numpy(float)
    cuts = np.linspace(0, n, 6).astype(int)
    for a, b in zip(cuts, cuts[1:]):
        learn = np.ones(n, bool)
        learn[[20, 50, 70]], learn[max(0, a - purge) : b + purge] = False, False
        ask = [i for i in range(a, b) if i not in (20, 50)]
        assert np.allclose(s[ask], fitted_beside(x[learn], y[learn])(x[ask]), atol=1e-5)
    assert np.isnan(s[[20, 50]]).all()
    assert (got[got["series_id"] == "one"]["probability"] == 1.0).all() and (got[got["series_id"] == "few"]["probability"] == 0.0).all()
    assert got[got["series_id"].isna()]["probability"].notna().sum() == 12
    assert evaluation.blocked_cv(df.limit(0), ["series_id"], ["i"], ["a", "b"], "y", 5, purge).count() == 0


def test_packed_rows_add_up_to_the_sums_of_rows(spark):
    """A step on packs of rows has the gradient and Hessian of one on rows; null rows teach nothing."""
    g = np.random.default_rng(11)
    rows = [(k, i, float(v), None if i == 7 else float(v * v), int(g.integers(0, 2))) for k in "st" for i, v in enumerate(g.normal(size=60))]
    at = logistic.placed(spark.createDataFrame(rows, "series_id string, i long, a double, b double, y int"), ["series_id"], ["i"], ["a", "b"], "y")
    series = at.groupBy("__id").agg(F.count(F.lit(1)).alias("__n")).withColumns({"__from": F.lit(0).cast("long"), "__rows": F.col("__n")})
    models = logistic.begun(at, logistic.folds(series, 3, 2), 2).withColumn("weights", F.expr("array(0.5D, -0.25D, 1D)"))
    got, want = ({(r["__id"], r.model): (r.gradient, r.hessian) for r in f.collect()} for f in (logistic.newton_sums_of(logistic.packed(at, 2), models, 2), logistic.newton_sums(at, models, 2)))
    assert set(got) == set(want) and len(got) == 6
    assert all(np.allclose(a, b, rtol=1e-10, atol=1e-12) for k in want for a, b in zip(got[k], want[k]))


def test_cycles_reachability_and_exclusion(spark):
    rows = []
    for i, (ip, asn) in enumerate([("d", "9")] * 6 + [("m", "5")] + [("d", "9")] * 5):
        n = 3 if ip == "d" else 2
        rows += [("s", times([i])[0], h, f"r{h}" if h < n else ip, "7" if h < n else asn, 10.0 * h) for h in range(1, n + 1)]
    hops = spark.createDataFrame(rows, "series_id string, cycle_ts timestamp_ntz, hop int, ip string, asn string, rtt_ms double")
    k, c = ["series_id"], ["cycle_ts"]
    cyc = paths.reachability(paths.cycles(hops, k, c), k, c, min_share=0.2)
    assert [r.reached for r in cyc.orderBy("cycle_ts").collect()] == [True] * 6 + [False] + [True] * 5
    ex = paths.excluded_cycles(cyc, k, c).collect()
    assert [(r.motivo, r.tramo_n, r.tramo_longitud, r.entre_tramos) for r in ex] == [("sin_destino", 1, 3, False)]
    assert paths.truncation_warning(cyc, k, c, 3).first().warning and not paths.truncation_warning(cyc, k, c).first().warning
    ev = paths.events(hops, cyc, k, c).orderBy("cycle_ts", "ordinal").collect()
    assert [(r.categoria, r.ordinal) for r in ev] == [("cambio_longitud", 1), ("cambio_ip_asn", 2), ("cambio_longitud", 1), ("cambio_ip_asn", 2)]
    view = graph.asn_view(hops, k, c)
    assert {(r.source, r.target): r.n for r in graph.edges(view, k, c).collect()} == {("AS7", "AS9"): 11, ("AS7", "AS5"): 1}


def test_flatten(spark):
    raw = [(60, "d", [(1, [(None, "x"), (5.0, "a"), (6.0, "b")]), (3, [(9.0, None)]), (20, [(1.0, "z")])]), (120, "d", [(1, [(None, "x")])])]
    df = spark.createDataFrame([("s", *r) for r in raw], "series_id string, timestamp long, dst_addr string, result array<struct<hop: int, result: array<struct<rtt: double, from: string>>>>")
    got = [(r.timestamp, r.length, r.hop, r.ip, r.rtt_ms) for r in paths.flatten_measurements(df, ["series_id"]).orderBy("hop").collect()]
    assert got == [(60, 3, 1, "a", 5.0), (60, 3, 2, None, None), (60, 3, 3, "Unknown", 9.0)]


def test_route_changes(spark):
    rows = [("s", b, t, float(v)) for t, (b, v) in enumerate([(1, 10)] * 12 + [(2, 16)] * 3)]
    df = spark.createDataFrame(rows, "series_id string, block_id long, i long, x double")
    r = segments.route_changes(df, ["series_id"], ["i"], "x").collect()
    assert [(x.before_ms, x.after_ms, x.window, x.kind) for x in r] == [(10.0, 16.0, 3, "degradacion_severa")]


def test_results_do_not_depend_on_the_order_of_rows(spark):
    rows = [("s", t, random.Random(i).choice("ab"), float(i)) for i, t in enumerate(times(range(60)))]
    schema = "series_id string, cycle_ts timestamp_ntz, state string, x double"
    shuffled = rows[:]
    random.Random(0).shuffle(shuffled)
    a, b = spark.createDataFrame(rows, schema), spark.createDataFrame(shuffled, schema).repartition(3)
    for f in (lambda d: windows.runs(d, ["series_id"], ["cycle_ts"], ["state"], "cycle_ts"), lambda d: segments.segments(d, ["series_id"], ["cycle_ts"], "state", "x", "cycle_ts", 60.0)):
        assert sorted(f(a).collect()) == sorted(f(b).collect())


def test_files(spark, tmp_path):
    (tmp_path / "historial_traceroute_measurement12_probe7.csv").write_text(
        "timestamp,hop,ip,asn,rtt_ms\n2026-01-01 00:00:00,1,a,10,1.5\n2026-01-01 00:00:00,1,b,10,2.5\n2026-01-01 00:00:00,2,,,\n2026-01-01 00:00:00,3,c,unknown,x\n2026-01-01 00:00:00,y,d,1,1\nbad,1,d,1,1\n2026-01-01 00:15,1,,,4.5\n"
    )
    got = readers.hops(spark, str(tmp_path)).orderBy("cycle_ts", "hop").collect()
    assert [(r.measurement_id, r.probe_id, r.hop, r.ip, r.rtt_ms) for r in got] == [(12, 7, 1, "b", 2.5), (12, 7, 3, "c", None)]
    assert [(r.hop, r.rtt_ms) for r in readers.hops(spark, str(tmp_path), "segment").orderBy("cycle_ts", "hop").collect()] == [(1, 2.5), (1, 4.5)]
    df = spark.createDataFrame([(T0, True, ["10", "20"], [7, 8], 1.23456)], "t timestamp_ntz, f boolean, p array<string>, n array<int>, x double")
    sinks.write_csv(df, str(tmp_path / "out"), {"x": 3})
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first().asDict() == {"t": "2026-01-01 00:00:00", "f": "1", "p": "10>20", "n": "7|8", "x": "1.235"}
    first = sinks.append_summary(df.select("x"), str(tmp_path / "sum"))
    assert sinks.append_summary(df.select("x"), str(tmp_path / "sum")) == first and sinks.append_summary(df.select("x", "f"), str(tmp_path / "sum")) != first
    (tmp_path / "bloques_longitud_measurement12_probe7.csv").write_text(
        "bloque_id,longitud,inicio,fin,duracion_h,ciclos,fuera,tramos_sostenidos,longitud_modal,ruta,longitudes\n1,8,2026-01-01 00:00:00,2026-01-02 00:00:00,24.0,96,0,1,1,10>20,8|9\n2,7,2026-01-03 00:00:00,2026-01-04 00:00:00,24.0,96,0,1,0,10,\n"
    )
    b = readers.blocks(spark, str(tmp_path / "bloques*.csv")).orderBy("block_id").collect()
    assert [(r.length, r.path, r.lengths) for r in b] == [(8, ["10", "20"], [8, 9]), (7, ["10"], [7])]
    (tmp_path / "map.csv").write_text("1,5\nx,2\n3, 7\n")
    m = readers.macro_map(spark, str(tmp_path / "map.csv"))
    s = readers.apply_macro_map(spark.createDataFrame([(1,), (2,), (3,)], "state int"), m)
    assert sorted(r.state for r in s.collect()) == [2, 5, 7]
    (tmp_path / "m.json").write_text(json.dumps([{"timestamp": 1, "dst_addr": "d", "result": [{"hop": 1, "result": [{"rtt": 2.0, "from": "a"}]}]}]))
    assert readers.measurements(spark, str(tmp_path / "m.json")).first().result[0].result[0]["from"] == "a"


def test_streams(spark, tmp_path):
    rows = [("s", t, v, float(i)) for i, (t, v) in enumerate(zip(times([0, 10, 20, 70, 300]), "aabbb"))]
    schema = "series_id string, cycle_ts timestamp_ntz, state string, x double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for name, df, want in (
        ("w", flows.windowed_quantiles(stream, ["series_id"], "cycle_ts", "x"), 2),
        ("g", flows.sessions(stream, ["series_id"], "cycle_ts", "x"), 1),
        ("c", flows.state_changes(stream, "series_id", "cycle_ts", "state"), 1),
    ):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(name).count() == want, name


def test_causes_of_misses_and_false_alarms(spark):
    """One of each: matched, late, missed, structural; near a spike, small, without a cause."""
    k, double = ["series_id"], "series_id string, t double"
    truth = spark.createDataFrame([("s", 100.0, None), ("s", 500.0, None), ("s", 900.0, "corto"), ("s", 1300.0, None), ("s", 1300.0, None)], double + ", structural string")
    found = spark.createDataFrame([("s", x) for x in (103.0, 530.0, 2000.0, 3000.0, 4000.0)], double)
    marks = lambda *x: spark.createDataFrame([("s", v) for v in x] + [("u", 4000.0)], double)
    matches = evaluation.match_events(truth.select(*k, "t"), found, k, "t", 5.0, 50.0)
    causes = evaluation.event_causes(matches, truth, marks(2002.0, 1998.0), marks(2004.0, 3005.0), k, "t", 2.0, 5.0)
    got = sorted((r.result, r.t_true or 0, r.t_found or 0, r.cause) for r in causes.collect())
    assert got == [
        ("FN", 500.0, 530.0, "detectado_con_desfase"), ("FN", 900.0, 0, "corto"), ("FN", 1300.0, 0, "no_detectado"), ("FN", 1300.0, 0, "no_detectado"),
        ("FP", 0, 530.0, "desfase_de_evento"), ("FP", 0, 2000.0, "cerca_de_spike"), ("FP", 0, 3000.0, "cambio_subumbral"), ("FP", 0, 4000.0, "sin_causa_identificada"), ("VP", 100.0, 103.0, None),
    ]
    s = evaluation.detection_scores(causes, k).first()
    assert (s.n_true, s.n_found, s.vp, s.fn_structural, s.fn_eval, s.late_eval, s.fn_real, s.spurious) == (5, 5, 1, 1, 3, 1, 2, 2)
    assert (s.precision, s.precision_justified, s.recall_eval, s.recall_wide) == (0.2, 0.6, 0.25, 0.5)
    assert evaluation.event_causes(matches.limit(0), truth, marks(), marks(), k, "t", 2.0, 5.0).count() == 0


def test_scenarios_learn_from_their_own_side(spark):
    """Probabilities equal a model fitted beside; one class gives no rows; metrics by hand."""
    g = np.random.default_rng(3)
    x, made = g.normal(size=90), g.normal(size=60)
    part = ["train"] * 40 + ["purged"] * 5 + ["test"] * 45
    y, ym = (x + g.normal(size=90) > 0).astype(int), (made + g.normal(size=60) > 1).astype(int)
    schema = "series_id string, i long, x double, y int"
    rows = [("s", i, float(x[i]), int(y[i]), part[i]) for i in range(90)] + [("one", i, 3.0, 1, part[i]) for i in range(90)]
    real = spark.createDataFrame(rows, schema + ", part string")
    synthetic = spark.createDataFrame([("s", i, float(made[i]), int(ym[i])) for i in range(60)] + [("one", i, 1.0, 0) for i in range(60)], schema)
    out = evaluation.scenarios(real, synthetic, ["series_id"], ["i"], ["x"], "y", "x", 0.5, 3, 2).toPandas()
    assert sorted(out[out["series_id"] == "one"]["scenario"].unique()) == ["regla"]
    own = {k: v.sort_values("i") for k, v in out[out["series_id"] == "s"].groupby("scenario")}
    assert sorted(own) == ["TRTR", "TSTR", "TSTS", "regla"] and [len(own[k]) for k in sorted(own)] == [45, 45, 60, 45]
    for name, (a, b) in {"TRTR": (x[:40], y[:40]), "TSTR": (made, ym)}.items():
        z = (a - a.mean()) / (a.std() + 1e-9)
        w = np.zeros(2)
        for _ in range(20000):  # plain gradient ascent
            p = 1 / (1 + np.exp(-(w[0] + w[1] * z)))
            w += 0.01 * np.array([(b - p).sum(), ((b - p) * z).sum() - w[1]])
        want = 1 / (1 + np.exp(-(w[0] + w[1] * (x[45:] - a.mean()) / (a.std() + 1e-9))))
        assert np.allclose(own[name]["probability"], want, atol=1e-5), name
    s = {r.scenario: r for r in evaluation.scenario_scores(spark.createDataFrame(out[out["series_id"] == "s"]), ["series_id"], ["i"], "y", min_run=2).collect()}
    for name, rows in own.items():
        hit, true = (rows["probability"] >= 0.5).to_numpy(), rows["y"].to_numpy() == 1
        assert s[name].accuracy == pytest.approx((hit == true).mean()) and s[name].recall == pytest.approx((hit & true).sum() / true.sum())
        assert s[name].majority == pytest.approx(max(true.mean(), 1 - true.mean()))


def test_boosted_trees_learn(spark):
    g = np.random.default_rng(5)
    x = g.normal(size=(300, 2))
    rows = [(float(a), float(b), int(a * b > 0), i) for i, (a, b) in enumerate(x)]  # no line divides these
    df = spark.createDataFrame(rows, "a double, b double, y int, i int")
    out = evaluation.gradient_boosting(df.filter("i < 200"), df.filter("i >= 200"), ["a", "b"], "y").toPandas()
    assert len(out) == 100 and ((out["probability"] >= 0.5) == (out["y"] == 1)).mean() > 0.85


def test_addresses_and_durations(spark):
    day = lambda t: F.lit(t).cast("timestamp_ntz")
    url = lambda a, b: value(spark, expr.view_url("https://view.example/x", F.lit(5), F.lit(7), day(a), day(b)))
    assert url("2026-01-01 00:00:00", "2026-01-01 02:00:00") == "https://view.example/x?sourceProbeId=7&measurementId=5&sequentialMode=true&center=2026-01-01T01:00:00Z&window=3600000"
    assert url("2026-01-01 00:00:00", "2026-01-01 00:00:00") is None
    assert value(spark, expr.event_url("e", F.lit(5), F.lit(7), day("1970-01-01 00:00:01"))) == "e?sourceProbeId=7&measurementId=5&center=1000&window=7200000"
    text = lambda s, i: value(spark, expr.duration_text(F.lit(s), F.lit(i)))
    assert [text(7200, 3600), text(5400, 3600), text(1800, 900), text(100, 900), text(36000, 3600)] == ["2 h", "1.5 h", "30 min", "1.67 min", "10 h"]


def test_flow_writes_what_the_readers_read(spark, tmp_path, monkeypatch):
    """Extract, verify and view on two series; a length that changes for good and one
    cycle that does not reach."""
    raw = tmp_path / "raw"
    raw.mkdir()
    for probe in (7, 8):
        cycles = []
        for i in range(40):
            n = 2 if i == 9 else 3 if i < 20 else 4
            last = "8.8.4.4" if n == 2 else "8.8.8.8"
            hops = [{"hop": h, "result": [{"rtt": 10.0 * h + i % 3, "from": last if h == n else f"9.0.0.{h}"}]} for h in range(1, n + 1)]
            cycles.append({"timestamp": 1_767_225_600 + 900 * i, "dst_addr": "8.8.8.8" if i < 30 else "8.8.8.9", "result": hops})
        (raw / f"result_measurement12_probe{probe}.json").write_text(json.dumps(cycles))
    asn = spark.createDataFrame([("8.8.8.8", "1"), ("8.8.4.4", "2"), *[(f"9.0.0.{h}", "3") for h in (1, 2, 3)]], "ip string, asn string")
    out = flow.analyse(spark, str(raw), str(tmp_path / "out"), "https://view.example/x", "2026-01-01 00:00:00", "2026-01-02 00:00:00", asn_of_ip=asn)
    assert (out.status, out.notes) == (0, []) and out.views.count() == 2
    for name, path in out.files.items():
        if name not in ("bloque_principal", "ciclos"):
            head = spark.read.option("header", True).csv(path).columns
            assert head[:-2] == files.columns(name) and head[-2:] == readers.SERIES, name
    events = readers.event_counts(spark, out.files["eventos"]).filter("probe_id = 7")
    assert [(r.n, r.d) for r in events.agg(F.sum("cambio_longitud").alias("n"), F.sum("cambio_destino").alias("d")).collect()] == [(3, 1)]
    b = readers.blocks(spark, out.files["bloques_longitud"]).filter("probe_id = 8").orderBy("block_id").collect()
    assert [(r.length, r.ciclos, r.fuera, r.path, r.lengths) for r in b] == [(3, 19, 0, ["3", "1"], [3]), (4, 20, 0, ["3", "1"], [4])]
    x = readers.excluded(spark, out.files["ciclos_excluidos"]).collect()
    assert [(r.motivo, r.block_id, str(r.cycle_ts)) for r in x] == [("sin_destino", 1, "2026-01-01 02:15:00")] * 2
    m = sorted(readers.main_block(spark, out.files["bloque_principal"]).collect(), key=lambda r: r.probe)
    assert [(r.probe, r.elegido.longitud, r.elegido.ciclos, r.elegido.elegible) for r in m] == [("7", 3, 19, False), ("8", 3, 19, False)]
    d = spark.read.option("header", True).csv(out.files["diagnostico_longitudes"]).filter("probe_id = 7").orderBy("longitud").collect()
    assert [(r.longitud, r.ciclos, r.veredicto, r.rtt_mediana) for r in d] == [("3", "19", "distinta", "31.000"), ("4", "20", "referencia", "41.000")]
    v = spark.read.option("header", True).csv(out.files["caminos"]).filter("probe_id = 7 and saltos = 2").collect()
    assert [(r.ips, r.destino_alcanzado) for r in v] == [("9.0.0.1 8.8.4.4", "0")]
    assert flow.analyse(spark, str(tmp_path / "none"), str(tmp_path / "x"), "u", "2026-01-01", "2026-01-02").status == 1
    monkeypatch.setattr(flow, "extract", lambda *a: dict(out.files))
    monkeypatch.setattr(flow, "verify", lambda *a: {})
    assert flow.analyse(spark, str(raw), str(tmp_path / "y"), "u", "2026-01-02", "2026-01-01").status == 2
    monkeypatch.setattr(flow, "verify", lambda *a: 1 / 0)
    failed = flow.analyse(spark, str(raw), str(tmp_path / "y"), "u", "2026-01-01", "2026-01-02")
    assert failed.status == 2 and "verify" in failed.notes[0] and failed.views.count() == 2


def test_files_hold_tables_to_their_columns(spark):
    rows = [("s", i, 30.0 + (8 if i > 20 else 0), "ab"[i > 20], times([i])[0]) for i in range(40)]
    df = spark.createDataFrame(rows, "series_id string, i long, x double, state string, cycle_ts timestamp_ntz")
    k = ["series_id"]
    segs = segments.label_segments(segments.segments(df, k, ["i"], "state", "x", "cycle_ts", 900.0), segments.references(df, k, "x"), k)
    extra = segs.withColumns({"seq_id": F.lit(0), "block_id": F.lit(1), "length": F.lit(4), "reference_key": F.lit("L4")})
    got = files.as_file(extra, "segmentos_caracterizados", k).orderBy("start_ts").collect()
    assert [(r.estado, r.n_ciclos, r.mediana, r.desviacion_ms, r.bloque_id) for r in got] == [("a", 21, "30.000", "0.000", 1), ("b", 19, "38.000", "8.000", 1)]
    grouped = files.as_file(segments.group_segments(segs, k, ["segment_id"], ["kind"]), "segmentos_caracterizados_agrupados", k)
    assert grouped.columns == ["series_id", *files.columns("segmentos_caracterizados_agrupados")]
    assert files.as_file(segments.change_points(df, k, ["i"], "state"), "change_points", k).first().estado_nuevo == "b"
    with pytest.raises(ValueError, match="seq_id, bloque_id"):
        files.as_file(segs, "segmentos_caracterizados", k)


def test_profiles_and_route_changes_fill_their_files(spark):
    k = ["series_id"]
    rows = [("s", i // 30, i, 30.0 + (8 if i >= 30 else 0) + (i % 3), times([i])[0]) for i in range(60)]
    df = spark.createDataFrame(rows, "series_id string, block_id int, i long, x double, cycle_ts timestamp_ntz")
    found = spark.createDataFrame([("s", 0, 4, ["1", "2"]), ("s", 1, 6, ["1", "3"])], "series_id string, block_id int, length int, path array<string>")
    change = files.as_file(segments.route_change_columns(segments.route_changes(df, k, ["i"], "x"), found, k), "cambios_de_ruta", k).collect()
    assert [(r.bloque_anterior, r.bloque_siguiente, r.longitud_anterior, r.longitud_siguiente, r.delta_saltos, r.delta_rtt_ms, r.ciclos_ventana, r.ruta_anterior, r.ruta_siguiente) for r in change] == [(0, 1, 4, 6, 2, "8.000", 10, "1>2", "1>3")]
    step = (times([1])[0] - times([0])[0]).total_seconds()
    moving = windows.moving_quantiles(df, k, "cycle_ts", "x", 10 * step, 5 * step, step, 0.5)
    got = files.as_file(profile.quantile_columns(moving), "percentiles_moviles", k).orderBy("timestamp").collect()
    assert [str(r.timestamp) for r in got] == [t.strftime("%Y-%m-%d %H:%M:%S") for t in times(range(5, 55, 5))] and got[0].iqr == "1.500" and got[0].p50 == "31.000"
    # Ranges: 8 ms for floor, so it is the floor that moves.
    assert profile.moving_spread(moving, k).first().reading == "mueve el piso"
    spread = lambda lo, hi: [("s", j, [float(lo * (j % 2)), 0.0, 0.0, 0.0, float(hi * (j % 2))]) for j in range(40)]
    reading = lambda lo, hi: profile.moving_spread(spark.createDataFrame(spread(lo, hi), "series_id string, center_us long, q array<double>"), k).first().reading
    assert [reading(1, 3), reading(1, 2), reading(2, 9), reading(0, 0)] == ["dispersion", "estable", "mueve el piso", "estable"]
    high = profile.floor_elevation(df, k, "cycle_ts", "x", step, 10 * step, 5 * step, 0.25, (2.0, 50.0), 5 * step)
    lines = files.as_file(profile.elevation_columns(high), "elevaciones_piso", k).collect()
    hours = sum(r.duration_us for r in high.collect()) / 3.6e9
    assert len(lines) == 1 and lines[0].umbral_ms == 2.0 and lines[0].duracion_h == f"{hours:.1f}"
    told = {r.threshold: (r.episodes, r.hours, r.share) for r in profile.elevated_time(high, df, k, "cycle_ts", (2.0, 50.0)).collect()}
    assert told == {2.0: (1, pytest.approx(hours), pytest.approx(hours * 3600 / (59 * step))), 50.0: (0, 0.0, 0.0)}
    for name, by in (("perfil_horario", profile.hourly(df, k, "cycle_ts", "x", min_n=1)), ("perfil_diario", profile.daily(df, k, "cycle_ts", "x", min_n=1))):
        assert files.as_file(profile.quantile_columns(by), name, k).columns == ["series_id", *files.columns(name)]


def test_silent_cycles_stay_for_resampling(spark):
    raw = [("s", "2026-01-01 00:00:00", "1", "a", "5", "1.0", 0), ("s", "2026-01-01 00:00:00", "2", "", "", "", 1), ("s", "2026-01-01 01:00:00", "1", "", "", "", 2),
           ("s", "2026-01-01 01:00:00", "x", None, None, None, 3), ("s", "2026-01-01 02:00:00", "1", "a", "5", "1.0", 4), ("s", "2026-01-01 02:00:00", "1", "b", "6", "2.0", 5), ("s", "", "1", "a", "5", "1.0", 6)]
    df = spark.createDataFrame(raw, "series_id string, timestamp string, hop string, ip string, asn string, rtt_ms string, row long")
    told = lambda mode: sorted((r.cycle_ts.hour, r.hop, r.ip) for r in readers.typed_hops(df, ["series_id"], mode).collect())
    assert told("resample") == [(0, 1, "a"), (1, None, None), (2, 1, "b")] and told("verify") == [(0, 1, "a"), (2, 1, "b")]
    plain = readers.apply_macro_map(spark.createDataFrame([(10,), (5,), (7,)], "state int"), readers.default_macro_map(spark))
    assert sorted(r.state for r in plain.collect()) == [0, 3, 7]


def test_blocks_of_two_paths_of_one_length(spark):
    """A change of path with one length opens a block, and duration goes by the cadence of all cycles."""
    rows = [("m", i, 8, ["10", "20"] if i < 10 else ["10", "30"], True, f"ip{i // 10}", "20", 5.0) for i in range(20)] + [("m", 20 + i, 5, ["10"], False, "x", "10", 9.0) for i in range(4)]
    cyc = spark.createDataFrame([(a, i * 60, *rest) for a, i, *rest in rows], "k string, t long, length int, as_path array<string>, reached boolean, last_ip string, last_asn string, last_rtt double").withColumn("t", F.timestamp_seconds("t"))
    got = reports.block_report(cyc, ["k"], ["t"]).orderBy("bloque_id").collect()
    assert [(r.longitud, r.ruta, r.ciclos, r.fuera, r.longitud_modal, r.longitudes, round(r.duracion_h * 60)) for r in got] == [(8, ["10", "20"], 10, 0, True, [8], 10), (8, ["10", "30"], 10, 0, True, [8], 10)]
    assert {r.bloque_id for r in reports.excluded_report(cyc, ["k"], ["t"]).collect()} == {2}


def test_short_true_episodes_do_not_count(spark):
    rows = [("s", i, int(i in (3, 4) or 10 <= i < 20), int(10 <= i < 20)) for i in range(30)]
    got = evaluation.episode_scores(spark.createDataFrame(rows, "k string, i int, y int, p int"), ["k"], ["i"], "y", "p", 5).first()
    assert (got.episodes, got.found, got.false_alarms, got.alarms_per_day) == (1, 1, 0, None)


def test_means_of_the_truth_are_rounded_once(spark):
    """30.494665 is 30.49; by way of 30.495 it was 30.50."""
    rows = spark.createDataFrame([("s", T0 + dt.timedelta(minutes=i), 35.494665, 1) for i in range(4)], "k string, t timestamp, last_rtt double, evento_id int")
    got = synthesis.simple_truth(rows, ["k"], "t", 5.0, 2).first()
    assert (got.original_mean_rtt_ms, got.injected_mean_rtt_ms) == (30.49, 35.49)
    assert synthesis.simple_truth(rows, ["k"], "t", 5.0).first().original_mean_rtt_ms == 30.495


def test_matching_by_stretches_against_one_by_one(spark):
    """Long series, dense and sparse, equal times, series of one side only: each pair, one by one from the nearest."""
    rng = random.Random(5)
    rows = {s: ([rng.randint(0, span) / 4 for _ in range(n)], [rng.randint(0, span) / 4 for _ in range(m)]) for s, n, m, span in (("a", 60, 70, 300), ("b", 40, 50, 9000), ("c", 5, 0, 100), ("d", 0, 4, 100), ("e", 1, 1, 8))}
    side = lambda k: spark.createDataFrame([(s, x) for s, v in rows.items() for x in v[k]], "k string, t double")

    def greedy(a, b, most):
        pairs, left, right = sorted((abs(y - x), i, j) for i, x in enumerate(a) for j, y in enumerate(b) if abs(y - x) <= most), set(), set()
        for _, i, j in pairs:
            if i not in left and j not in right:
                left.add(i), right.add(j)
                yield i, j

    want, curve = [], []
    for s, (a, b) in rows.items():
        a, b = sorted(a), sorted(b)
        curve += [(s, most, len(list(greedy(a, b, most))), len(a), len(b)) for most in (0.0, 1.0, 6.0)]
        for result, most in (("VP", 1.0), ("desfase", 6.0)):
            pairs = list(greedy(a, b, most))
            want += [(s, result, a[i], b[j]) for i, j in pairs]
            a, b = [x for i, x in enumerate(a) if i not in {i for i, _ in pairs}], [x for j, x in enumerate(b) if j not in {j for _, j in pairs}]
        want += [(s, "FN", x, None) for x in a] + [(s, "FP", None, x) for x in b]
    got = evaluation.match_events(side(0), side(1), ["k"], "t", 1.0, 6.0)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert sorted(map(tuple, evaluation.tolerance_curve(side(0), side(1), ["k"], "t", [0.0, 1.0, 6.0]).collect())) == sorted(curve)
    plan = got._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInPandas" not in plan  # a call a series


def test_causes_come_from_one_matching(spark):
    """The matches were computed anew for each of the parts and marks."""
    own = spark.createDataFrame([("s", 10.0), ("s", 90.0)], "k string, t double")
    m = evaluation.match_events(own, own.filter("t > 50"), ["k"], "t", 1.0, 5.0)
    out = evaluation.event_causes(m, own.withColumn("structural", F.lit(None).cast("string")), own, own, ["k"], "t", 1.0, 1.0)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1


def test_graph_folds_each_cycle_once(spark):
    """Unknown hops join the AS around them, or are a node; no sort or window a hop, and one pass for all of a node's figures."""
    paths_ = {1: ["1", None, "1", None, None, "2", "2"], 2: [None, "1", "NaN", "2"], 3: [None, None], 4: ["1", "2", None, "1"]}
    rows = [("s", i, i, h + 1, f"a{h}", a, None if (i, h) == (3, 0) else float(10 * i + h)) for i, path in paths_.items() for h, a in enumerate(path)]
    hops = spark.createDataFrame(rows, "k string, t int, c int, hop int, ip string, asn string, rtt_ms double")
    view = graph.asn_view(hops, ["k"], ["t", "c"])
    got = {}
    for r in view.orderBy("t", "layer").collect():
        got.setdefault(r.t, []).append((r.layer, r.node, r.rtt_ms, r.hops, r.next))
    assert got[1] == [(1, "AS1", 11.0, 3, "?"), (2, "?", 13.5, 2, "AS2"), (3, "AS2", 15.5, 2, None)]
    assert got[2] == [(1, "?", 20.0, 1, "AS1"), (2, "AS1", 21.0, 1, "?"), (3, "?", 22.0, 1, "AS2"), (4, "AS2", 23.0, 1, None)]
    assert got[3] == [(1, "?", 31.0, 2, None)] and [x[1] for x in got[4]] == ["AS1", "AS2", "?", "AS1"]
    node = {r.node: (r.n, r.modal_layer, r.median_rtt, r.n_last) for r in graph.nodes(view, ["k"], ["t", "c"]).collect()}
    assert node["AS1"] == (4, 1, 30.5, 1) and node["?"] == (5, 1, 22.0, 1) and node["AS2"] == (3, 2, 23.0, 2)
    found = graph.edges(view, ["k"], ["t", "c"])
    assert {(r.source, r.target): r.n for r in found.collect()} == {("AS1", "?"): 2, ("?", "AS2"): 2, ("?", "AS1"): 2, ("AS1", "AS2"): 1, ("AS2", "?"): 1}
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_hops_meet_the_cycle_before_in_one_pass(spark):
    """Against a join by number; gone and blank hops, cycles without an address, hops that come twice; no join of hops with hops."""
    rng = random.Random(3)
    rows = [(s, t, 10 * t, h, rng.choice(["a", "b", "", None, "Unknown"]), rng.choice([None, "1", "2"]), rng.choice([None, 1.0, 5.0, 40.0])) for s in "xy" for t in range(12) for h in range(1, 5) for _ in range(rng.choice([0, 1, 1, 2]))]
    rows += [("x", 20, 200, 1, None, "1", 3.0)]
    k, c = ["s"], ["t", "i"]
    hops = spark.createDataFrame(rows, "s string, t int, i int, hop int, ip string, asn string, rtt_ms double")
    number, want = {}, []
    for s, t in sorted({(r[0], r[1]) for r in rows if r[4]}):
        number[s, t] = sum(x == s for x, _ in number)
    for r in rows:
        want += [(*r, *p[4:]) for p in rows if p[0] == r[0] and p[3] == r[3] and (r[0], r[1]) in number and number.get((p[0], p[1])) == number[r[0], r[1]] - 1]
    cols = [*hops.columns, "prev_ip", "prev_asn", "prev_rtt"]
    got = paths.with_previous(hops, None, k, c)
    for found in (got, paths.with_previous(hops, paths.cycles(hops, k, c), k, c)):
        assert sorted(map(repr, map(tuple, found.select(*cols).collect()))) == sorted(map(repr, want))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    both = paths.rtt_events(got).select(*cols, "categoria").unionByName(paths.ip_asn_events(got).select(*cols, "categoria"))
    assert sorted(map(repr, paths.hop_events(got).select(*cols, "categoria").collect())) == sorted(map(repr, both.collect()))


def test_resampling_sorts_no_whole_series(spark, monkeypatch):
    """Series cut into parts of 7 rows give the rows of one part, and no window is over a series."""
    rng = np.random.default_rng(3)
    data = [(k, i, T0 + dt.timedelta(seconds=int(t)), float(v)) for k, n in (("a", 95), ("b", 5), ("c", 1)) for i, (t, v) in enumerate(zip(np.cumsum(rng.integers(1, 90, n)), rng.normal(size=n).round(3)))]
    rows = spark.createDataFrame(data, "k string, id long, ts timestamp, x double")
    got = []
    for size in (1 << 17, 7):
        monkeypatch.setattr(windows, "PART", size)
        out = synthesis.resampled(rows, ["k"], ["ts", "id"], "x", "ts", 4, 1)
        got.append(sorted(map(tuple, out.select("k", "idx", "src_idx", "seam", "dt_us", "x", "jump").collect()), key=lambda r: r[:2]))
    assert got[0] == got[1] and len(got[0]) == 101
    by = {k: [r for r in got[0] if r[0] == k] for k in "abc"}
    assert all(r[5] == data[[d[0] for d in data].index(k) + r[2]][3] for k in "abc" for r in by[k])
    assert all((r[6] is None) if not r[3] else r[6] == r[5] - by[r[0]][r[1] - 1][5] for r in got[0])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert all("__part" in line for line in plan.splitlines() if "Window [" in line and "src_idx" in line)


def test_upper_median_over_cells(spark):
    values = [3, 1 << 21, 5, 1 << 22, (1 << 21) + 1, 3, -7]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 9), ("b", None)], "k string, x long")
    assert {tuple(r) for r in stats.upper_median_of(df, ["k"], "x", "m", 4).collect()} == {("a", sorted(values)[len(values) // 2]), ("b", 9)}


def test_exclusion_by_parts_equals_the_plain_rule(spark, monkeypatch):
    """Series over many parts of 5 cycles: exclusion and its report as windows over whole series say them."""
    rng = np.random.default_rng(5)
    data = [(k, T0 + dt.timedelta(minutes=i), int(n), ["A"] if n < 8 else ["B"], bool(r), "x", "9", 1.0) for k, m in (("a", 83), ("b", 4), ("c", 9)) for i, (n, r) in enumerate(zip(np.repeat(rng.integers(5, 9, m), 3)[:m], rng.random(m) < 0.7))]
    data += [("d", T0 + dt.timedelta(minutes=i), 5, ["A"], False, "x", "9", 1.0) for i in range(7)]
    cyc = spark.createDataFrame(data, "k string, ts timestamp_ntz, length int, as_path array<string>, reached boolean, last_ip string, last_asn string, last_rtt double")
    want, blocks_ = [], {}
    for k in "abcd":
        rows = [d for d in data if d[0] == k]
        there = [i for i, d in enumerate(rows) if d[4]]
        run, n = {}, 0
        for p, i in enumerate(there):
            n += p == 0 or rows[there[p - 1]][2] != rows[i][2]
            run[i] = n
        size = {x: list(run.values()).count(x) for x in run.values()}
        told = lambda i: (run[i], rows[i][2], size[run[i]] >= 3)  # noqa: B023, E731
        for i, d in enumerate(rows):
            if d[4]:
                if size[run[i]] < 3:
                    want.append((k, d[1], "parpadeo" if size[run[i]] == 1 else "transitorio", run[i], d[2], False, True, False, None))
                continue
            prev, nxt = max([j for j in there if j < i], default=None), min([j for j in there if j > i], default=None)
            own = told(prev) if prev is not None else told(nxt) if nxt is not None else (None, None, None)
            gap = prev is not None and nxt is not None and run[prev] != run[nxt]
            want.append((k, d[1], "sin_destino", *own, None if own[1] is None else d[2] == own[1], gap, run[nxt] if gap else None))
        # Blocks: runs of a route of 3 or more, put together with the next one of the same route.
        lasting = [(rows[next(i for i in run if run[i] == x)][2], [i for i in run if run[i] == x]) for x in sorted(size) if size[x] >= 3]
        b, before = 0, None
        spans = {}
        for route, ids in lasting:
            b += route != before
            before = route
            spans[b] = (min(ids + [spans[b][0]] if b in spans else ids), max(ids))
        blocks_ |= {(k, rows[i][1]): x for i in there for x, (lo, hi) in spans.items() if lo <= i <= hi}
        for i, d in enumerate(rows):
            if not d[4] and there:
                sides = [blocks_.get((k, rows[j][1])) for j in (max([j for j in there if j < i], default=None), min([j for j in there if j > i], default=None)) if j is not None]
                blocks_[(k, d[1])] = sides[0] if len(set(sides)) == 1 else None
    monkeypatch.setattr(windows, "PART", 5)
    key = lambda r: (r[0], r[1])
    got = paths.excluded_cycles(cyc, ["k"], ["ts"], 3).select("k", "ts", "motivo", "tramo_n", "tramo_longitud", "tramo_sostenido", "misma_longitud_que_tramo", "entre_tramos", "tramo_siguiente_n").collect()
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    report = reports.excluded_report(cyc, ["k"], ["ts"], 3)
    assert {(r.k, r.ciclo): (r.motivo, r.tramo_n, r.bloque_id) for r in report.collect()} == {(w[0], w[1]): (w[2], w[3], blocks_.get((w[0], w[1]))) for w in want}


@pytest.mark.parametrize("stay, starts, joins", [(1, [0], False), (60, [0, 500, 501, 9000], True), (4000, [0], True)])
def test_passes_with_statistics_equal_plain_ones(stay, starts, joins):
    """Laps of a long chunk, also where its rows are remembered for long, against the plain passes."""
    g = np.random.default_rng(stay)
    y = np.round(np.repeat(g.choice([30.0, 31.0, 38.0], 80_000 // stay), stay) + g.exponential(0.5, 80_000 // stay * stay), 2)
    s, y = hmm.Setting(k=8), y - y.mean()
    found = []
    for quick in (True, False):
        unit = hmm.Unit(y, starts, joins, joins)
        unit.passes = unit.passes if quick else None
        sums = unit.guess(np.linspace(y.min(), y.max(), 8), 1.0, 0.0)
        for _ in range(6):
            edge = np.full(len(sums.first), 1 / len(sums.first)) if joins else None
            sums, bound = unit.expect(hmm.Model.of(sums, len(y), s), edge, edge)
            assert bool(unit.quick) == quick
        found.append((sums, bound, unit.states(), *unit.told()))
    (a, bound, states, tail, head), (b, *plain) = found
    assert all(np.allclose(p, q, rtol=1e-7, atol=1e-7) for p, q in zip(a, b)) and np.isclose(bound, plain[0], rtol=1e-10)
    assert (states == plain[1]).all() and np.allclose(tail, plain[2], rtol=1e-7, atol=1e-12) and np.allclose(head, plain[3], rtol=1e-7, atol=1e-12)


def test_sweep_is_one_fit(spark, monkeypatch):
    """Runs with and without a percentile go through the model together, each on its own rows."""
    fit, seen = hmm.fit, []
    monkeypatch.setattr(hmm, "fit", lambda *a: seen.append(a[1]) or fit(*a))
    df = spark.createDataFrame([("s", i, 30.0 + (i // 40 % 2) * 9 + i % 3 * 0.1) for i in range(200)], "series_id string, i int, x double")
    got = {(r.config_id, r.seed): r.n for r in evaluation.sweep(df, ["series_id"], [{"percentile": p, "k": 3, "laps": 5} for p in (98.0, 0.0, 40.0)], [0, 1], ["i"], "x").collect()}
    left = {c: int((np.array([30.0 + (i // 40 % 2) * 9 + i % 3 * 0.1 for i in range(200)]) <= cut).sum()) for c, cut in ((0, 39.2), (1, 39.2), (2, 30.1))}
    assert len(seen) == 1 and got == {(c, s): n for c, n in left.items() for s in (0, 1)}


def test_chunk_without_news_is_not_run_again():
    """Its row goes on as it is, without its values being looked at."""
    states = np.zeros(3, np.int8)
    row = {"id": "s", "run": 0, "chunk": 1, "chunks": 2, "lap": 9, "own": [1.0], "tail": [1.0], "head": [1.0], "bound": -1.0, "all_bound": -2.0, "frozen": True, "news": False, "states": states}
    (out,) = hmm._round([hmm.Setting()])(iter([pd.DataFrame([row])]))
    assert not out.moved[0] and out.frozen[0] and out.lap[0] == 12 and out.states[0].tolist() == [0, 0, 0]
