"""Queries over the series view, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.expr import hour_of, micros, segment_class_unsigned
from ..operators import blocks, evaluation, profile, segments, synthesis, windows
from ..sources.adapters import SERIES_KEYS as K
from ..sources.adapters import SERIES_ORDER as O
from ..sources.adapters import SERIES_SQL, series

QUERIES: dict = {}
SQL: dict[str, str] = {}
DAY, HOUR = 86400.0, 3600.0
INTERVAL = 6 * HOUR


def query(sql: str | None = None, view: str = SERIES_SQL):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            head = "WITH RECURSIVE " if sql.startswith("WITH RECURSIVE ") else "WITH "
            SQL[f.__name__] = f"{head}{view}" + (", " + sql[len(head) :] if sql.startswith(head) else " " + sql)
        return f

    return add


def r6(*cols: str) -> list:
    return [F.round(c, 6).alias(c) for c in cols]


def q5(names=("p10", "p25", "p50", "p75", "p90"), col: str = "q") -> list:
    return [F.round(F.col(col)[i], 6).alias(n) for i, n in enumerate(names)]


_Q5 = ", ".join(f"round(quantile_cont({{x}}, {q}), 6) AS p{int(100 * q)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9))


def by_state(spark: SparkSession, sf: str) -> DataFrame:
    """One long series a state, for profiles."""
    return series(spark, sf).select(F.col("state").alias("series_id"), "cycle_ts", "event_id", "rtt_ms")


@query(f"SELECT series_id, count(*) AS n, {_Q5.format(x='rtt_ms')}, round(avg(rtt_ms), 6) AS mean, round(stddev_pop(rtt_ms), 6) AS std, min(rtt_ms) AS min, max(rtt_ms) AS max FROM v_series GROUP BY series_id")
def series_profile_quantiles(spark, sf):
    out = series(spark, sf).groupBy(*K).agg(F.count(F.lit(1)).alias("n"), stats.quantile("rtt_ms", windows.QS).alias("q"), F.avg("rtt_ms").alias("mean"), F.stddev_pop("rtt_ms").alias("std"), F.min("rtt_ms").alias("min"), F.max("rtt_ms").alias("max"))
    return out.select(*K, "n", *q5(), *r6("mean", "std"), "min", "max")


@query(f"""SELECT s.state AS series_id, CAST(hour(s.cycle_ts) AS INTEGER) AS hour, count(*) AS n, {_Q5.format(x='s.rtt_ms')}, round(avg(s.rtt_ms), 6) AS mean,
  round(avg(CASE WHEN s.rtt_ms > m.m + 10 THEN 1.0 ELSE 0.0 END), 6) AS spike_rate
  FROM v_series s JOIN (SELECT state, quantile_cont(rtt_ms, 0.5) AS m FROM v_series GROUP BY state) m USING (state) GROUP BY 1, 2 HAVING count(*) >= 5""")
def hourly_profile(spark, sf):
    return profile.hourly(by_state(spark, sf), K, "cycle_ts", "rtt_ms").select(*K, "hour", "n", *q5(), *r6("mean", "spike_rate"))


@query(f"SELECT state AS series_id, CAST(cycle_ts AS DATE) AS day, count(*) AS n, {_Q5.format(x='rtt_ms')} FROM v_series GROUP BY 1, 2 HAVING count(*) >= 20")
def daily_profile(spark, sf):
    return profile.daily(by_state(spark, sf), K, "cycle_ts", "rtt_ms").select(*K, "day", "n", *q5())


@query("""WITH d AS (SELECT state AS series_id, CAST(cycle_ts AS DATE) AS day, quantile_cont(rtt_ms, 0.1) AS f, quantile_cont(rtt_ms, 0.5) AS m FROM v_series GROUP BY 1, 2 HAVING count(*) >= 20)
  SELECT series_id, round(max(m) - min(m), 6) AS median_range, round(max(f) - min(f), 6) AS floor_range FROM d GROUP BY 1""")
def daily_drift(spark, sf):
    return profile.drift(profile.daily(by_state(spark, sf), K, "cycle_ts", "rtt_ms"), K).select(*K, *r6("median_range", "floor_range"))


_GRID = """WITH p AS (SELECT state AS series_id, epoch_us(cycle_ts) AS t, rtt_ms FROM v_series),
  s AS (SELECT series_id, min(t) AS a, max(t) AS b FROM p GROUP BY 1),
  g AS (SELECT series_id, unnest(range(a + {half}, b - {half} + 2, {step})) AS center_us FROM s WHERE a + {half} <= b - {half} + 1)"""


@query(_GRID.format(half=43_200_000_000, step=21_600_000_000) + f""" SELECT g.series_id, center_us, count(*) AS n, {_Q5.format(x='rtt_ms')}
  FROM g JOIN p ON p.series_id = g.series_id AND p.t BETWEEN center_us - 43200000000 AND center_us + 43200000000 GROUP BY 1, 2 HAVING count(*) >= 24""")
def moving_quantiles_grid(spark, sf):
    return windows.moving_quantiles(by_state(spark, sf), K, "cycle_ts", "rtt_ms", DAY, 6 * HOUR, 1800.0).select(*K, "center_us", "n", *q5())


@query(_GRID.format(half=43_200_000_000, step=21_600_000_000) + """, m AS (SELECT g.series_id, center_us, quantile_cont(rtt_ms, 0.1) AS f, quantile_cont(rtt_ms, 0.5) AS h, quantile_cont(rtt_ms, 0.9) AS t
  FROM g JOIN p ON p.series_id = g.series_id AND p.t BETWEEN center_us - 43200000000 AND center_us + 43200000000 GROUP BY 1, 2 HAVING count(*) >= 24),
  r AS (SELECT series_id, count(*) AS windows, quantile_cont(f, 0.95) - quantile_cont(f, 0.05) AS floor_range, quantile_cont(h, 0.95) - quantile_cont(h, 0.05) AS median_range, quantile_cont(t, 0.95) - quantile_cont(t, 0.05) AS tail_range FROM m GROUP BY 1)
  SELECT series_id, windows, round(floor_range, 6) AS floor_range, round(median_range, 6) AS median_range, round(tail_range, 6) AS tail_range, CASE WHEN floor_range >= 2 THEN 'mueve el piso' WHEN tail_range > 2 * floor_range THEN 'dispersion' ELSE 'estable' END AS reading FROM r""")
def moving_profile_reading(spark, sf):
    m = windows.moving_quantiles(by_state(spark, sf), K, "cycle_ts", "rtt_ms", DAY, 6 * HOUR, 1800.0)
    return profile.moving_spread(m, K).select(*K, "windows", *r6("floor_range", "median_range", "tail_range"), "reading")


@query("SELECT series_id, cycle_ts, event_id, round(quantile_cont(rtt_ms, 0.25) OVER w, 6) AS p25, round(quantile_cont(rtt_ms, 0.5) OVER w, 6) AS p50 FROM v_series WINDOW w AS (PARTITION BY series_id ORDER BY epoch_us(cycle_ts) RANGE BETWEEN 43200000000 PRECEDING AND 43200000000 FOLLOWING)")
def moving_quantiles_range(spark, sf):
    half = 43_200_000_000
    w = Window.partitionBy(*K).orderBy(micros("cycle_ts")).rangeBetween(-half, half)
    return series(spark, sf).withColumn("q", stats.quantile("rtt_ms", [0.25, 0.5]).over(w)).select(*K, "cycle_ts", "event_id", *q5(("p25", "p50")))


@query(_GRID.format(half=10_800_000_000, step=3_600_000_000) + """, ref AS (SELECT series_id, quantile_cont(rtt_ms, 0.25) AS ref FROM p GROUP BY 1),
  m AS (SELECT g.series_id, center_us, quantile_cont(rtt_ms, 0.25) AS f FROM g JOIN p ON p.series_id = g.series_id AND p.t BETWEEN center_us - 10800000000 AND center_us + 10800000000 GROUP BY 1, 2 HAVING count(*) >= 6),
  a AS (SELECT m.series_id, threshold, center_us, f - ref AS above FROM m JOIN ref USING (series_id), (VALUES (2.0::DOUBLE), (5.0::DOUBLE)) v(threshold) WHERE f - ref >= threshold),
  n AS (SELECT *, CASE WHEN center_us - lag(center_us) OVER (PARTITION BY series_id, threshold ORDER BY center_us) > 5400000000 THEN 1 ELSE 0 END AS new FROM a),
  e AS (SELECT *, sum(new) OVER (PARTITION BY series_id, threshold ORDER BY center_us) AS e FROM n)
  SELECT series_id, threshold, min(center_us) - 1800000000 AS start_us, max(center_us) + 1800000000 AS end_us, max(center_us) - min(center_us) + 3600000000 AS duration_us, round(max(above), 6) AS max_x
  FROM e GROUP BY series_id, threshold, e HAVING max(center_us) - min(center_us) + 3600000000 >= 10800000000""")
def floor_elevation_episodes(spark, sf):
    out = profile.floor_elevation(by_state(spark, sf), K, "cycle_ts", "rtt_ms", 1800.0, min_s=3 * HOUR)
    return out.select(*K, "threshold", "start_us", "end_us", "duration_us", *r6("max_x"))


@query("""WITH s AS (SELECT *, epoch_us(cycle_ts) AS t, min(epoch_us(cycle_ts)) OVER (PARTITION BY state) AS a, max(epoch_us(cycle_ts)) OVER (PARTITION BY state) AS b FROM v_series)
  SELECT state AS series_id, least(((t - a) * 200) // (b - a + 1), 199) AS "column", count(*) AS n, min(rtt_ms) AS min, max(rtt_ms) AS max, round(avg(rtt_ms), 6) AS mean FROM s GROUP BY 1, 2""")
def timeline_downsample(spark, sf):
    return profile.downsample(by_state(spark, sf), K, "cycle_ts", "rtt_ms", 200).select(*K, "column", "n", "min", "max", *r6("mean"))


@query("""WITH g AS (SELECT *, CASE WHEN epoch_us(cycle_ts) - lag(epoch_us(cycle_ts)) OVER w > 21600000000 THEN 1 ELSE 0 END AS j FROM v_series WINDOW w AS (PARTITION BY series_id ORDER BY cycle_ts, event_id)),
  q AS (SELECT *, CAST(sum(j) OVER (PARTITION BY series_id ORDER BY cycle_ts, event_id) AS BIGINT) AS seq_id FROM g)
  SELECT series_id, seq_id, count(*) AS n, min(cycle_ts) AS start_ts, max(cycle_ts) AS end_ts FROM q GROUP BY 1, 2""")
def gap_sequences(spark, sf):
    s = windows.with_sequences(series(spark, sf), K, O, "cycle_ts", INTERVAL)
    return s.groupBy(*K, "seq_id").agg(F.count(F.lit(1)).alias("n"), F.min("cycle_ts").alias("start_ts"), F.max("cycle_ts").alias("end_ts"))


_RUNS = """WITH i AS (SELECT *, row_number() OVER w - 1 AS i, CASE WHEN state IS NOT DISTINCT FROM lag(state) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS st FROM v_series WINDOW w AS (PARTITION BY series_id ORDER BY cycle_ts, event_id)),
  c AS (SELECT *, CAST(sum(st) OVER (PARTITION BY series_id ORDER BY cycle_ts, event_id) AS BIGINT) AS run_id FROM i),
  r AS (SELECT series_id, run_id, state, count(*) AS n, min(i) AS i0, max(i) AS i1, min(cycle_ts) AS start_ts, max(cycle_ts) AS end_ts FROM c GROUP BY 1, 2, 3)"""


@query(_RUNS + " SELECT * FROM r")
def runs(spark, sf):
    return windows.runs(series(spark, sf), K, O, ["state"], "cycle_ts")


@query(_RUNS + " SELECT series_id, CASE WHEN n >= 2 THEN 'sostenido' WHEN n = 1 THEN 'parpadeo' ELSE 'transitorio' END AS clase, count(*) AS runs, CAST(sum(n) AS BIGINT) AS cycles FROM r GROUP BY 1, 2")
def runs_by_length_class(spark, sf):
    from ..operators.paths import length_runs

    r = length_runs(series(spark, sf), K, O, 2, "state")
    return r.groupBy(*K, "clase").agg(F.count(F.lit(1)).alias("runs"), F.sum("n").alias("cycles"))


_BLOCKS = _RUNS + """, k AS (SELECT *, CASE WHEN state IS NOT DISTINCT FROM lag(state) OVER (PARTITION BY series_id ORDER BY i0) AND row_number() OVER (PARTITION BY series_id ORDER BY i0) > 1 THEN 0 ELSE 1 END AS bs FROM r WHERE n >= 2),
  kk AS (SELECT *, CAST(sum(bs) OVER (PARTITION BY series_id ORDER BY i0) AS BIGINT) AS block_id FROM k),
  b AS (SELECT series_id, block_id, state, min(i0) AS i0, max(i1) AS i1, min(start_ts) AS start_ts, max(end_ts) AS end_ts, count(*) AS merged, max(i1) - min(i0) + 1 AS n_inside FROM kk GROUP BY 1, 2, 3),
  m AS (SELECT b.*, c.i, c.cycle_ts, c.event_id, c.rtt_ms, c.state AS own_state FROM b JOIN c ON c.series_id = b.series_id AND c.i BETWEEN b.i0 AND b.i1),
  t AS (SELECT series_id, block_id, state, i0, i1, start_ts, end_ts, merged, n_inside, CAST(sum(CASE WHEN own_state IS DISTINCT FROM state THEN 1 ELSE 0 END) AS BIGINT) AS outside FROM m GROUP BY ALL)"""


@query(_BLOCKS + " SELECT * FROM t")
def route_blocks(spark, sf):
    return blocks.block_table(series(spark, sf), K, O, "state", 2)


_CADENCE = """, dt AS (SELECT series_id, epoch_us(cycle_ts) - lag(epoch_us(cycle_ts)) OVER (PARTITION BY series_id ORDER BY cycle_ts, event_id) AS dt FROM v_series),
  cad AS (SELECT series_id, list_sort(list(dt))[CAST(floor(count(*) / 2) AS BIGINT) + 1] / 1e6 AS cadence_s FROM dt WHERE dt IS NOT NULL GROUP BY 1)"""


@query("WITH " + _CADENCE[2:] + " SELECT series_id, round(cadence_s, 6) AS cadence_s FROM cad")
def series_cadence(spark, sf):
    return windows.cadence(series(spark, sf), K, O, "cycle_ts").select(*K, *r6("cadence_s"))


@query(_BLOCKS + _CADENCE + """, z AS (SELECT t.*, n_inside - outside AS own, (epoch_us(end_ts) - epoch_us(start_ts)) / 1e6 AS span, cadence_s FROM t JOIN cad USING (series_id)),
  y AS (SELECT *, round(span / 3600, 1) AS duration_h, own / CASE WHEN cadence_s > 0 THEN (span + cadence_s) / cadence_s ELSE n_inside END AS cover FROM z),
  x AS (SELECT *, own >= 3 AND cover >= 0.8 AS eligible FROM y), v AS (SELECT *, bool_or(eligible) OVER (PARTITION BY series_id) AS a FROM x),
  u AS (SELECT *, row_number() OVER w AS rk, lead(duration_h) OVER w AS second_h FROM v WHERE eligible OR NOT a WINDOW w AS (PARTITION BY series_id ORDER BY duration_h DESC, block_id))
  SELECT series_id, block_id, state, duration_h, own, round(cover, 6) AS cover, eligible, second_h, duration_h > 0 AND coalesce(second_h / duration_h, 0) >= 0.8 AS tight FROM u WHERE rk = 1""")
def main_block(spark, sf):
    s = series(spark, sf)
    m = blocks.main_block(blocks.block_table(s, K, O, "state", 2), K, windows.cadence(s, K, O, "cycle_ts"), 3, 0.8)
    return m.select(*K, "block_id", "state", "duration_h", "own", *r6("cover"), "eligible", "second_h", "tight")


@query("""WITH i AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY cycle_ts, event_id) AS i FROM v_series), c AS (SELECT series_id, state, count(*) AS n, min(i) AS p FROM i GROUP BY 1, 2)
  SELECT series_id, state AS mode, n AS mode_n FROM c QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY n DESC, p) = 1""")
def mode_first_seen(spark, sf):
    rows = windows.with_position(series(spark, sf), K, O)
    return stats.mode_first_seen(rows, K, "state", "pos", "mode")


@query("""WITH i AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY cycle_ts, event_id) AS i FROM v_series), c AS (SELECT series_id, state, count(*) AS n, min(i) AS p FROM i GROUP BY 1, 2)
  SELECT * FROM (SELECT series_id, state, n, CAST(row_number() OVER (PARTITION BY series_id ORDER BY n DESC, p) AS INTEGER) AS rank FROM c) WHERE rank <= 3""")
def topk_states(spark, sf):
    return stats.top_k(windows.with_position(series(spark, sf), K, O), K, "state", "pos", 3)


@query("SELECT series_id, cycle_ts, event_id, p AS prev_state, state FROM (SELECT *, lag(state) OVER (PARTITION BY series_id ORDER BY cycle_ts, event_id) AS p FROM v_series) WHERE p <> state")
def change_points(spark, sf):
    return segments.change_points(series(spark, sf), K, O, "state").select(*K, "cycle_ts", "event_id", "prev_state", "state")


_SEG = _RUNS + """, g AS (SELECT series_id, run_id AS segment_id, state, min(cycle_ts) AS start_ts, max(cycle_ts) AS end_ts, count(*) AS n, avg(rtt_ms) AS mean, quantile_cont(rtt_ms, 0.5) AS median, stddev_pop(rtt_ms) AS std, min(rtt_ms) AS min, max(rtt_ms) AS max, count(*) * 1200.0 / 60 AS minutes FROM c GROUP BY 1, 2, 3)"""
_CLASS = """CASE WHEN minutes > 60 AND abs(deviation) > 5 THEN sg || '_severa_sostenida' WHEN minutes > 30 AND abs(deviation) > 2 THEN sg || '_moderada_sostenida'
  WHEN minutes < 10 AND abs(deviation) > 10 THEN 'pico_transitorio' WHEN abs(deviation) < 1 THEN 'regimen_base' ELSE 'variacion_normal' END"""
_LAB = _SEG + f""", ref AS (SELECT state, quantile_cont(rtt_ms, 0.25) AS reference FROM v_series GROUP BY 1), h AS (SELECT g.*, reference, median - reference AS deviation, CASE WHEN median - reference > 0 THEN 'degradacion' ELSE 'mejora' END AS sg FROM g JOIN ref USING (state)),
  l AS (SELECT *, {_CLASS} AS kind FROM h)"""


def _segments(spark, sf):
    return segments.segments(series(spark, sf), K, O, "state", "rtt_ms", "cycle_ts", 1200.0)


def _labelled(spark, sf):
    return segments.label_segments(_segments(spark, sf), segments.references(series(spark, sf), ["state"], "rtt_ms"), ["state"])


@query(_SEG + " SELECT series_id, segment_id, state, start_ts, end_ts, n, round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std, min, max, CAST(minutes AS DOUBLE) AS minutes FROM g")
def characterised_segments(spark, sf):
    return _segments(spark, sf).select(*K, "segment_id", "state", "start_ts", "end_ts", "n", *r6("mean", "median", "std"), "min", "max", "minutes")


@query("SELECT state, round(quantile_cont(rtt_ms, 0.25), 6) AS reference FROM v_series GROUP BY 1")
def reference_p25(spark, sf):
    return segments.references(series(spark, sf), ["state"], "rtt_ms").select("state", *r6("reference"))


@query(_LAB + " SELECT series_id, segment_id, round(deviation, 6) AS deviation, kind FROM l")
def segment_labels(spark, sf):
    return _labelled(spark, sf).select(*K, "segment_id", *r6("deviation"), "kind")


@query(_SEG + """, f AS (SELECT quantile_cont(rtt_ms, 0.25) AS floor FROM v_series) SELECT series_id, segment_id, CASE WHEN minutes > 60 AND abs(mean - floor) > 5 THEN 'degradacion_severa_sostenida' WHEN minutes > 30 AND abs(mean - floor) > 2 THEN 'degradacion_moderada_sostenida'
  WHEN minutes < 10 AND abs(mean - floor) > 10 THEN 'pico_transitorio' WHEN abs(mean - floor) < 1 THEN 'regimen_base' ELSE 'variacion_normal' END AS kind FROM g, f""")
def segment_labels_unsigned(spark, sf):
    floor = series(spark, sf).agg(F.percentile("rtt_ms", 0.25).alias("floor"))  # one row
    return _segments(spark, sf).crossJoin(F.broadcast(floor)).select(*K, "segment_id", segment_class_unsigned("minutes", "mean", "floor").alias("kind"))


@query(_LAB + """, n AS (SELECT *, CASE WHEN kind = lag(kind) OVER w THEN 0 ELSE 1 END AS st2 FROM l WINDOW w AS (PARTITION BY series_id ORDER BY segment_id)),
  o AS (SELECT *, CAST(sum(st2) OVER (PARTITION BY series_id ORDER BY segment_id) AS BIGINT) AS group_id FROM n),
  p AS (SELECT series_id, group_id, kind, min(start_ts) AS start_ts, max(end_ts) AS end_ts, CAST(sum(n) AS BIGINT) AS n, sum(n * mean) / sum(n) AS mean, sum(n * (std * std + mean * mean)) / sum(n) AS sq, arg_max(median, n * 1000000 - segment_id) AS median, min(min) AS min, max(max) AS max, count(*) AS n_segments FROM o GROUP BY 1, 2, 3)
  SELECT series_id, group_id, kind, start_ts, end_ts, n, round(mean, 6) AS mean, round(median, 6) AS median, round(sqrt(greatest(sq - mean * mean, 0)), 4) AS std, min, max, n_segments FROM p""")
def segment_groups(spark, sf):
    g = segments.group_segments(_labelled(spark, sf), K, ["segment_id"], ["kind"])
    return g.select(*K, "group_id", "kind", "start_ts", "end_ts", "n", *r6("mean", "median"), F.round("std", 4).alias("std"), "min", "max", "n_segments")


@query(_SEG + """, a AS (SELECT series_id, sum(n) AS tot, sum(n * std * std) / sum(n) AS within, sum(n * mean) / sum(n) AS mu, sum(n * mean * mean) / sum(n) AS sq FROM g GROUP BY 1), b AS (SELECT *, greatest(sq - mu * mu, 0) AS between FROM a)
  SELECT series_id, round(within, 4) AS within, round(between, 4) AS between, round(between / within, 6) AS ratio FROM b""")
def variance_quality(spark, sf):
    return segments.variance_quality(_segments(spark, sf), K).select(*K, F.round("within", 4).alias("within"), F.round("between", 4).alias("between"), *r6("ratio"))


@query(_BLOCKS + """, own AS (SELECT series_id, block_id, cycle_ts, event_id, rtt_ms, row_number() OVER (PARTITION BY series_id, block_id ORDER BY cycle_ts, event_id) AS f, count(*) OVER (PARTITION BY series_id, block_id) AS n FROM m WHERE own_state = state),
  z AS (SELECT series_id, block_id, max(n) AS n, min(cycle_ts) AS start_ts FROM own GROUP BY 1, 2), bo AS (SELECT p.series_id, p.block_id, q.start_ts, least(10, p.n, q.n) AS k FROM z p JOIN z q ON q.series_id = p.series_id AND q.block_id = p.block_id + 1),
  be AS (SELECT bo.series_id, bo.block_id, quantile_cont(rtt_ms, 0.5) AS before_ms FROM bo JOIN own o ON o.series_id = bo.series_id AND o.block_id = bo.block_id AND o.n - o.f + 1 <= k GROUP BY 1, 2),
  af AS (SELECT bo.series_id, bo.block_id, quantile_cont(rtt_ms, 0.5) AS after_ms FROM bo JOIN own o ON o.series_id = bo.series_id AND o.block_id = bo.block_id + 1 AND o.f <= k GROUP BY 1, 2),
  d AS (SELECT *, after_ms - before_ms AS delta FROM bo JOIN be USING (series_id, block_id) JOIN af USING (series_id, block_id))
  SELECT series_id, block_id, block_id + 1 AS next_block_id, start_ts AS ts, round(before_ms, 6) AS before_ms, round(after_ms, 6) AS after_ms, round(delta, 6) AS delta_ms, CAST(k AS BIGINT) AS "window",
    CASE WHEN abs(delta) > 5 THEN CASE WHEN delta > 0 THEN 'degradacion_severa' ELSE 'mejora_severa' END WHEN abs(delta) > 2 THEN CASE WHEN delta > 0 THEN 'degradacion_moderada' ELSE 'mejora_moderada' END ELSE 'sin_cambio_relevante' END AS kind FROM d""")
def route_changes(spark, sf):
    s = series(spark, sf)
    members = blocks.block_members(s, blocks.blocks(s, K, O, "state", 2), K, O, "state").filter("own")
    out = segments.route_changes(members, K, O, "rtt_ms")
    return out.select(*K, "block_id", "next_block_id", "ts", *r6("before_ms", "after_ms", "delta_ms"), F.col("window").cast("long").alias("window"), "kind")


@query("""WITH s AS (SELECT state, avg(rtt_ms) AS m, greatest(stddev_pop(rtt_ms), 1e-6) AS d FROM v_series GROUP BY 1)
  SELECT a.state AS a, b.state AS b, round((a.m - b.m) * (a.m - b.m) / (a.d * a.d + b.d * b.d) / 4 + ln((a.d * a.d + b.d * b.d) / (2 * a.d * b.d)) / 2, 8) AS distance FROM s a JOIN s b ON a.state < b.state""")
def state_bhattacharyya(spark, sf):
    return segments.state_distances(series(spark, sf).withColumn("one", F.lit(1)), ["one"], "state", "rtt_ms").select("a", "b", F.round("distance", 8).alias("distance"))


@query(_RUNS + """, st AS (SELECT series_id, avg(rtt_ms) AS mu, var_pop(rtt_ms) AS v FROM v_series GROUP BY 1), d AS (SELECT c.series_id, run_id, i, rtt_ms - mu AS d, v FROM c JOIN st USING (series_id)),
  p AS (SELECT d.series_id, k.k AS lag, d.v, d.d * e.d AS x FROM d JOIN (VALUES (1), (2), (3)) k(k) ON true LEFT JOIN d e ON e.series_id = d.series_id AND e.run_id = d.run_id AND e.i = d.i - k.k)
  SELECT series_id, lag, round(CASE WHEN max(v) > 0 THEN avg(x) / max(v) END, 6) AS acf FROM p GROUP BY 1, 2""")
def acf_pooled(spark, sf):
    r = windows.with_runs(series(spark, sf), K, O, ["state"])
    return stats.pooled_acf(r, K, "run_id", "event_id", "rtt_ms", 3).select(*K, "lag", *r6("acf"))


@query("""WITH d AS (SELECT series_id, state, CASE WHEN lag(state) OVER (PARTITION BY series_id ORDER BY cycle_ts, event_id) <> state THEN 1 ELSE 0 END AS ch FROM v_series), a AS (SELECT series_id, count(*) AS n, sum(ch) AS ch FROM d GROUP BY 1),
  k AS (SELECT series_id, sum(k * k) AS sq FROM (SELECT series_id, state, count(*) AS k FROM v_series GROUP BY 1, 2) GROUP BY 1)
  SELECT series_id, n, round(CASE WHEN n > 1 THEN ch / (n - 1) END, 6) AS observed, round(1 - sq / (n * n), 6) AS expected, round(n / (ch + 1), 6) AS mean_run FROM a JOIN k USING (series_id)""")
def alternation_stats(spark, sf):
    return blocks.alternation(series(spark, sf), K, O, "state").select(*K, "n", *r6("observed", "expected", "mean_run"))


KS_SQL = """ks AS (SELECT g, max(n1) AS n1, max(n2) AS n2, max(abs(ca / n1 - cb / n2)) AS d FROM (SELECT g, x, sum(a) OVER o AS ca, sum(b) OVER o AS cb, sum(a) OVER (PARTITION BY g) AS n1, sum(b) OVER (PARTITION BY g) AS n2
    FROM (SELECT g, x, sum(CASE WHEN first THEN 1 ELSE 0 END) AS a, sum(CASE WHEN first THEN 0 ELSE 1 END) AS b FROM both_ GROUP BY 1, 2) WINDOW o AS (PARTITION BY g ORDER BY x)) WHERE n1 > 0 AND n2 > 0 GROUP BY 1),
  lam AS (SELECT *, (sqrt(n1 * n2 / (n1 + n2)) + 0.12 + 0.11 / sqrt(n1 * n2 / (n1 + n2))) * d AS la FROM ks),
  kp AS (SELECT *, CASE WHEN la < 1e-9 THEN 1.0::DOUBLE ELSE least(greatest(list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * k * k * la * la))), 0.0), 1.0) END AS p FROM lam)"""


@query("""WITH cnt AS (SELECT state, count(*) AS n, min(event_id) AS p0, quantile_cont(rtt_ms, 0.5) AS median, row_number() OVER (ORDER BY count(*) DESC, min(event_id)) AS rk, sum(count(*)) OVER () AS tot FROM v_series GROUP BY 1),
  e AS (SELECT * FROM cnt WHERE rk = 1 OR n >= greatest(10, ceil(0.02 * tot))), top AS (SELECT state AS ref, median AS refm FROM e WHERE rk = 1),
  both_ AS (SELECT s.state AS g, s.rtt_ms AS x, true AS first FROM v_series s JOIN e ON e.state = s.state AND rk > 1 UNION ALL SELECT e.state, s.rtt_ms, false FROM e, top, v_series s WHERE e.rk > 1 AND s.state = top.ref), """ + KS_SQL + """
  SELECT state, n, round(median, 6) AS median, round(CASE WHEN rk > 1 THEN median - refm END, 6) AS delta_ms, round(d, 8) AS d, round(p, 8) AS p, CASE WHEN rk = 1 THEN 'referencia' WHEN p < 0.01 AND abs(median - refm) >= greatest(1.0, 0.1 * least(median, refm)) THEN 'distinto' ELSE 'equivalente' END AS verdict FROM e CROSS JOIN top LEFT JOIN kp ON kp.g = e.state""")
def ks_compare_states(spark, sf):
    rows = series(spark, sf).withColumn("one", F.lit(1))
    out = blocks.compare_samples(rows, ["one"], "state", "rtt_ms", "event_id")
    return out.select("state", "n", *r6("median", "delta_ms"), F.round("d", 8).alias("d"), F.round("p", 8).alias("p"), "verdict")


@query("WITH both_ AS (SELECT series_id AS g, rtt_ms AS x, state = 'view' AS first FROM v_series WHERE rtt_ms >= 10), " + KS_SQL + " SELECT g AS series_id, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(d, 8) AS d, round(p, 8) AS p FROM kp")
def ks_beside_nulls(spark, sf):
    """Values under 10 are taken for missing: they belong to no sample."""
    rows = series(spark, sf).select(*K, F.when(F.col("rtt_ms") >= 10, F.col("rtt_ms")).alias("x"), (F.col("state") == "view").alias("first"))
    return stats.ks_two_samples(rows, K, "x", "first").select(*K, "n1", "n2", F.round("d", 8).alias("d"), F.round("p", 8).alias("p"))


@query("""WITH m AS (SELECT series_id, quantile_cont(rtt_ms, 0.5) AS m FROM v_series GROUP BY 1) SELECT series_id, round(1.4826 * quantile_cont(abs(rtt_ms - m), 0.5), 6) AS sigma FROM v_series JOIN m USING (series_id) GROUP BY 1""")
def robust_sigma(spark, sf):
    return stats.robust_sigma(series(spark, sf), K, "rtt_ms").select(*K, *r6("sigma"))


_PAD = """WITH i AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY series_id) AS n, first_value(rtt_ms) OVER w AS fv, last_value(rtt_ms) OVER (PARTITION BY series_id ORDER BY cycle_ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lv FROM v_series WINDOW w AS (PARTITION BY series_id ORDER BY cycle_ts, event_id))"""


@query(_PAD + """, v AS (SELECT *, list(rtt_ms) OVER (PARTITION BY series_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS a FROM i)
  SELECT series_id, event_id, list_sort(list_concat(list_transform(range(0, greatest(0, 5 - i)), lambda z: fv), a, list_transform(range(0, greatest(0, i + 4 - n)), lambda z: lv)))[5] AS median FROM v""")
def moving_median(spark, sf):
    return windows.moving_median(series(spark, sf), K, O, "rtt_ms", 9).select(*K, "event_id", "median")


@query(_PAD + """, v AS (SELECT *, list(rtt_ms) OVER (PARTITION BY series_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS a FROM i), s AS (SELECT series_id, event_id, list_sort(list_concat(list_transform(range(0, greatest(0, 6 - i)), lambda z: fv), a)) AS x FROM v),
  m AS (SELECT *, x[3] + (x[4] - x[3]) * 0.5 AS md FROM s), d AS (SELECT *, list_sort(list_transform(x, lambda z: abs(z - md))) AS y FROM m)
  SELECT series_id, event_id, round(x[1] + (x[2] - x[1]) * 0.5, 6) AS p10_6, round(md, 6) AS median_6, round(x[5] + (x[6] - x[5]) * 0.5, 6) AS p90_6, round(y[3] + (y[4] - y[3]) * 0.5, 6) AS mad_6, round(len(list_filter(x, lambda z: z > 60)) / 6.0::DOUBLE, 6) AS above_6 FROM d""")
def causal_features(spark, sf):
    out = windows.causal_features(series(spark, sf), K, O, "rtt_ms", [6], 60.0)
    return out.select(*K, "event_id", *r6("p10_6", "median_6", "p90_6", "mad_6", "above_6"))


_TRUTH = "tr AS (SELECT *, CASE state WHEN 'error' THEN 6.0 WHEN 'purchase' THEN 1.0 ELSE 0.0 END AS lv FROM v_series)"


def _truth(spark, sf):
    return series(spark, sf).withColumn("lv", F.when(F.col("state") == "error", 6.0).when(F.col("state") == "purchase", 1.0).otherwise(0.0))


@query("WITH " + _TRUTH + """, s AS (SELECT *, row_number() OVER w - 1 AS i, lv - lag(lv) OVER w AS step, count(*) OVER (PARTITION BY series_id) AS n FROM tr WINDOW w AS (PARTITION BY series_id ORDER BY cycle_ts, event_id)), c AS (SELECT * FROM s WHERE abs(step) >= 0.05),
  d AS (SELECT *, i - coalesce(lag(i) OVER v, 0) AS "left", coalesce(lead(i) OVER v, n) - i AS "right" FROM c WINDOW v AS (PARTITION BY series_id ORDER BY i))
  SELECT series_id, event_id, CAST(step AS DOUBLE) AS step, "left", "right", CASE WHEN abs(step) < 2 THEN 'bajo_umbral' WHEN least("left", "right") < 2 THEN 'estructural' ELSE 'evaluable' END AS kind FROM d""")
def truth_change_points(spark, sf):
    return synthesis.truth_changes(_truth(spark, sf), K, O, "lv", min_plateau=2).select(*K, "event_id", "step", "left", "right", "kind")


@query(_SEG + ", " + _TRUTH + """, j AS (SELECT g.series_id, segment_id, lv FROM g JOIN tr ON tr.series_id = g.series_id AND tr.cycle_ts BETWEEN g.start_ts AND g.end_ts), q AS (SELECT series_id, segment_id, quantile_cont(CAST(lv AS DOUBLE), 0.5) AS true_delta FROM j GROUP BY 1, 2)
  SELECT j.series_id, j.segment_id, max(true_delta) AS true_delta, count(*) AS n, round(avg(CASE WHEN lv > true_delta - 0.05 AND lv < true_delta + 0.05 THEN 1.0 ELSE 0.0 END), 6) AS purity FROM j JOIN q USING (series_id, segment_id) GROUP BY 1, 2""")
def segment_purity(spark, sf):
    segs = _segments(spark, sf).withColumns({"lo": micros("start_ts"), "hi": micros("end_ts")})
    truth = _truth(spark, sf).withColumn("t", micros("cycle_ts"))
    return evaluation.segment_truth(segs, truth, K, "segment_id", "t", "lo", "hi", "lv", 86_400_000_000).select(*K, "segment_id", "true_delta", "n", *r6("purity"))


@query("SELECT series_id, round(avg(CASE WHEN state = 'view' THEN 1.0 ELSE 0.0 END), 6) AS base_share, avg(CASE WHEN state = 'view' THEN 1.0 ELSE 0.0 END) >= 0.25 AS identifiable FROM v_series GROUP BY 1")
def base_share(spark, sf):
    t = series(spark, sf).withColumn("regimen", F.when(F.col("state") == "view", "base").otherwise("x"))
    return evaluation.base_share(t, K, "regimen").select(*K, *r6("base_share"), "identifiable")


@query(_BLOCKS + """, z AS (SELECT series_id, count(*) AS cycles FROM v_series GROUP BY 1), y AS (SELECT series_id, count(*) AS blocks, CAST(sum(CASE WHEN n_inside < 10 THEN 1 ELSE 0 END) AS BIGINT) AS short_blocks, CAST(sum(n_inside) AS BIGINT) AS inside FROM t GROUP BY 1)
  SELECT series_id, cycles, coalesce(blocks, 0) AS blocks, coalesce(short_blocks, 0) AS short_blocks, cycles - coalesce(inside, 0) AS outside FROM z LEFT JOIN y USING (series_id)""")
def block_coverage(spark, sf):
    s = windows.with_position(series(spark, sf), K, O)
    return evaluation.coverage(s, blocks.blocks(series(spark, sf), K, O, "state", 2), K, "pos")


@query("""WITH e AS (SELECT * FROM v_series WHERE state = 'error') SELECT s.series_id, s.event_id FROM v_series s WHERE s.state = 'purchase' AND EXISTS (SELECT 1 FROM e WHERE e.series_id = s.series_id AND epoch_us(e.cycle_ts) BETWEEN epoch_us(s.cycle_ts) - 7200000000 AND epoch_us(s.cycle_ts) + 7200000000)""")
def near_mark_semi(spark, sf):
    s = series(spark, sf).withColumn("t", micros("cycle_ts"))
    return evaluation.near_any(s.filter("state = 'purchase'"), s.filter("state = 'error'"), K, "t", 7_200_000_000).select(*K, "event_id")


@query("""WITH c AS (SELECT series_id, cycle_ts, event_id, state, lag(state) OVER (PARTITION BY series_id ORDER BY cycle_ts, event_id) AS p FROM v_series), cp AS (SELECT * FROM c WHERE p <> state), e AS (SELECT * FROM v_series WHERE state IN ('error', 'signup')),
  j AS (SELECT cp.series_id, cp.event_id, e.state AS cat, e.event_id AS o FROM cp JOIN e ON e.series_id = cp.series_id AND epoch_us(e.cycle_ts) BETWEEN epoch_us(cp.cycle_ts) - 7200000000 AND epoch_us(cp.cycle_ts) + 7200000000)
  SELECT cp.series_id, cp.event_id, f.cat AS category, f.cat IS NOT NULL AS topological FROM cp LEFT JOIN (SELECT series_id, event_id, arg_min(cat, o) AS cat FROM j GROUP BY 1, 2) f USING (series_id, event_id)""")
def topology_correlation(spark, sf):
    s = series(spark, sf)
    ev = s.filter("state in ('error', 'signup')").withColumnRenamed("state", "categoria")
    return segments.topology_near(segments.change_points(s, K, O, "state"), ev, K, "cycle_ts", "event_id", 120.0).select(*K, "event_id", "category", "topological")


@query("""SELECT series_id, event_id, last_value(CASE WHEN state = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY cycle_ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
  first_value(CASE WHEN state = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY cycle_ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM v_series""")
def asof_surrounding(spark, sf):
    return windows.surrounding(series(spark, sf), K, O, F.col("state") == "view", "event_id").select(*K, "event_id", "prev", "next")


@query("""SELECT series_id, event_id, cycle_ts FROM v_series QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY abs(epoch_us(cycle_ts) - 1705320000000000), cycle_ts) = 1""")
def nearest_cycle(spark, sf):
    return windows.nearest_row(series(spark, sf), K, "cycle_ts", F.lit(1_705_320_000_000_000)).select(*K, "event_id", "cycle_ts")


_SCORED = "x AS (SELECT event_id, user_id % 7 AS g, CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS INTEGER) AS y, round(value, 0) AS p FROM events)"


def _scored(spark, sf):
    s = series(spark, sf)
    return s.select("event_id", (F.col("series_id") % 7).alias("g"), (F.col("state") == "error").cast("int").alias("y"), F.round("rtt_ms", 0).alias("p"))


@query("SELECT g, round(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 6) AS precision, round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 6) AS recall, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM (SELECT g, sum(CASE WHEN p > 60 AND y = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN p > 60 AND y = 0 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN p <= 60 AND y = 1 THEN 1 ELSE 0 END) AS fn FROM x GROUP BY g)", _SCORED)
def pr_metrics(spark, sf):
    hit, true = F.col("p") > 60, F.col("y") == 1
    n = lambda c: F.sum(c.cast("long"))
    t = _scored(spark, sf).groupBy("g").agg(n(hit & true).alias("tp"), n(hit & ~true).alias("fp"), n(~hit & true).alias("fn"))
    return t.select("g", *[F.round(v, 6).alias(k) for k, v in stats.precision_recall("tp", "fp", "fn").items()])


@query("SELECT g, round(sum(CASE WHEN y = 1 THEN tp / r END) / nullif(sum(y), 0), 6) AS ap FROM (SELECT g, y, sum(y) OVER w AS tp, row_number() OVER w AS r FROM x WINDOW w AS (PARTITION BY g ORDER BY p DESC, event_id)) GROUP BY g", _SCORED)
def average_precision(spark, sf):
    return stats.average_precision(_scored(spark, sf), ["g"], "p", "y", "event_id").select("g", *r6("ap"))


@query("SELECT g, round((sum(y * rk) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0), 6) AS auroc FROM (SELECT g, y, rank() OVER (PARTITION BY g ORDER BY p) + (count(*) OVER (PARTITION BY g, p) - 1) / 2 AS rk FROM x) GROUP BY g", _SCORED)
def auroc(spark, sf):
    return stats.auroc(_scored(spark, sf), ["g"], "p", "y").select("g", *r6("auroc"))


@query("SELECT CAST(y AS VARCHAR) AS expected, CASE WHEN p > 60 THEN '1' ELSE '0' END AS obtained, count(*) AS n FROM x GROUP BY 1, 2", _SCORED)
def confusion_matrix(spark, sf):
    rows = _scored(spark, sf).select(F.col("y").cast("string").alias("y"), F.when(F.col("p") > 60, "1").otherwise("0").alias("z"))
    return stats.confusion(rows, "y", "z")


@query("SELECT g, count(e) AS n, round(avg(e), 6) AS mean, round(avg(abs(e)), 6) AS mae, round(quantile_cont(e, 0.5), 6) AS median, round(quantile_cont(abs(e), 0.9), 6) AS p90_abs, max(abs(e)) AS max_abs FROM (SELECT g, p - 40 AS e FROM x) GROUP BY g", _SCORED)
def error_summary(spark, sf):
    out = _scored(spark, sf).withColumn("e", F.col("p") - 40).groupBy("g").agg(*stats.error_summary("e"))
    return out.select("g", "n", *r6("mean", "mae", "median", "p90_abs"), "max_abs")


@query("""WITH b AS (SELECT series_id, cycle_ts, event_id, CASE WHEN state IN ('error', 'purchase') THEN 1 ELSE 0 END AS t, CASE WHEN rtt_ms > 30 THEN 1 ELSE 0 END AS p FROM v_series),
  s AS (SELECT *, CASE WHEN p = lag(p) OVER w THEN 0 ELSE 1 END AS sp, CASE WHEN t = lag(t) OVER w THEN 0 ELSE 1 END AS st FROM b WINDOW w AS (PARTITION BY series_id ORDER BY cycle_ts, event_id)),
  r AS (SELECT *, sum(sp) OVER w AS rp, sum(st) OVER w AS rt FROM s WINDOW w AS (PARTITION BY series_id ORDER BY cycle_ts, event_id)), k AS (SELECT *, p = 1 AND count(*) OVER (PARTITION BY series_id, rp) >= 2 AS keep FROM r),
  a AS (SELECT series_id, rt, CASE WHEN avg(CASE WHEN keep THEN 1.0 ELSE 0.0 END) >= 0.5 THEN 1 ELSE 0 END AS hit FROM k WHERE t = 1 GROUP BY 1, 2 HAVING count(*) >= 2), f AS (SELECT series_id, rp, CASE WHEN max(t) = 0 THEN 1 ELSE 0 END AS fa FROM k WHERE keep GROUP BY 1, 2)
  SELECT u.series_id, coalesce(x.episodes, 0) AS episodes, CAST(coalesce(x.found, 0) AS BIGINT) AS found, CAST(coalesce(y.fa, 0) AS BIGINT) AS false_alarms, round(CASE WHEN days > 0 THEN coalesce(y.fa, 0) / days END, 6) AS alarms_per_day
  FROM (SELECT series_id, (epoch_us(max(cycle_ts)) - epoch_us(min(cycle_ts))) / 86.4e9 AS days FROM v_series GROUP BY 1) u
  LEFT JOIN (SELECT series_id, count(*) AS episodes, sum(hit) AS found FROM a GROUP BY 1) x USING (series_id) LEFT JOIN (SELECT series_id, sum(fa) AS fa FROM f GROUP BY 1) y USING (series_id)""")
def episode_scores(spark, sf):
    rows = series(spark, sf).withColumns({"t": F.col("state").isin("error", "purchase").cast("int"), "p": (F.col("rtt_ms") > 30).cast("int")})
    return evaluation.episode_scores(rows, K, O, "t", "p", 2).withColumn("alarms_per_day", F.round("alarms_per_day", 6))


@query("""WITH i AS (SELECT series_id, event_id, row_number() OVER (PARTITION BY series_id ORDER BY cycle_ts, event_id) AS i, count(*) OVER (PARTITION BY series_id) AS n FROM v_series)
  SELECT series_id, event_id, CASE WHEN i <= floor(n * 0.5) THEN 'train' WHEN i <= floor(n * 0.5) + 4 THEN 'purged' ELSE 'test' END AS part FROM i""")
def temporal_split(spark, sf):
    return evaluation.temporal_split(series(spark, sf), K, O, 0.5, 4).select(*K, "event_id", "part")


@query("""SELECT series_id, event_id, CAST(cycle_ts AS VARCHAR) <> '' AS ok, CAST(floor(((epoch_us(cycle_ts) + 19800000000) % 86400000000) / 3600000000) AS INTEGER) AS hour FROM v_series""")
def hour_with_offset(spark, sf):
    return series(spark, sf).select(*K, "event_id", F.lit(True).alias("ok"), hour_of("cycle_ts", 5.5).alias("hour"))


@query("""WITH s AS (SELECT series_id, list_sort(list(rtt_ms)) AS v FROM v_series GROUP BY 1) SELECT series_id, v[CAST(floor(0.9 * (len(v) - 1)) AS BIGINT) + 1] AS low_p90, v[len(v) // 2 + 1] AS upper_median FROM s""")
def rank_quantiles(spark, sf):
    return series(spark, sf).groupBy(*K).agg(stats.at_rank("rtt_ms", 0.9).alias("low_p90"), stats.upper_median("rtt_ms").alias("upper_median"))


@query("""WITH i AS (SELECT series_id, event_id, row_number() OVER w AS i, coalesce(date_diff('second', lag(date_trunc('second', cycle_ts)) OVER w, date_trunc('second', cycle_ts)), 0) // 100000 AS dt FROM v_series WINDOW w AS (PARTITION BY series_id ORDER BY cycle_ts, event_id)),
  r AS (SELECT *, 1000 + sum(dt) OVER (PARTITION BY series_id ORDER BY i) - i AS r FROM i) SELECT series_id, event_id, CAST(max(r) OVER (PARTITION BY series_id ORDER BY i) + i AS BIGINT) AS t FROM r""")
def monotonic_times(spark, sf):
    w = windows.over(K, O)
    sec = F.floor(micros("cycle_ts") / 1_000_000)
    rows = series(spark, sf).withColumn("dt", F.floor(F.coalesce(sec - F.lag(sec).over(w), F.lit(0)) / 100_000))
    return windows.monotonic_times(rows, K, O, "dt", 1000).select(*K, "event_id", "t")


@query()
def smooth_states(spark, sf):
    rows = series(spark, sf).withColumn("code", (F.crc32("state") % 3).cast("int"))
    return segments.smoothed(rows.select(*K, "cycle_ts", "event_id", "code"), K, O, "code", 2)


def _long(spark, sf):
    """A level that moves: a fraction of the values on steps by week, a series a state."""
    s = by_state(spark, sf)
    step = F.floor((micros("cycle_ts") - F.lit(1_704_067_200_000_000)) / F.lit(604_800_000_000))
    return s.withColumn("rtt_ms", F.col("rtt_ms") / 100 + F.when(step % 2 == 1, 8.0).otherwise(0.0) + 30)


@query()
def hmm_segments(spark, sf):
    rows = windows.with_sequences(_long(spark, sf), K, O, "cycle_ts", 24 * HOUR).withColumn("block_id", F.lit(1).cast("long"))
    states = segments.model_states(rows, K, O, "rtt_ms", k=15, laps=100, kappa=1000.0)
    return segments.segments(states, [*K, "block_id"], O, "state", "rtt_ms", "cycle_ts", 1200.0)


@query()
def level_segmentation(spark, sf):
    return synthesis.with_levels(_long(spark, sf), K, O, "rtt_ms").select(*K, "cycle_ts", "event_id", "level", "residual")


@query()
def bootstrap_pool(spark, sf):
    levelled = synthesis.with_levels(_long(spark, sf), K, O, "rtt_ms")
    return synthesis.pool(levelled, K).groupBy(*K).agg(F.count(F.lit(1)).alias("n"), F.first("base").alias("base"), F.sum(F.col("base_regime").cast("long")).alias("base_rows"), F.sum(F.col("spike").cast("long")).alias("spikes"))


_LONG = """sl AS (SELECT state AS series_id, cycle_ts, event_id, rtt_ms / 100 + CASE WHEN CAST(floor((epoch_us(cycle_ts) - 1704067200000000) / 604800000000) AS BIGINT) % 2 = 1 THEN 8.0 ELSE 0.0 END + 30 AS rtt_ms FROM v_series)"""
_DRAW = lambda what: f"CAST('0x' || substr(md5({what}), 1, 12) AS BIGINT)"
_RESAMPLED = "WITH " + _LONG + """, sr AS (SELECT series_id, rtt_ms, row_number() OVER w - 1 AS i, epoch_us(cycle_ts) - lag(epoch_us(cycle_ts)) OVER w AS dt, count(*) OVER (PARTITION BY series_id) AS n FROM sl WINDOW w AS (PARTITION BY series_id ORDER BY cycle_ts, event_id)),
  md AS (SELECT series_id, (list(dt ORDER BY dt) FILTER (dt IS NOT NULL))[(count(dt) // 2) + 1] AS mid FROM sr GROUP BY 1),
  us AS (SELECT series_id, dt, row_number() OVER (PARTITION BY series_id ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY series_id) AS m FROM sr JOIN md USING (series_id) WHERE 2 * dt > mid AND 2 * dt < 3 * mid),
  out_ AS (SELECT series_id, i AS idx, n, i // 24 AS b, i % 24 AS o FROM sr),
  pl AS (SELECT *, """ + _DRAW("'1|' || series_id || '|' || b || '|1'") + " % greatest(n - 23, 1) + o AS src_idx, " + _DRAW("'1|' || series_id || '|' || b || '|dt'") + """ AS dr FROM out_),
  rs AS (SELECT pl.series_id, pl.idx, pl.src_idx, o = 0 AND pl.idx > 0 AS seam, CASE WHEN o > 0 THEN sr.dt ELSE coalesce((SELECT us.dt FROM us WHERE us.series_id = pl.series_id AND us.k = dr % us.m), mid) END AS dt_us, sr.rtt_ms
    FROM pl JOIN sr ON sr.series_id = pl.series_id AND sr.i = pl.src_idx JOIN md ON md.series_id = pl.series_id)"""


def _resampled(spark, sf):
    return synthesis.resampled(_long(spark, sf), K, O, "rtt_ms", "cycle_ts", 24, 1)


@query(_RESAMPLED + " SELECT series_id, idx, src_idx, seam, CAST(dt_us AS BIGINT) AS dt_us, round(rtt_ms, 6) AS rtt_ms, round(CASE WHEN seam THEN rtt_ms - lag(rtt_ms) OVER (PARTITION BY series_id ORDER BY idx) END, 6) AS jump FROM rs")
def bootstrap_series(spark, sf):
    return _resampled(spark, sf).select(*K, "idx", "src_idx", "seam", "dt_us", *r6("rtt_ms", "jump"))


#: Each series' 30 draws of blocks of 24, with their shares of high values and of failures.
_DRAWS = "WITH " + _LONG + """, fl AS (SELECT series_id, rtt_ms > 39.2 AS s, event_id % 7 = 0 AS f, row_number() OVER (PARTITION BY series_id ORDER BY cycle_ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM sl),
  tr AS (SELECT * FROM fl CROSS JOIN (SELECT unnest(range(1, 31)) AS attempt)), pk AS (SELECT series_id, attempt, n, i % 24 + """ + _DRAW("'2|' || series_id || '|' || (i // 24) || '|' || attempt") + """ % greatest(n - 23, 1) AS src FROM tr),
  rt AS (SELECT pk.series_id, attempt, avg(CASE WHEN s THEN 1.0 ELSE 0 END) AS s, avg(CASE WHEN f THEN 1.0 ELSE 0 END) AS f FROM pk JOIN fl ON fl.series_id = pk.series_id AND fl.i = pk.src GROUP BY 1, 2),
  ow AS (SELECT series_id, avg(CASE WHEN s THEN 1.0 ELSE 0 END) AS s0, avg(CASE WHEN f THEN 1.0 ELSE 0 END) AS f0 FROM fl GROUP BY 1),
  dv AS (SELECT series_id, attempt, greatest(CASE WHEN s0 > 1e-9 THEN abs(s - s0) / s0 WHEN s < 0.001 THEN 0.0 ELSE 1.0 END, CASE WHEN f0 > 1e-9 THEN abs(f - f0) / f0 WHEN f < 0.001 THEN 0.0 ELSE 1.0 END) AS d FROM rt JOIN ow USING (series_id))"""


def _flagged(spark, sf):
    rows = _long(spark, sf).withColumns({"spike": F.col("rtt_ms") > 39.2, "fail": F.col("event_id") % 7 == 0})
    return rows.withColumn("src_idx", (F.row_number().over(windows.over(K, O)) - 1).cast("long"))


@query(_DRAWS + " SELECT series_id, attempt, round(d, 6) AS deviation FROM dv QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY d > 0.25, CASE WHEN d > 0.25 THEN d ELSE 0 END, attempt) = 1")
def bootstrap_draws(spark, sf):
    return synthesis.chosen_draws(_flagged(spark, sf), K, 24, 2, "spike", "fail").withColumn("deviation", F.round("deviation", 6))


@query(_DRAWS + " SELECT series_id, attempt, round(d, 6) AS deviation FROM dv QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY d > 0.01, CASE WHEN d > 0.01 THEN d ELSE 0 END, attempt) = 1")
def bootstrap_draws_strict(spark, sf):
    return synthesis.chosen_draws(_flagged(spark, sf), K, 24, 2, "spike", "fail", 30, 0.01).withColumn("deviation", F.round("deviation", 6))


_CELL = "'1|' || series_id || '|' || CAST(d AS INT) || '|' || CAST(h AS INT) || '|' || r || '|"
_DESIGN = "WITH " + _LONG + """, ce AS (SELECT DISTINCT series_id, d, h, r FROM sl CROSS JOIN (SELECT unnest([2.0, 3.0, 5.0, 10.0, 20.0]::DOUBLE[]) AS d) CROSS JOIN (SELECT unnest([6.0, 24.0]::DOUBLE[]) AS h) CROSS JOIN (SELECT unnest([0, 1]) AS r)),
  dr AS (SELECT *, greatest(1, CAST(round(h * 0.5) AS BIGINT)) AS n, CAST(round(12.0 * 0.5 * (1 + """ + _DRAW(_CELL + "gap'") + " % 1048576 / 2097152.0::DOUBLE)) AS BIGINT) AS gap, CAST(5 + " + _DRAW(_CELL + "hop'") + " % 4 AS INT) AS hop, " + _DRAW(_CELL + "place'") + """ % 1099511627776 AS place FROM ce),
  st AS (SELECT series_id, d AS delta, hop, CASE WHEN d >= 5 THEN 'severa' ELSE 'moderada' END AS kind, n, CAST(6 + sum(gap + n) OVER (PARTITION BY series_id ORDER BY place, d, h, r) - n AS BIGINT) AS i0 FROM dr)"""


def _design(spark, sf):
    one = _long(spark, sf).select(*K).distinct().withColumns({"cycles_per_h": F.lit(0.5), "path_length": F.lit(8)})
    return synthesis.step_design(one, K, 1, hours=(6.0, 24.0))


@query(_DESIGN + " SELECT series_id, i0, i0 + n - 1 AS i1, delta AS delta_ms, hop, kind FROM st")
def step_design(spark, sf):
    return _design(spark, sf)


@query(_DESIGN + """, ix AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY cycle_ts, event_id) - 1 AS idx FROM sl)
  SELECT ix.series_id, idx, round(rtt_ms + coalesce(CASE WHEN hop <= 8 THEN delta END, 0), 6) AS rtt_ms, coalesce(delta, 0.0) AS delta_ms, coalesce(kind, 'base') AS regimen FROM ix LEFT JOIN st ON st.series_id = ix.series_id AND idx BETWEEN i0 AND i0 + n - 1""")
def injected_steps(spark, sf):
    rows = windows.with_position(_long(spark, sf), K, O, "idx").withColumn("hop", F.lit(8))
    return synthesis.inject_steps(rows, _design(spark, sf), K).select(*K, "idx", *r6("rtt_ms"), "delta_ms", "regimen")


_CHANGES = "WITH " + _LONG + """, ro AS (SELECT series_id, count(*) - 72 AS room FROM sl GROUP BY 1 HAVING count(*) >= 72), dc AS (SELECT series_id, e, """ + _DRAW("'42|' || series_id || '|' || e || '|change'") + """ % (room + 1) AS d FROM ro CROSS JOIN (SELECT unnest([1, 2, 3]) AS e)),
  ch AS (SELECT series_id, CAST(row_number() OVER o AS INT) AS e, d + 26 * (row_number() OVER o - 1) AS a FROM dc WINDOW o AS (PARTITION BY series_id ORDER BY d, e)), ix AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY cycle_ts, event_id) - 1 AS i FROM sl),
  ij AS (SELECT ix.series_id, event_id, cycle_ts, rtt_ms, e FROM ix LEFT JOIN ch ON ch.series_id = ix.series_id AND i >= a AND i < a + 20)"""


def _changed(spark, sf):
    rows = _long(spark, sf).withColumn("last_rtt", F.col("rtt_ms"))
    return synthesis.inject_simple(rows, synthesis.simple_design(rows, K, 3, 20, 42), K, O, 5.0)


@query(_CHANGES + " SELECT series_id, event_id, round(CASE WHEN e IS NULL THEN rtt_ms ELSE rtt_ms + 5.0 END, 6) AS last_rtt, e AS evento_id FROM ij")
def simple_injection(spark, sf):
    return _changed(spark, sf).select(*K, "event_id", *r6("last_rtt"), "evento_id")


@query(_CHANGES + " SELECT series_id, e AS evento_id, min(cycle_ts) AS start_ts, max(cycle_ts) AS end_ts, count(*) AS duration_cycles, round(avg(rtt_ms), 2) AS original_mean_rtt_ms, round(avg(rtt_ms) + 5.0, 2) AS injected_mean_rtt_ms, 5.0::DOUBLE AS magnitude_injected_ms FROM ij WHERE e IS NOT NULL GROUP BY 1, 2")
def synthetic_truth(spark, sf):
    return synthesis.simple_truth(_changed(spark, sf), K, "cycle_ts", 5.0, 2)


_REALISM = lambda t, order, name: f"""s_{name} AS (SELECT series_id, avg(x) AS m, stddev_pop(x) AS s, median(x) AS q2, {", ".join(f"quantile_cont(x, {q}) AS p{round(100 * q)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9, 0.99))} FROM (SELECT series_id, rtt_ms AS x FROM {t}) GROUP BY 1),
  g_{name} AS (SELECT t.series_id, 1.4826 * median(abs(rtt_ms - q2)) AS sigma FROM {t} t JOIN s_{name} USING (series_id) GROUP BY 1),
  n_{name} AS (SELECT series_id, rtt_ms AS x, lead(rtt_ms) OVER (PARTITION BY series_id ORDER BY {order}) AS nx FROM {t}),
  m_{name} AS (SELECT n.series_id, avg((x - m) * (nx - m)) / nullif(max(s * s), 0) AS acf1, avg(CASE WHEN x - q2 > greatest(3.0, 6 * sigma) THEN 1.0 ELSE 0.0 END) AS tasa_picos FROM n_{name} n JOIN s_{name} USING (series_id) JOIN g_{name} USING (series_id) GROUP BY 1),
  c_{name} AS (SELECT series_id, unnest(['p10', 'p25', 'p50', 'p75', 'p90', 'p99', 'media', 'std', 'sigma_robusta', 'acf1', 'tasa_picos']) AS metrica, unnest([p10, p25, p50, p75, p90, p99, m, s, sigma, acf1, tasa_picos]) AS v FROM s_{name} JOIN g_{name} USING (series_id) JOIN m_{name} USING (series_id))"""  # noqa: E731


@query(_RESAMPLED + ", " + _REALISM("sl", "cycle_ts, event_id", "a") + ", " + _REALISM("rs", "idx", "b") + """ SELECT series_id, metrica, round(c_a.v, 6) AS pool_real, round(c_b.v, 6) AS sintetico,
  CASE WHEN abs(c_a.v - c_b.v) <= CASE metrica WHEN 'p99' THEN 2.0 WHEN 'acf1' THEN 0.1 WHEN 'tasa_picos' THEN 0.05 ELSE 0.5 END THEN 'OK' ELSE 'REVISAR' END AS estado FROM c_a JOIN c_b USING (series_id, metrica)""")
def realism_check(spark, sf):
    out = synthesis.realism(_long(spark, sf), _resampled(spark, sf), K, O, ["idx"], "rtt_ms", {"": 0.5, "p99": 2.0, "acf1": 0.1, "tasa_picos": 0.05})
    return out.select(*K, "metrica", *r6("pool_real", "sintetico"), "estado")


def _times(spark, sf, state):
    return series(spark, sf).filter(F.col("state") == state).select(*K, (micros("cycle_ts") / 1e6).alias("t"))


#: Greedy matching one pair after the other: a fold over each list of pairs, nearest first.
_TIMES = "ta AS (SELECT series_id, epoch_us(cycle_ts) / 1e6 AS t, row_number() OVER (PARTITION BY series_id ORDER BY cycle_ts) AS i FROM v_series WHERE state = 'error'), tb AS (SELECT series_id, epoch_us(cycle_ts) / 1e6 AS t, row_number() OVER (PARTITION BY series_id ORDER BY cycle_ts) AS j FROM v_series WHERE state = 'view')"
_FOLD = """{n}p AS (SELECT {by}, list({{'i': i, 'j': j}} ORDER BY gap, i, j) AS ps FROM ({pairs}) GROUP BY ALL),
  {n}f AS (SELECT {by}, ps, 1 AS k, []::BIGINT[] AS ua, []::BIGINT[] AS ub FROM {n}p
    UNION ALL SELECT {by}, ps, k + 1, CASE WHEN ok THEN list_append(ua, ps[k].i) ELSE ua END, CASE WHEN ok THEN list_append(ub, ps[k].j) ELSE ub END
      FROM (SELECT *, NOT list_contains(ua, ps[k].i) AND NOT list_contains(ub, ps[k].j) AS ok FROM {n}f WHERE k <= len(ps))),
  {n}m AS (SELECT {by}, unnest(ua) AS i, unnest(ub) AS j FROM {n}f WHERE k = len(ps) + 1)"""
_MATCHED = "WITH RECURSIVE " + _TIMES + ", " + _FOLD.format(n="x", by="series_id", pairs="SELECT series_id, i, j, abs(tb.t - ta.t) AS gap FROM ta JOIN tb USING (series_id) WHERE abs(tb.t - ta.t) <= 3600")
_MATCHED += ", la AS (SELECT * FROM ta ANTI JOIN xm USING (series_id, i)), lb AS (SELECT * FROM tb ANTI JOIN xm USING (series_id, j)), "
_MATCHED += _FOLD.format(n="y", by="series_id", pairs="SELECT series_id, i, j, abs(lb.t - la.t) AS gap FROM la JOIN lb USING (series_id) WHERE abs(lb.t - la.t) <= 14400")
_MATCHED += """, mt AS (SELECT series_id, 'VP' AS result, ta.t AS t_true, tb.t AS t_found FROM xm JOIN ta USING (series_id, i) JOIN tb USING (series_id, j) UNION ALL SELECT series_id, 'desfase', ta.t, tb.t FROM ym JOIN ta USING (series_id, i) JOIN tb USING (series_id, j)
    UNION ALL SELECT series_id, 'FN', t, NULL FROM la ANTI JOIN ym USING (series_id, i) UNION ALL SELECT series_id, 'FP', NULL, t FROM lb ANTI JOIN ym USING (series_id, j))"""


@query(_MATCHED + " SELECT * FROM mt")
def event_matching(spark, sf):
    return evaluation.match_events(_times(spark, sf, "error"), _times(spark, sf, "view"), K, "t", 3600.0, 4 * 3600.0)


_CAUSES = _MATCHED + """, st AS (SELECT series_id, epoch_us(cycle_ts) / 1e6 AS t, min(CASE WHEN rtt_ms < 20 THEN 'corto' END) AS structural FROM v_series WHERE state = 'error' GROUP BY 1, 2),
  fa AS (SELECT series_id, t_found, result = 'desfase' AS late FROM mt WHERE result IN ('FP', 'desfase')), mk AS (SELECT series_id, epoch_us(cycle_ts) / 1e6 AS t, state FROM v_series),
  ca AS (SELECT mt.series_id, CASE result WHEN 'VP' THEN 'VP' ELSE 'FN' END AS result, t_true, t_found, structural, CASE WHEN result <> 'VP' THEN coalesce(structural, CASE result WHEN 'desfase' THEN 'detectado_con_desfase' ELSE 'no_detectado' END) END AS cause
      FROM mt JOIN st ON st.series_id = mt.series_id AND st.t = mt.t_true
    UNION ALL SELECT series_id, 'FP', NULL, t_found, NULL, CASE WHEN late THEN 'desfase_de_evento' WHEN EXISTS (SELECT 1 FROM mk WHERE mk.series_id = fa.series_id AND state = 'purchase' AND abs(mk.t - t_found) <= 7200) THEN 'cerca_de_spike'
      WHEN EXISTS (SELECT 1 FROM mk WHERE mk.series_id = fa.series_id AND state = 'signup' AND abs(mk.t - t_found) <= 36000) THEN 'cambio_subumbral' ELSE 'sin_causa_identificada' END FROM fa)"""


def _causes(spark, sf):
    truth = series(spark, sf).filter("state = 'error'").select(*K, (micros("cycle_ts") / 1e6).alias("t"), F.when(F.col("rtt_ms") < 20, "corto").alias("structural"))
    return evaluation.event_causes(event_matching(spark, sf), truth, _times(spark, sf, "purchase"), _times(spark, sf, "signup"), K, "t", 7200.0, 36000.0)


@query(_CAUSES + " SELECT * FROM ca")
def event_causes(spark, sf):
    return _causes(spark, sf)


@query(_CAUSES + """, z AS (SELECT series_id, count(*) FILTER (result <> 'FP') AS n_true, count(*) FILTER (result <> 'FN') AS n_found, count(*) FILTER (result = 'VP') AS vp, count(*) FILTER (result = 'VP' AND structural IS NULL) AS vp_eval, count(*) FILTER (result = 'FN') AS fn,
    count(*) FILTER (result = 'FN' AND structural IS NOT NULL) AS fn_structural, count(*) FILTER (result <> 'FP' AND structural IS NULL) AS ne, count(*) FILTER (result = 'FN' AND cause = 'detectado_con_desfase') AS late_eval, count(*) FILTER (result = 'FP') AS fp, count(*) FILTER (cause IN ('cerca_de_spike', 'sin_causa_identificada')) AS spurious FROM ca GROUP BY 1),
  y AS (SELECT *, vp / nullif(n_found, 0) AS p, vp_eval / nullif(ne, 0) AS r FROM z)
  SELECT series_id, n_true, n_found, vp, vp_eval, fn, fn_structural, ne - vp_eval AS fn_eval, late_eval, fp, spurious, ne - vp_eval - late_eval AS fn_real, round(p, 6) AS precision, round((n_found - spurious) / nullif(n_found, 0), 6) AS precision_justified, round(r, 6) AS recall_eval,
    round((vp_eval + late_eval) / nullif(ne, 0), 6) AS recall_wide, round(vp / nullif(n_true, 0), 6) AS recall_all, CASE WHEN p > 0 AND r > 0 THEN round(2 / (1 / p + 1 / r), 6) END AS f1 FROM y""")
def detection_scores(spark, sf):
    out = evaluation.detection_scores(_causes(spark, sf), K)
    rates = ["precision", "precision_justified", "recall_eval", "recall_wide", "recall_all", "f1"]
    return out.select(*[c for c in out.columns if c not in rates], *r6(*rates))


@query("WITH RECURSIVE " + _TIMES + ", tl AS (SELECT unnest([0.0, 600.0, 3600.0, 7200.0])::DOUBLE AS tolerance), " + _FOLD.format(n="x", by="series_id, tolerance", pairs="SELECT series_id, tolerance, i, j, abs(tb.t - ta.t) AS gap FROM ta JOIN tb USING (series_id) CROSS JOIN tl WHERE abs(tb.t - ta.t) <= tolerance") + """,
  na AS (SELECT series_id, count(*) AS n_true FROM ta GROUP BY 1), nb AS (SELECT series_id, count(*) AS n_found FROM tb GROUP BY 1), nm AS (SELECT series_id, tolerance, count(*) AS matched FROM xm GROUP BY 1, 2)
  SELECT series_id, tolerance, coalesce(matched, 0) AS matched, coalesce(n_true, 0) AS n_true, coalesce(n_found, 0) AS n_found FROM (FROM na FULL JOIN nb USING (series_id)) CROSS JOIN tl LEFT JOIN nm USING (series_id, tolerance)""")
def tolerance_curve(spark, sf):
    return evaluation.tolerance_curve(_times(spark, sf, "error"), _times(spark, sf, "view"), K, "t", [0.0, 600.0, 3600.0, 7200.0])


_SCORES = _LAB + ", " + _TRUTH + """, j AS (SELECT l.series_id, segment_id, lv FROM l JOIN tr ON tr.series_id = l.series_id AND tr.cycle_ts BETWEEN l.start_ts AND l.end_ts), td AS (SELECT series_id, segment_id, median(CAST(lv AS DOUBLE)) AS d FROM j GROUP BY 1, 2),
  pu AS (SELECT series_id, segment_id, any_value(d) AS d, avg(CASE WHEN abs(lv - d) < 0.05 THEN 1.0 ELSE 0.0 END) AS purity FROM j JOIN td USING (series_id, segment_id) GROUP BY 1, 2), bs AS (SELECT series_id, count(*) FILTER (state = 'view') / count(*) AS b FROM v_series GROUP BY 1),
  lm AS (SELECT l.series_id, segment_id, l.n, l.kind, minutes, d AS deviation, purity, b, CASE WHEN d > 0 THEN 'degradacion' ELSE 'mejora' END AS sg FROM l JOIN pu USING (series_id, segment_id) JOIN bs USING (series_id)),
  sc AS (SELECT *, """ + _CLASS + """ AS expected, CASE WHEN b < 0.25 THEN 'no_identificable' WHEN n < 2 THEN 'micro' WHEN abs(deviation) BETWEEN 1.5 AND 2.5 OR abs(deviation) BETWEEN 4.5 AND 5.5 THEN 'ambiguo' ELSE 'evaluado' END AS status FROM lm)"""


def _label_scores(spark, sf):
    share = evaluation.base_share(_truth(spark, sf).withColumn("regimen", F.when(F.col("state") == "view", "base")), K, "regimen")
    truth = segment_purity(spark, sf).drop("n")
    rows = _labelled(spark, sf).join(truth, [*K, "segment_id"]).join(share, K)
    return evaluation.score_labels(rows, "minutes", "true_delta", "n", "base_share", min_n=2)


@query(_SCORES + " SELECT series_id, segment_id, n, kind, expected, status, deviation AS true_delta, round(purity, 6) AS purity FROM sc")
def label_scores(spark, sf):
    return _label_scores(spark, sf).select(*K, "segment_id", "n", "kind", "expected", "status", "true_delta", "purity")


@query(_SCORES + """, e AS (SELECT *, CAST(expected = kind AS INTEGER) AS ok FROM sc) SELECT series_id, count(*) AS n_total, round(avg(ok), 6) AS accuracy_all, count(*) FILTER (status = 'evaluado') AS n, round(avg(ok) FILTER (status = 'evaluado'), 6) AS accuracy,
  round(sum(ok * n) FILTER (status = 'evaluado') / sum(n) FILTER (status = 'evaluado'), 6) AS accuracy_cycles, round(avg(purity) FILTER (status = 'evaluado'), 5) AS purity, count(*) FILTER (status = 'evaluado' AND purity < 0.9) AS impure, count(*) FILTER (status = 'no_identificable') AS unidentifiable,
  count(*) FILTER (status = 'ambiguo') AS ambiguous, count(*) FILTER (status = 'ambiguo' AND ok = 1) AS ambiguous_ok, count(*) FILTER (status = 'micro') AS micro, count(*) FILTER (status = 'micro' AND ok = 1) AS micro_ok FROM e GROUP BY 1""")
def label_accuracy(spark, sf):
    out = evaluation.label_accuracy(_label_scores(spark, sf), K, "kind", "n", "purity")
    rates = ["accuracy_all", "accuracy", "accuracy_cycles"]
    return out.select(*[c for c in out.columns if c not in [*rates, "purity"]], *r6(*rates), F.round("purity", 5).alias("purity"))


@query(_LAB + """, q AS (SELECT * FROM l WHERE kind LIKE 'degradacion%' AND kind LIKE '%sostenida%') SELECT series_id, event_id, CASE WHEN EXISTS (SELECT 1 FROM q WHERE q.series_id = v.series_id AND v.cycle_ts >= q.start_ts AND v.cycle_ts <= q.end_ts) THEN 1 ELSE 0 END AS label FROM v_series v""")
def cycle_labels(spark, sf):
    segs = _labelled(spark, sf).withColumns({"lo": micros("start_ts"), "hi": micros("end_ts")})
    return evaluation.cycle_labels(series(spark, sf).withColumn("t", micros("cycle_ts")), segs, K, "t", "lo", "hi", "kind", 86_400_000_000).select(*K, "event_id", "label")


@query(_LAB + """, d AS (SELECT *, kind IN ('degradacion_severa_sostenida', 'degradacion_moderada_sostenida') AS bad FROM l) SELECT series_id, count(*) AS segments, count(*) FILTER (bad) AS degraded_segments, round(100.0 * coalesce(sum(n) FILTER (bad), 0) / sum(n), 6) AS degraded_pct FROM d GROUP BY 1""")
def degraded_share(spark, sf):
    out = evaluation.degraded_share(_labelled(spark, sf), K, "kind", "n")
    return out.select(*K, "segments", "degraded_segments", *r6("degraded_pct"))


_FEATURES = ["median_3", "p90_3", "median_12", "above_12"]


def _scenarios(spark, sf):
    """The first half of each series, its resampled rows with steps, and the second half."""
    step = F.floor((micros("cycle_ts") - F.lit(1_704_067_200_000_000)) / F.lit(604_800_000_000))
    parts = evaluation.train_reference(evaluation.temporal_split(_long(spark, sf), K, O, 0.5, 12), K, "rtt_ms")
    real = windows.causal_features(parts.withColumns({"rtt_ms": F.col("rtt_ms") - F.col("reference"), "y": (step % 2 == 1).cast("int")}), K, O, "rtt_ms", [3, 12], 2.0)
    real = real.withColumn("at", micros("cycle_ts"))
    made = synthesis.resampled(parts.filter("part = 'train'").select(*K, *O, "rtt_ms"), K, O, "rtt_ms", "cycle_ts", 24, 1)
    made = made.withColumns({"y": (F.col("idx") % 40 < 12).cast("int"), "event_id": F.col("idx").cast("long"), "at": F.col("idx").cast("long")})
    made = made.join(made.groupBy(*K).agg(F.percentile("rtt_ms", 0.1).alias("reference")), K).withColumn("rtt_ms", F.col("rtt_ms") - F.col("reference") + F.col("y") * 8.0)
    return real, windows.causal_features(made, K, ["at", "event_id"], "rtt_ms", [3, 12], 2.0)


@query()
def utility_scenarios(spark, sf):
    real, made = _scenarios(spark, sf)
    scored = evaluation.scenarios(real, made, K, ["at", "event_id"], _FEATURES, "y", "median_3", 2.0, 5, 12)
    out = evaluation.scenario_scores(scored, K, ["at", "event_id"], "y")
    rates = ["prevalence", "majority", "accuracy", "precision", "recall", "f1", "auroc", "ap"]
    return out.select(*[c for c in out.columns if c not in rates], *r6(*rates))


@query()
def logistic_cv(spark, sf):
    rows = windows.causal_features(_long(spark, sf), K, O, "rtt_ms", [3, 12], 34.0)
    step = F.floor((micros("cycle_ts") - F.lit(1_704_067_200_000_000)) / F.lit(604_800_000_000))
    rows = rows.withColumn("y", (step % 2 == 1).cast("int")).select(*K, "cycle_ts", "event_id", "y", "median_3", "p90_3", "median_12", "above_12")
    return evaluation.blocked_cv(rows, K, O, ["median_3", "p90_3", "median_12", "above_12"], "y", 5, 12).select(*K, "event_id", "y", F.round("probability", 6).alias("probability"))


def _newton(steps: int = 25) -> str:
    """CTEs after learn (series_id, k, x, y): the fit of each (series_id, k) with one feature,
    Newton steps one by one with the 2 x 2 system solved by its determinant."""
    out = """m AS (SELECT series_id, k, avg(x) AS mu, stddev_pop(x) + 1e-9 AS sd, min(y) AS lo, max(y) AS hi, avg(y) AS share, count(*) AS learned FROM learn GROUP BY 1, 2),
  z AS MATERIALIZED (SELECT series_id, k, (x - mu) / sd AS z, y FROM learn JOIN m USING (series_id, k)), w0 AS MATERIALIZED (SELECT series_id, k, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM m)"""
    for i in range(steps):
        out += f""", w{i + 1} AS MATERIALIZED (SELECT series_id, k, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS a, b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b FROM (
    SELECT series_id, k, a, b, sum(y - p) AS g0, sum((y - p) * z) - b AS g1, sum(p * (1 - p) + 1e-6) AS h00, sum((p * (1 - p) + 1e-6) * z) AS h01, sum((p * (1 - p) + 1e-6) * z * z) + 1 AS h11
    FROM (SELECT series_id, k, a, b, y, z, 1 / (1 + exp(-greatest(-30, least(30, a + b * z)))) AS p FROM z JOIN w{i} USING (series_id, k)) GROUP BY series_id, k, a, b))"""
    return out + f", w AS (SELECT * FROM w{steps})"


_PROBABILITY = "1 / (1 + exp(-greatest(-30, least(30, w.a + w.b * (q.x - m.mu) / m.sd))))"
_WEEKS = """r AS (SELECT state AS series_id, event_id, row_number() OVER (PARTITION BY state ORDER BY cycle_ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY state) AS n,
    CAST(floor((epoch_us(cycle_ts) - 1704067200000000) / 604800000000.0::DOUBLE) AS BIGINT) % 2 = 1 AS odd, rtt_ms / 100 + CASE WHEN odd THEN 8.0 ELSE 0.0 END + 30 AS x, CASE WHEN (event_id % 5 = 0) <> odd THEN 1 ELSE 0 END AS y FROM v_series)"""


def _folds(of: str) -> str:
    """Folds (series_id, k, a, b) of the places of ``of``."""
    cut = "CASE WHEN {k} = 5 THEN n ELSE CAST(floor({k} * (n / 5.0::DOUBLE)) AS BIGINT) END"
    return f"f AS (SELECT series_id, k, {cut.format(k='k')} AS a, {cut.format(k='(k + 1)')} AS b FROM (SELECT DISTINCT series_id, n FROM {of}), (SELECT unnest(range(5)) AS k))"


def _weeks(spark, sf):
    """``_long`` with y: the odd weeks, a fifth of the rows turned around."""
    odd = F.floor((micros("cycle_ts") - F.lit(1_704_067_200_000_000)) / F.lit(604_800_000_000)) % 2 == 1
    return _long(spark, sf).withColumn("y", F.when((F.col("event_id") % 5 == 0) != odd, 1).otherwise(0))


_LEARN = "learn AS MATERIALIZED (SELECT r.series_id, k, x, y FROM r JOIN f ON r.series_id = f.series_id AND NOT (pos >= a - 12 AND pos < b + 12))"


@query(f"""WITH {_WEEKS}, {_folds('r')}, {_LEARN}, {_newton()}
  SELECT q.series_id, q.event_id, q.y, round(CASE WHEN lo IS NULL THEN 0 WHEN lo = hi THEN share ELSE {_PROBABILITY} END, 6) AS probability
  FROM r q JOIN f ON q.series_id = f.series_id AND pos >= f.a AND pos < f.b LEFT JOIN m ON m.series_id = f.series_id AND m.k = f.k LEFT JOIN w ON w.series_id = f.series_id AND w.k = f.k""")
def logistic_folds(spark, sf):
    return evaluation.blocked_cv(_weeks(spark, sf), K, O, ["rtt_ms"], "y", 5, 12).select(*K, "event_id", "y", F.round("probability", 6).alias("probability"))


_MADE = "s AS (SELECT series_id, event_id, row_number() OVER (PARTITION BY series_id ORDER BY pos) - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n, x + 1 + y AS x, y FROM r WHERE pos < floor(n * 0.5) AND event_id % 2 = 0)"
_BOTH = "(SELECT min(y) < max(y) FROM s t WHERE t.series_id = s.series_id)"


@query(f"""WITH {_WEEKS}, {_MADE}, {_folds('s')}, learn AS MATERIALIZED (SELECT s.series_id, CAST(k AS VARCHAR) AS k, x, y FROM s JOIN f ON s.series_id = f.series_id AND NOT (pos >= a - 12 AND pos < b + 12)
    UNION ALL SELECT series_id, 'TSTR', x, y FROM s UNION ALL SELECT series_id, 'TRTR', x, y FROM r WHERE pos < floor(n * 0.5)), {_newton()},
  test AS (SELECT * FROM r WHERE pos >= floor(n * 0.5) + 12), q AS (SELECT series_id, event_id, 'TSTR' AS k, x, y FROM test UNION ALL SELECT series_id, event_id, 'TRTR', x, y FROM test
    UNION ALL SELECT s.series_id, event_id, CAST(k AS VARCHAR), x, y FROM s JOIN f ON s.series_id = f.series_id AND pos >= a AND pos < b WHERE {_BOTH})
  SELECT q.series_id, q.event_id, CASE WHEN k LIKE 'T%' THEN k ELSE 'TSTS' END AS scenario, q.y, round(CASE WHEN lo = hi THEN share ELSE {_PROBABILITY} END, 6) AS probability
  FROM q JOIN m USING (series_id, k) JOIN w USING (series_id, k) WHERE k NOT LIKE 'T%' OR lo <> hi UNION ALL SELECT series_id, event_id, 'regla', y, CASE WHEN x >= 36 THEN 1.0 ELSE 0.0 END FROM test""")
def scenario_probabilities(spark, sf):
    parts = evaluation.temporal_split(_weeks(spark, sf), K, O, 0.5, 12)
    made = parts.filter("part = 'train' and event_id % 2 = 0").withColumn("rtt_ms", F.col("rtt_ms") + 1 + F.col("y"))
    out = evaluation.scenarios(parts, made, K, O, ["rtt_ms"], "y", "rtt_ms", 36.0, 5, 12)
    return out.select(*K, "event_id", "scenario", "y", F.round("probability", 6).alias("probability"))


@query()
def parameter_sweep(spark, sf):
    configs = evaluation.one_at_a_time({"sf": [20.0, 5.0, 1.0], "kappa": [1000.0, 3000.0, 6000.0], "percentile": [0.0, 98.0]})
    return evaluation.seed_stability(evaluation.sweep(_long(spark, sf), K, [c | {"k": 15, "laps": 300} for c in configs], [0, 1, 2], O, "rtt_ms", interval_s=1200.0), K)
