"""Queries over the hop view, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..operators import blocks, graph, paths, reports
from ..sources.adapters import CYCLE as C
from ..sources.adapters import HOP_KEYS as K
from ..sources.adapters import HOPS_SQL, hops
from .series_queries import KS_SQL

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {HOPS_SQL}" + (", " + sql[5:] if sql.startswith("WITH ") else " " + sql)
        return f

    return add


_CYC = """WITH kn AS (SELECT *, lag(asn) OVER (PARTITION BY series_id, cycle_ts, cycle_id ORDER BY hop) AS pa FROM v_hops WHERE asn IS NOT NULL),
  ap AS (SELECT series_id, cycle_ts, cycle_id, string_agg(asn, '>' ORDER BY hop) AS as_path FROM kn WHERE pa IS NULL OR pa <> asn GROUP BY 1, 2, 3),
  cy AS (SELECT h.series_id, h.cycle_ts, h.cycle_id, max(hop) AS length, arg_max(ip, hop) AS last_ip, arg_max(rtt_ms, hop) AS last_rtt, (array_agg(asn ORDER BY hop DESC))[1] AS last_asn FROM v_hops h GROUP BY 1, 2, 3),
  cyc AS (SELECT cy.*, coalesce(as_path, '') AS as_path FROM cy LEFT JOIN ap USING (series_id, cycle_ts, cycle_id))"""


def cycles(spark, sf):
    return paths.cycles(hops(spark, sf), K, C)


@query(_CYC + " SELECT * FROM cyc")
def cycle_signature(spark, sf):
    return cycles(spark, sf).select(*K, *C, "length", "last_ip", "last_rtt", "last_asn", F.array_join("as_path", ">").alias("as_path"))


@query(_CYC + """, f AS (SELECT series_id, as_path, count(*) AS n, min((cycle_ts, cycle_id)) AS p FROM cyc GROUP BY 1, 2) SELECT * FROM (SELECT series_id, as_path, n, CAST(row_number() OVER (PARTITION BY series_id ORDER BY n DESC, p) AS INTEGER) AS rank FROM f) WHERE rank <= 5""")
def topk_paths(spark, sf):
    rows = cycles(spark, sf).withColumn("as_path", F.array_join("as_path", ">"))
    return stats.top_k(rows, K, "as_path", F.struct(*C), 5)


_PAIRS = """WITH num AS (SELECT *, dense_rank() OVER (PARTITION BY series_id ORDER BY cycle_ts, cycle_id) AS i FROM v_hops),
  pr AS (SELECT a.*, b.ip AS prev_ip, b.asn AS prev_asn, b.rtt_ms AS prev_rtt FROM num a JOIN num b ON b.series_id = a.series_id AND b.hop = a.hop AND b.i = a.i - 1),
  rt AS (SELECT *, abs(rtt_ms - prev_rtt) AS diff_ms, CASE WHEN prev_rtt > 0 THEN abs(rtt_ms - prev_rtt) * 100 / prev_rtt ELSE 0 END AS pct FROM pr),
  re AS (SELECT *, 'rtt_' || CASE WHEN pct > 200 THEN 'dark' WHEN pct > 40 THEN 'medium' ELSE 'light' END AS categoria FROM rt WHERE diff_ms > 10 AND pct > 20 AND NOT (ip <> prev_ip AND 'Unknown' NOT IN (ip, prev_ip) AND asn IS NOT DISTINCT FROM prev_asn)),
  ie AS (SELECT *, 'cambio_ip_asn' AS categoria FROM pr WHERE ip <> prev_ip AND 'Unknown' NOT IN (ip, prev_ip) AND asn IS DISTINCT FROM prev_asn),
  ln AS (SELECT series_id, cycle_ts, cycle_id, max(hop) AS length FROM v_hops GROUP BY 1, 2, 3), lp AS (SELECT *, lag(length) OVER (PARTITION BY series_id ORDER BY cycle_ts, cycle_id) AS prev_length FROM ln),
  le AS (SELECT *, 'cambio_longitud' AS categoria FROM lp WHERE prev_length <> length)"""


def pairs(spark, sf):
    return paths.with_previous(hops(spark, sf), None, K, C)


@query(_PAIRS + " SELECT series_id, cycle_ts, cycle_id, hop, round(diff_ms, 6) AS diff_ms, round(pct, 6) AS pct, categoria FROM re")
def consecutive_rtt_events(spark, sf):
    return paths.rtt_events(pairs(spark, sf)).select(*K, *C, "hop", F.round("diff_ms", 6).alias("diff_ms"), F.round("pct", 6).alias("pct"), "categoria")


@query(_PAIRS + " SELECT series_id, cycle_ts, cycle_id, hop, prev_ip, ip, categoria FROM ie")
def ip_asn_events(spark, sf):
    return paths.ip_asn_events(pairs(spark, sf)).select(*K, *C, "hop", "prev_ip", "ip", "categoria")


#: A third of the addresses unknown.
_UNKNOWN = "WITH v_unknown AS (SELECT series_id, cycle_ts, cycle_id, hop, CASE WHEN CAST(right(ip, 1) AS INTEGER) < 3 THEN 'Unknown' ELSE ip END AS ip, asn, rtt_ms FROM v_hops), "


def pairs_with_unknown(spark, sf):
    h = hops(spark, sf).withColumn("ip", F.when(F.substring("ip", -1, 1).cast("int") < 3, "Unknown").otherwise(F.col("ip")))
    return paths.with_previous(h, None, K, C)


@query(_UNKNOWN + _PAIRS[5:].replace("v_hops", "v_unknown") + " SELECT series_id, cycle_ts, cycle_id, hop, prev_ip, ip, categoria FROM ie UNION ALL SELECT series_id, cycle_ts, cycle_id, hop, prev_ip, ip, categoria FROM re")
def events_beside_unknown_addresses(spark, sf):
    return paths.hop_events(pairs_with_unknown(spark, sf)).select(*K, *C, "hop", "prev_ip", "ip", "categoria")


@query("""WITH d AS (SELECT series_id, cycle_ts, cycle_id, arg_min(ip, hop) AS dst, (array_agg(asn ORDER BY hop))[1] AS dst_asn FROM v_hops GROUP BY 1, 2, 3),
  m AS (SELECT *, lag(dst) OVER o AS prev_dst, lag(dst_asn) OVER o AS prev_asn FROM d WINDOW o AS (PARTITION BY series_id ORDER BY cycle_ts, cycle_id))
  SELECT series_id, cycle_ts, cycle_id, dst, 'cambio_destino' AS categoria FROM m WHERE dst <> prev_dst AND (dst_asn <> prev_asn OR (dst_asn IS NULL) <> (prev_asn IS NULL))""")
def destination_events(spark, sf):
    first = hops(spark, sf).groupBy(*K, *C).agg(F.min_by("ip", "hop").alias("dst"), F.min_by(F.struct("asn"), "hop")["asn"].alias("dst_asn"))
    return paths.destination_events(first, K, C, "dst", "dst_asn").select(*K, *C, "dst", "categoria")


@query(_PAIRS + " SELECT * FROM le")
def length_events(spark, sf):
    return paths.length_events(cycles(spark, sf), K, C).select(*K, *C, "length", "prev_length", "categoria")


_EVENTS = _PAIRS + """, ev AS (SELECT series_id, cycle_ts, cycle_id, categoria, 0 AS h, 0 AS k FROM le UNION ALL SELECT series_id, cycle_ts, cycle_id, categoria, hop, 1 FROM re UNION ALL SELECT series_id, cycle_ts, cycle_id, categoria, hop, 2 FROM ie)"""


def events(spark, sf):
    h = hops(spark, sf)
    return paths.events(h, paths.cycles(h, K, C), K, C, every=True)


@query(_EVENTS + " SELECT series_id, cycle_ts, cycle_id, categoria, CAST(row_number() OVER (PARTITION BY series_id, cycle_ts, cycle_id ORDER BY h, k) AS INTEGER) AS ordinal FROM ev")
def event_log(spark, sf):
    return events(spark, sf)


@query(_EVENTS + " SELECT series_id, categoria, count(*) AS n FROM ev GROUP BY 1, 2")
def events_by_category(spark, sf):
    return events(spark, sf).groupBy(*K, "categoria").agg(F.count(F.lit(1)).alias("n"))


_REACH = _CYC + """, ps AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY cycle_ts, cycle_id) AS pos, count(*) OVER (PARTITION BY series_id) AS tot FROM cyc),
  ma AS (SELECT series_id, last_asn AS modal_asn FROM (SELECT series_id, last_asn, count(*) AS n, min(pos) AS p FROM ps WHERE last_asn IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY n DESC, p) = 1),
  ia AS (SELECT series_id, last_ip, last_asn AS ip_asn FROM (SELECT series_id, last_ip, last_asn, count(*) AS n, min(pos) AS p FROM ps WHERE last_asn IS NOT NULL GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY series_id, last_ip ORDER BY n DESC, p) = 1),
  fr AS (SELECT i.series_id, i.last_ip FROM (SELECT series_id, last_ip, count(*) AS n, max(tot) AS tot FROM ps GROUP BY 1, 2) i LEFT JOIN ia USING (series_id, last_ip) LEFT JOIN ma USING (series_id) WHERE n >= greatest(1.0, 0.02 * tot) AND (ip_asn IS NULL OR modal_asn IS NULL OR ip_asn = modal_asn)),
  hi AS (SELECT ps.*, coalesce(last_asn = modal_asn, false) OR fr.last_ip IS NOT NULL AS hit FROM ps LEFT JOIN ma USING (series_id) LEFT JOIN fr USING (series_id, last_ip)),
  rc AS (SELECT *, hit OR NOT bool_or(hit) OVER (PARTITION BY series_id) AS reached FROM hi)"""


def reached(spark, sf):
    return paths.reachability(cycles(spark, sf), K, C)


@query(_REACH + " SELECT series_id, cycle_ts, cycle_id, reached FROM rc")
def reachability(spark, sf):
    return reached(spark, sf).select(*K, *C, "reached")


@query(_REACH + """, w AS (SELECT *, lag(length) OVER o AS pl, lag(as_path) OVER o AS pp FROM rc WHERE reached WINDOW o AS (PARTITION BY series_id ORDER BY cycle_ts, cycle_id))
  SELECT series_id, cycle_ts, cycle_id, CASE WHEN length <> pl AND as_path <> pp THEN 'ambas' WHEN as_path <> pp THEN 'solo_aspath' ELSE 'solo_longitud' END AS clase FROM w WHERE pl IS NOT NULL AND (length <> pl OR as_path <> pp)""")
def path_transitions(spark, sf):
    return paths.transitions(reached(spark, sf).filter("reached"), K, C).select(*K, *C, "clase")


_EXC = _REACH + """, ri AS (SELECT *, CASE WHEN length = lag(length) OVER o THEN 0 ELSE 1 END AS st FROM rc WHERE reached WINDOW o AS (PARTITION BY series_id ORDER BY cycle_ts, cycle_id)),
  rr AS (SELECT *, CAST(sum(st) OVER (PARTITION BY series_id ORDER BY cycle_ts, cycle_id) AS BIGINT) AS tn FROM ri), rz AS (SELECT *, count(*) OVER (PARTITION BY series_id, tn) AS sz FROM rr),
  al AS (SELECT rc.series_id, rc.cycle_ts, rc.cycle_id, rc.length, rc.reached, CASE WHEN rc.reached THEN {'n': tn, 'l': rz.length, 's': sz >= 2} END AS run, sz FROM rc LEFT JOIN rz USING (series_id, cycle_ts, cycle_id)),
  nr AS (SELECT *, last_value(run IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY cycle_ts, cycle_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pv, first_value(run IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY cycle_ts, cycle_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM al),
  ex AS (SELECT series_id, cycle_ts, cycle_id, length, 'sin_destino' AS motivo, coalesce(pv, nx).n AS tramo_n, coalesce(pv, nx).l AS tramo_longitud, coalesce(pv, nx).s AS tramo_sostenido, length = coalesce(pv, nx).l AS misma_longitud_que_tramo,
      coalesce(pv.n <> nx.n, false) AS entre_tramos, CASE WHEN pv.n <> nx.n THEN nx.n END AS tramo_siguiente_n FROM nr WHERE NOT reached
    UNION ALL SELECT series_id, cycle_ts, cycle_id, length, CASE WHEN sz = 1 THEN 'parpadeo' ELSE 'transitorio' END, run.n, run.l, false, true, false, NULL FROM nr WHERE reached AND sz < 2)"""


@query(_EXC + " SELECT * FROM ex")
def excluded_cycles(spark, sf):
    return paths.excluded_cycles(reached(spark, sf), K, C, 2)


@query(_EXC + " SELECT series_id, motivo, count(*) AS n FROM ex GROUP BY 1, 2")
def excluded_by_reason(spark, sf):
    return paths.excluded_cycles(reached(spark, sf), K, C, 2).groupBy(*K, "motivo").agg(F.count(F.lit(1)).alias("n"))


#: Cycles of two lengths and two paths, so that routes last: several paths of one length.
_ROUTED = _REACH + """, q AS (SELECT series_id, cycle_ts, cycle_id, reached, last_ip, last_asn, last_rtt, CASE WHEN length <= 5 THEN 5 ELSE 7 END AS length, CASE WHEN coalesce(last_asn, '') < '2' THEN 'A' ELSE 'B' END AS path FROM rc),
  tq AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY cycle_ts, cycle_id) - 1 AS pos FROM q WHERE reached),
  rs AS (SELECT *, CASE WHEN length = lag(length) OVER s AND path = lag(path) OVER s THEN 0 ELSE 1 END AS st FROM tq WINDOW s AS (PARTITION BY series_id ORDER BY pos)), rn AS (SELECT *, sum(st) OVER (PARTITION BY series_id ORDER BY pos) AS rn FROM rs),
  kr AS (SELECT series_id, rn, length, path, min(pos) AS i0, max(pos) AS i1, min(cycle_ts) AS s, max(cycle_ts) AS e FROM rn GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2),
  ks AS (SELECT *, CASE WHEN length = lag(length) OVER o AND path = lag(path) OVER o THEN 0 ELSE 1 END AS st FROM kr WINDOW o AS (PARTITION BY series_id ORDER BY i0)), kb AS (SELECT *, CAST(sum(st) OVER (PARTITION BY series_id ORDER BY i0) AS BIGINT) AS block_id FROM ks),
  bl AS (SELECT series_id, block_id, length, path, min(i0) AS i0, max(i1) AS i1, min(s) AS s, max(e) AS e, count(*) AS merged FROM kb GROUP BY 1, 2, 3, 4), mb AS (SELECT tq.*, bl.block_id, tq.length = bl.length AND tq.path = bl.path AS own FROM tq JOIN bl ON bl.series_id = tq.series_id AND pos BETWEEN i0 AND i1),
  bt AS (SELECT bl.*, i1 - i0 + 1 AS n, fuera, lons FROM bl JOIN (SELECT series_id, block_id, CAST(sum(CASE WHEN own THEN 0 ELSE 1 END) AS BIGINT) AS fuera, string_agg(DISTINCT CASE WHEN own THEN length END, '|' ORDER BY CASE WHEN own THEN length END) AS lons FROM mb GROUP BY 1, 2) USING (series_id, block_id)),
  gp AS (SELECT series_id, epoch_us(cycle_ts) - epoch_us(lag(cycle_ts) OVER (PARTITION BY series_id ORDER BY cycle_ts, cycle_id)) AS dt FROM q), ca AS (SELECT series_id, list_sort(list(dt))[len(list(dt)) // 2 + 1] / 1e6 AS cad FROM gp WHERE dt IS NOT NULL GROUP BY 1),
  mo AS (SELECT series_id, length AS modal FROM (SELECT series_id, length, count(*) AS n, min(pos) AS p FROM tq GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY n DESC, p) = 1)"""


def routed(spark, sf):
    path = F.array(F.when(F.coalesce("last_asn", F.lit("")) < "2", "A").otherwise("B"))
    return reached(spark, sf).withColumns({"length": F.when(F.col("length") <= 5, 5).otherwise(7), "as_path": path})


@query(_ROUTED + """ SELECT series_id, block_id AS bloque_id, bt.length AS longitud, s AS inicio, e AS fin, round(n * coalesce(cad, 0) / 3600, 6) AS duracion_h, n AS ciclos, fuera, merged AS tramos_sostenidos, bt.length = modal AS longitud_modal, path AS ruta, lons AS longitudes
  FROM bt JOIN mo USING (series_id) LEFT JOIN ca USING (series_id)""")
def block_report(spark, sf):
    out = reports.block_report(routed(spark, sf), K, C, 2)
    return out.withColumns({"duracion_h": F.round("duracion_h", 6), "ruta": F.array_join("ruta", ">"), "longitudes": F.array_join(F.col("longitudes").cast("array<string>"), "|")})


@query(_ROUTED + """, dn AS (SELECT bt.*, cad, n - fuera AS own, round((epoch_us(e) - epoch_us(s)) / 3.6e9, 1) AS dur, (n - fuera) / CASE WHEN cad > 0 THEN (epoch_us(e) - epoch_us(s)) / 1e6 / cad + 1 ELSE n END AS cob FROM bt JOIN ca USING (series_id)),
  el AS (SELECT *, own >= 3 AND cob >= 0.2 AS ok FROM dn), po AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY dur DESC, block_id) AS rk FROM (SELECT *, bool_or(ok) OVER (PARTITION BY series_id) AS has_ok FROM el) WHERE ok OR NOT has_ok)
  SELECT a.series_id, a.cad AS cadencia_s, a.block_id AS bloque_id, a.length AS longitud, a.path AS ruta, a.dur AS duracion_h, a.n AS ciclos, a.own AS ciclos_propios, round(a.cob, 3) AS cobertura, a.ok AS elegible, b.block_id AS segundo_id,
    round(CASE WHEN b.block_id IS NOT NULL THEN CASE WHEN a.dur > 0 THEN b.dur / a.dur ELSE 0 END END, 6) AS segundo_sobre_elegido, coalesce(CASE WHEN a.dur > 0 THEN b.dur / a.dur ELSE 0 END >= 0.8, false) AND b.block_id IS NOT NULL AS eleccion_ajustada
  FROM po a LEFT JOIN po b ON b.series_id = a.series_id AND b.rk = 2 WHERE a.rk = 1""")
def main_block_report(spark, sf):
    out = reports.main_block_report(routed(spark, sf), K, C, 2, 3, 0.2)
    e = [F.col(f"elegido.{c}").alias(c) for c in ("bloque_id", "longitud", "ruta", "duracion_h", "ciclos", "ciclos_propios", "cobertura", "elegible")]
    return out.select(*K, "cadencia_s", *e, F.col("segundo.bloque_id").alias("segundo_id"), F.round("duracion_segundo_sobre_elegido", 6).alias("segundo_sobre_elegido"), "eleccion_ajustada")


@query(_ROUTED + _EXC[len(_REACH):].replace("rc.", "q.").replace("FROM rc", "FROM q") + """,
  bp AS (SELECT q.series_id, q.cycle_ts, q.cycle_id, q.reached, q.last_ip, tq.pos, mb.block_id FROM q LEFT JOIN tq USING (series_id, cycle_ts, cycle_id) LEFT JOIN mb USING (series_id, cycle_ts, cycle_id)),
  bn AS (SELECT *, last_value(CASE WHEN reached THEN {'b': block_id} END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY cycle_ts, cycle_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pv, first_value(CASE WHEN reached THEN {'b': block_id} END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY cycle_ts, cycle_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM bp)
  SELECT ex.series_id, ex.cycle_ts, ex.length AS salto, bn.last_ip AS ultimo_salto_ip, ex.motivo, ex.tramo_n, ex.entre_tramos, ex.tramo_siguiente_n,
    CASE WHEN bn.reached THEN bn.block_id WHEN pv IS NULL THEN nx.b WHEN nx IS NULL THEN pv.b WHEN pv.b IS NOT DISTINCT FROM nx.b THEN pv.b END AS bloque_id FROM ex JOIN bn USING (series_id, cycle_ts, cycle_id)""")
def excluded_report(spark, sf):
    out = reports.excluded_report(routed(spark, sf), K, C, 2)
    return out.select(*K, F.col("ciclo").alias("cycle_ts"), "salto", "ultimo_salto_ip", "motivo", "tramo_n", "entre_tramos", "tramo_siguiente_n", "bloque_id")


_CROSS = _REACH + ", " + _EVENTS[5:] + """, mk AS (SELECT series_id, cycle_ts, cycle_id, length, as_path, reached, NOT reached OR coalesce(NOT lag(reached) OVER (PARTITION BY series_id ORDER BY cycle_ts, cycle_id), false) AS bad FROM rc),
  tw AS (SELECT series_id, cycle_ts, cycle_id, length <> lag(length) OVER o AS cl, as_path <> lag(as_path) OVER o AS cp FROM rc WHERE reached WINDOW o AS (PARTITION BY series_id ORDER BY cycle_ts, cycle_id)),
  fl AS (SELECT series_id, cycle_ts, cycle_id, bool_or(categoria = 'cambio_longitud') AS el, bool_or(categoria = 'cambio_ip_asn') AS ei FROM ev GROUP BY 1, 2, 3),
  jn AS (SELECT mk.series_id, coalesce(cl, false) AS cl, coalesce(cp, false) AS cp, coalesce(el, false) AS el, coalesce(ei, false) AS ei FROM mk LEFT JOIN tw USING (series_id, cycle_ts, cycle_id) LEFT JOIN fl USING (series_id, cycle_ts, cycle_id) WHERE NOT bad)"""


@query(_CROSS + """, bd AS (SELECT series_id, cycle_ts, cycle_id FROM mk WHERE bad), hs AS (SELECT series_id, cycle_ts, cycle_id FROM mk EXCEPT FROM bd),
  ea AS (SELECT series_id, cycle_ts, cycle_id FROM ev WHERE categoria = 'cambio_ip_asn' EXCEPT FROM bd), el AS (SELECT series_id, cycle_ts, cycle_id FROM ev WHERE categoria = 'cambio_longitud' EXCEPT FROM bd),
  cp AS (SELECT series_id, cycle_ts, cycle_id FROM tw WHERE cp EXCEPT FROM bd), cl AS (SELECT series_id, cycle_ts, cycle_id FROM tw WHERE cl EXCEPT FROM bd), ch AS (FROM cp UNION FROM cl),
  al AS (SELECT 'cycles' AS k, * FROM hs UNION ALL SELECT 'ip_events', * FROM ea UNION ALL SELECT 'ip_with_path', * FROM (FROM ea INTERSECT FROM cp) UNION ALL SELECT 'ip_length_only', * FROM ((FROM ea INTERSECT FROM cl) EXCEPT FROM cp)
    UNION ALL SELECT 'ip_unreal', * FROM ((FROM ea INTERSECT FROM hs) EXCEPT FROM ch) UNION ALL SELECT 'ip_outside', * FROM (FROM ea EXCEPT FROM hs) UNION ALL SELECT 'length_unreal', * FROM ((FROM el INTERSECT FROM hs) EXCEPT FROM ch)
    UNION ALL SELECT 'length_unseen', * FROM (FROM cl EXCEPT FROM el) UNION ALL SELECT 'path_unseen', * FROM (FROM cp EXCEPT FROM ea))
  SELECT series_id, """ + ", ".join(f"count(*) FILTER (k = '{k}') AS {k}" for k in ("cycles", "ip_events", "ip_with_path", "ip_length_only", "ip_unreal", "ip_outside", "length_unreal", "length_unseen", "path_unseen")) + " FROM al GROUP BY 1")
def events_cross_check(spark, sf):
    return paths.cross_check(events(spark, sf), reached(spark, sf), K, C)


@query(_CROSS + """, od AS (SELECT DISTINCT series_id, cycle_ts, cycle_id FROM ev WHERE categoria = 'cambio_ip_asn' EXCEPT SELECT series_id, cycle_ts, cycle_id FROM tw WHERE cp)
  SELECT pr.series_id, CASE WHEN (asn IS NULL) <> (prev_asn IS NULL) THEN 'valido_sin_asn' ELSE 'frontera' END AS detalle, count(*) AS n FROM pr JOIN od USING (series_id, cycle_ts, cycle_id) WHERE asn IS DISTINCT FROM prev_asn GROUP BY 1, 2""")
def unexplained_events(spark, sf):
    d = paths.unexplained_detail(events(spark, sf), pairs(spark, sf), reached(spark, sf), K, C)
    return d.groupBy(*K, "detalle").agg(F.count(F.lit(1)).alias("n"))


@query(_CYC + """, cn AS (SELECT series_id, length, count(*) AS n, min((cycle_ts, cycle_id)) AS p0, quantile_cont(last_rtt, 0.5) AS median FROM cyc GROUP BY 1, 2), cr AS (SELECT *, sum(n) OVER (PARTITION BY series_id) AS tot, row_number() OVER (PARTITION BY series_id ORDER BY n DESC, p0) AS rk FROM cn),
  e AS (SELECT * FROM cr WHERE rk = 1 OR n >= greatest(10, ceil(0.005 * tot))), top AS (SELECT series_id, length AS ref, median AS refm FROM e WHERE rk = 1),
  both_ AS (SELECT {'s': c.series_id, 'l': c.length} AS g, c.last_rtt AS x, true AS first FROM cyc c JOIN e ON e.series_id = c.series_id AND e.length = c.length AND rk > 1 UNION ALL SELECT {'s': e.series_id, 'l': e.length}, c.last_rtt, false FROM e JOIN top ON top.series_id = e.series_id JOIN cyc c ON c.series_id = e.series_id AND c.length = top.ref WHERE e.rk > 1), """ + KS_SQL + """
  SELECT e.series_id, e.length, n, round(median, 6) AS median, round(CASE WHEN rk > 1 THEN median - refm END, 6) AS delta_ms, round(d, 8) AS d, round(p, 8) AS p, CASE WHEN rk = 1 THEN 'referencia' WHEN p < 0.01 AND abs(median - refm) >= 2.0 THEN 'distinto' ELSE 'equivalente' END AS verdict
  FROM e JOIN top ON top.series_id = e.series_id LEFT JOIN kp ON kp.g = {'s': e.series_id, 'l': e.length}""")
def length_compare(spark, sf):
    rows = cycles(spark, sf).withColumn("pos", F.struct(*C))
    out = blocks.compare_samples(rows, K, "length", "last_rtt", "pos", min_share=0.005, diff_ms=2.0, diff_rel=0.0)
    return out.select(*K, "length", "n", F.round("median", 6).alias("median"), F.round("delta_ms", 6).alias("delta_ms"), F.round("d", 8).alias("d"), F.round("p", 8).alias("p"), "verdict")


@query()
def length_classes(spark, sf):
    rows = cycles(spark, sf).withColumn("pos", F.struct(*C))
    return blocks.length_classes(rows.withColumn("as_path", F.array_join("as_path", ">")), K, "length", "last_rtt", "as_path", "pos")


@query(_CYC + """, ps AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY cycle_ts, cycle_id) AS pos FROM cyc), ml AS (SELECT series_id, length, n FROM (SELECT series_id, length, count(*) AS n, min(pos) AS p FROM ps GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY n DESC, p) = 1),
  mx AS (SELECT series_id, max(length) AS max_length, count(*) AS n FROM cyc GROUP BY 1) SELECT mx.series_id, max_length, ml.length AS modal_length, max_length >= 7 OR (ml.length = max_length AND max_length >= 10 AND ml.n > mx.n * 0.5) AS warning FROM mx JOIN ml USING (series_id)""")
def truncation_warning(spark, sf):
    return paths.truncation_warning(cycles(spark, sf), K, C, 7)


@query(_CYC + """, ps AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY cycle_ts, cycle_id) AS pos FROM cyc), mi AS (SELECT series_id, last_ip AS modal_ip FROM (SELECT series_id, last_ip, count(*) AS n, min(pos) AS p FROM ps GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY n DESC, p) = 1),
  ma AS (SELECT series_id, last_asn AS modal_asn FROM (SELECT series_id, last_asn, count(*) AS n, min(pos) AS p FROM ps WHERE last_asn IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY n DESC, p) = 1)
  SELECT series_id, count(*) AS cycles, CAST(sum(CASE WHEN last_ip = 'ip_1' OR last_ip = modal_ip OR coalesce(last_asn = modal_asn, false) THEN 1 ELSE 0 END) AS BIGINT) AS arrived FROM ps JOIN mi USING (series_id) LEFT JOIN ma USING (series_id) GROUP BY 1""")
def destination_summary(spark, sf):
    cyc = cycles(spark, sf)
    targets = cyc.select(*K).distinct().withColumn("ip", F.lit("ip_1"))
    return paths.destination_summary(cyc, K, C, targets)


@query(_CYC + """, ps AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY cycle_ts, cycle_id) AS pos FROM cyc) SELECT series_id, last_ip, count(*) AS n, round(quantile_cont(last_rtt, 0.25), 6) AS p25, round(quantile_cont(last_rtt, 0.5), 6) AS p50, round(quantile_cont(last_rtt, 0.75), 6) AS p75, round(quantile_cont(last_rtt, 0.95), 6) AS p95, min(last_rtt) AS min, max(last_rtt) AS max FROM ps GROUP BY 1, 2""")
def final_ip_summary(spark, sf):
    out = blocks.rtt_summary(cycles(spark, sf), [*K, "last_ip"], "last_rtt")
    return out.select(*K, "last_ip", "n", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p25", "p50", "p75", "p95"))], "min", "max")


_FILL = """WITH fi AS (SELECT *, last_value(asn IGNORE NULLS) OVER (PARTITION BY series_id, cycle_ts, cycle_id ORDER BY hop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, first_value(asn IGNORE NULLS) OVER (PARTITION BY series_id, cycle_ts, cycle_id ORDER BY hop ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM v_hops),
  fa AS (SELECT *, coalesce(asn, CASE WHEN b = a THEN b END) AS asn_filled FROM fi)"""


@query(_FILL + " SELECT series_id, cycle_ts, cycle_id, hop, asn_filled FROM fa")
def asn_hole_fill(spark, sf):
    return graph.fill_asn(hops(spark, sf), K, C).select(*K, *C, "hop", "asn_filled")


_VIEW = _FILL + """, fs AS (SELECT *, CASE WHEN asn_filled IS NOT DISTINCT FROM lag(asn_filled) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS st FROM fa WINDOW w AS (PARTITION BY series_id, cycle_ts, cycle_id ORDER BY hop)),
  fg AS (SELECT *, CAST(sum(st) OVER (PARTITION BY series_id, cycle_ts, cycle_id ORDER BY hop) AS BIGINT) AS layer FROM fs), nv AS (SELECT series_id, cycle_ts, cycle_id, coalesce('AS' || asn_filled, '?') AS node, layer, quantile_cont(rtt_ms, 0.5) AS rtt_ms, count(*) AS hops FROM fg GROUP BY 1, 2, 3, asn_filled, layer)"""


@query(_VIEW + """, l AS (SELECT *, layer = max(layer) OVER (PARTITION BY series_id, cycle_ts, cycle_id) AS la FROM nv), m AS (SELECT series_id, node, layer FROM (SELECT series_id, node, layer, count(*) AS n FROM nv GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY series_id, node ORDER BY n DESC, layer) = 1)
  SELECT l.series_id, l.node, count(*) AS n, round(quantile_cont(rtt_ms, 0.5), 6) AS median_rtt, CAST(sum(CASE WHEN la THEN 1 ELSE 0 END) AS BIGINT) AS n_last, max(m.layer) AS modal_layer FROM l JOIN m ON m.series_id = l.series_id AND m.node = l.node GROUP BY 1, 2""")
def graph_nodes(spark, sf):
    return graph.nodes(graph.asn_view(hops(spark, sf), K, C), K, C).withColumn("median_rtt", F.round("median_rtt", 6))


@query(_VIEW + """ SELECT series_id, node AS source, target, count(*) AS n FROM (SELECT *, lead(node) OVER (PARTITION BY series_id, cycle_ts, cycle_id ORDER BY layer) AS target FROM nv) WHERE target IS NOT NULL GROUP BY 1, 2, 3""")
def graph_edges(spark, sf):
    return graph.edges(graph.asn_view(hops(spark, sf), K, C), K, C)


@query("""SELECT series_id, ip AS source, target, count(*) AS n FROM (SELECT *, lead(ip) OVER (PARTITION BY series_id, cycle_ts, cycle_id ORDER BY hop) AS target FROM v_hops) WHERE target IS NOT NULL GROUP BY 1, 2, 3""")
def graph_edges_by_ip(spark, sf):
    return graph.edges(graph.ip_view(hops(spark, sf), K, C), K, C)


@query("""WITH num AS (SELECT *, dense_rank() OVER (PARTITION BY series_id ORDER BY cycle_ts, cycle_id) AS i FROM v_hops)
  SELECT a.series_id, a.cycle_ts, a.cycle_id, a.hop, b.ip IS NULL AS new_hop, coalesce(a.ip <> b.ip, false) AS ip_changed, round(a.rtt_ms - b.rtt_ms, 6) AS delta_ms FROM num a LEFT JOIN num b ON b.series_id = a.series_id AND b.hop = a.hop AND b.i = a.i - 1 WHERE a.i > 1""")
def hop_changes(spark, sf):
    h = hops(spark, sf)
    return paths.hop_changes(h, paths.cycles(h, K, C), K, C).withColumn("delta_ms", F.round("delta_ms", 6))


@query(_REACH + """, hy AS (SELECT series_id, cycle_ts, cycle_id, bool_or(ip LIKE '%ip_1%' OR 'as' || coalesce(asn, '') LIKE '%ip_1%') AS inc, bool_or(coalesce('as' || asn, '') LIKE '%as9%') AS exc FROM v_hops GROUP BY 1, 2, 3)
  SELECT rc.series_id, rc.cycle_ts, rc.cycle_id FROM rc JOIN hy USING (series_id, cycle_ts, cycle_id) WHERE inc AND NOT exc AND (NOT reached OR (last_rtt >= 5 AND last_rtt <= 45))""")
def cycle_search(spark, sf):
    return paths.search_cycles(reached(spark, sf), ["ip_1"], ["as9"], "all", 5.0, 45.0).select(*K, *C)


@query("SELECT series_id, cycle_ts, cycle_id, max(hop) AS length, hop AS h FROM v_hops GROUP BY 1, 2, 3, hop")
def flattened_measurements(spark, sf):
    packets = F.array(F.struct(F.lit(None).cast("double").alias("rtt"), F.lit("x").alias("from")), F.struct(F.col("rtt_ms").alias("rtt"), F.col("ip").alias("from")))
    raw = hops(spark, sf).groupBy(*K, *C, F.col("hop").alias("h")).agg(F.collect_list(F.struct("hop", packets.alias("result"))).alias("result"))
    raw = raw.withColumns({"timestamp": F.unix_micros(F.col("cycle_ts").cast("timestamp")), "dst_addr": F.lit("d")})
    flat = paths.flatten_measurements(raw, [*K, *C, "h"], 15).filter("hop = h and ip is not null")
    return flat.select(*K, *C, F.col("length"), "h")


@query("""SELECT series_id, CAST(cycle_ts AS DATE) AS day, count(DISTINCT cycle_id) AS cycles, count(DISTINCT ip) AS ips, count(*) AS hops FROM v_hops GROUP BY 1, 2""")
def hops_by_day(spark, sf):
    return hops(spark, sf).groupBy(*K, F.col("cycle_ts").cast("date").alias("day")).agg(F.count_distinct("cycle_id").alias("cycles"), F.count_distinct("ip").alias("ips"), F.count(F.lit(1)).alias("hops"))

