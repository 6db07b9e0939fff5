"""The result files (K1-K8, K10-K20, K23): their columns, and a writer that holds tables to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sinks import TIME

#: The columns of each file in order; ``name:n`` is written with n decimals.
COLUMNS = {
    "historial_traceroute": "timestamp hop ip asn rtt_ms",
    "eventos": "timestamp categoria",
    "tramos_longitud": "inicio longitud ciclos sostenido",
    "bloques_longitud": "bloque_id longitud inicio fin duracion_h:1 ciclos fuera tramos_sostenidos longitud_modal ruta longitudes",
    "ciclos_excluidos": "ciclo salto ultimo_salto_ip asn rtt_ms:3 privada motivo tramo_n tramo_inicio tramo_longitud tramo_sostenido misma_longitud_que_tramo entre_tramos tramo_siguiente_n bloque_id",
    "destinos_ip_final": "ip_final asn ciclos porcentaje:2 rtt_mediana:3 rtt_p25:3 rtt_p75:3 rtt_p95:3 rtt_min:3 rtt_max:3 vs_mas_frecuente_dif_mediana_ms:3 ks_D:4 ks_p:4 veredicto",
    "diagnostico_longitudes": "longitud ciclos porcentaje:2 rtt_mediana:3 rtt_p25:3 rtt_p75:3 rtt_p95:3 rtt_min:3 rtt_max:3 as_path_modal vs_mas_frecuente_dif_mediana_ms:3 umbral_ms:3 ks_D:4 ks_p:4 veredicto clase_fusion fusionada",
    "estados_hdphmm": "timestamp rtt_ms:3 seq_id state_raw state",
    "segmentos_caracterizados": "seq_id estado start_ts end_ts n_ciclos duracion_minutos media:3 mediana:3 std:3 min:3 max:3 tipo_degradacion bloque_id longitud rtt_referencia:3 desviacion_ms:3 clave_referencia",
    "segmentos_caracterizados_agrupados": "grupo_id start_ts end_ts n_ciclos duracion_minutos media:3 mediana:3 std:3 min:3 max:3 tipo_degradacion n_segmentos_originales",
    "cambios_de_ruta": "timestamp bloque_anterior bloque_siguiente longitud_anterior longitud_siguiente delta_saltos rtt_antes_ms:3 rtt_despues_ms:3 delta_rtt_ms:3 tipo_cambio ciclos_ventana ruta_anterior ruta_siguiente",
    "change_points": "timestamp estado_anterior estado_nuevo",
    "percentiles_moviles": "timestamp n p10:3 p25:3 p50:3 p75:3 p90:3 iqr:3",
    "elevaciones_piso": "umbral_ms inicio fin duracion_h:1 elevacion_max_ms:2",
    "perfil_horario": "hora n p10:3 p25:3 p50:3 p75:3 p90:3 media:3 tasa_picos:4",
    "perfil_diario": "dia n p10:3 p25:3 p50:3 p75:3 p90:3",
    "verdad_ciclos": "idx timestamp hueco regimen delta_ms salto_localizacion nivel_ultimo_ms spike_ms sin_destino modo_fallo n_saltos_emitidos rtt_ultimo_ms",
    "verdad_episodios": "tipo inicio fin n_ciclos magnitud_ms detalle",
    "costuras": "idx timestamp salto_nivel_ms",
    "realismo": "metrica pool_real:4 sintetico:4 estado",
    "evaluacion_puntos_de_cambio": "resultado timestamp_verdad timestamp_detectado desfase_ciclos:1 delta_verdad_ms categoria",
    "evaluacion_segmentos": "start_ts end_ts n_ciclos duracion_min:0 longitud delta_verdad_ms mediana_rtt_ms desviacion_script_ms error_desviacion_ms tipo_esperado tipo_script coincide pureza:2 estado",
    "barrido_estabilidad": "sF hmm_kappa percentil_outliers corridas_ok estados puntos_de_cambio cps_por_dia pct_degradacion acuerdo_f1",
    "tstr_holdout_resumen": "escenario detalle prevalencia:4 accuracy:4 precision:4 recall:4 f1:4 auroc:4 ap:4 ep_verdad ep_detectados ep_recall:4 ep_falsas_alarmas ep_fa_por_dia:4",
    "predicciones_prueba": "timestamp rtt_ms:3 etiqueta_plateada p_tstr:4 p_trtr:4 regla:4",
    "caminos": "timestamp saltos destino_alcanzado rtt_destino_ms as_path ips",
}

_SEGMENT = {"n_ciclos": "n", "duracion_minutos": "minutes", "media": "mean", "mediana": "median", "tipo_degradacion": "kind"}
#: The operators' names of columns, where they differ.
NAMES = {
    "segmentos_caracterizados": {**_SEGMENT, "estado": "state", "bloque_id": "block_id", "longitud": "length", "rtt_referencia": "reference", "desviacion_ms": "deviation", "clave_referencia": "reference_key"},
    "segmentos_caracterizados_agrupados": {**_SEGMENT, "grupo_id": "group_id", "n_segmentos_originales": "n_segments"},
    "cambios_de_ruta": {"timestamp": "ts", "bloque_anterior": "block_id", "bloque_siguiente": "next_block_id", "rtt_antes_ms": "before_ms", "rtt_despues_ms": "after_ms", "delta_rtt_ms": "delta_ms", "tipo_cambio": "kind", "ciclos_ventana": "window"},
    "change_points": {"timestamp": "cycle_ts", "estado_anterior": "prev_state", "estado_nuevo": "state"},
    "estados_hdphmm": {"timestamp": "cycle_ts"},
    "historial_traceroute": {"timestamp": "cycle_ts"},
    "eventos": {"timestamp": "cycle_ts"},
    "perfil_horario": {"hora": "hour", "media": "mean", "tasa_picos": "spike_rate"},
    "elevaciones_piso": {"umbral_ms": "threshold", "inicio": "start_ts", "fin": "end_ts", "duracion_h": "hours", "elevacion_max_ms": "max_x"},
    "perfil_diario": {"dia": "day"},
}


def columns(name: str) -> list[str]:
    return [c.split(":")[0] for c in COLUMNS[name].split()]


def _text(c: Column, kind: T.DataType, decimals: str) -> Column:
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, TIME)
    if isinstance(kind, T.BooleanType):
        return c.cast("int")
    if isinstance(kind, T.ArrayType):
        return F.array_join(c.cast("array<string>"), ">" if isinstance(kind.elementType, T.StringType) else "|")
    return F.when(c.isNotNull(), F.format_string(f"%.{decimals}f", c.cast("double"))) if decimals else c


def as_file(df: DataFrame, name: str, by: list[str]) -> DataFrame:
    """The series columns and the file's columns in order, as text holds them.  A column
    that the table lacks under both of its names is an error, others are left out."""
    kinds = {f.name: f.dataType for f in df.schema}
    out, lacking = [], []
    for entry in COLUMNS[name].split():
        c, _, decimals = entry.partition(":")
        own = c if c in kinds else NAMES.get(name, {}).get(c, c)
        if own in kinds:
            out.append(_text(F.col(f"`{own}`"), kinds[own], decimals).alias(c))
        else:
            lacking.append(c)
    if lacking:
        raise ValueError(f"{name}: no column for {', '.join(lacking)}")
    return df.select(*by, *out)


def write_file(df: DataFrame, name: str, folder: str, by: list[str], order: list[str], mode: str = "overwrite") -> str:
    """Writes folder/name with a folder for each series, rows in order from part to
    part: a series with most rows is dealt into several parts.  No rows, no file."""
    path = f"{folder.rstrip('/')}/{name}"
    placed = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    as_file(placed, name, by).write.mode(mode).partitionBy(*by).option("header", True).csv(path)
    return path
