"""Schemas of the domain's files, as DDL, by table name."""

RAW = "timestamp long, dst_addr string, result array<struct<hop: int, result: array<struct<rtt: double, from: string>>>>"
CSV = {
    "historial": "timestamp string, hop string, ip string, asn string, rtt_ms string",
    "eventos": "timestamp string, categoria string",
    "tramos_longitud": "inicio string, longitud int, ciclos int, sostenido int",
    "bloques_longitud": "bloque_id int, longitud int, inicio string, fin string, duracion_h double, ciclos int, fuera int, tramos_sostenidos int, longitud_modal int, ruta string, longitudes string",
    "ciclos_excluidos": "ciclo string, salto int, ultimo_salto_ip string, asn string, rtt_ms double, privada int, motivo string, tramo_n int, tramo_inicio string, tramo_longitud int, tramo_sostenido int, misma_longitud_que_tramo int, entre_tramos int, tramo_siguiente_n int, bloque_id int",
    "verdad_ciclos": "idx int, timestamp string, hueco string, regimen string, delta_ms string, salto_localizacion string, nivel_ultimo_ms string, spike_ms string, sin_destino string, modo_fallo string, n_saltos_emitidos string, rtt_ultimo_ms string",
    "segmentos_caracterizados": "seq_id int, estado int, start_ts string, end_ts string, n_ciclos int, duracion_minutos double, media double, mediana double, std double, min double, max double, tipo_degradacion string, bloque_id int, longitud int, rtt_referencia double, desviacion_ms double, clave_referencia string",
    "mapa_macro": "state string, macro string",
}
MAIN_BLOCK = "measurement string, probe string, cadencia_s double, persistencia int, elegido struct<bloque_id: int, longitud: int, ruta: string, inicio: string, fin: string, duracion_h: double, ciclos: int, ciclos_propios: int, cobertura: double, elegible: boolean>"
