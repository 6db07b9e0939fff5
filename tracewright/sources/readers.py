"""Readers of the domain's files (S1-S15).  Explicit schemas; bad values become null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import number, parse_time
from .schemas import CSV, MAIN_BLOCK, RAW

#: Fixed value: how file names name a series.
IDENTITY = r"measurement(\d+)_probe(\d+)"
SERIES = ["measurement_id", "probe_id"]
#: Macro states where no map is given (best base, slight, congestion, outlier).
DEFAULT_MACROS = {10: 0, 13: 0, 14: 0, 0: 1, 1: 1, 2: 2, 5: 3}


def with_identity(df: DataFrame) -> DataFrame:
    """measurement_id and probe_id from the folders, or else from the file's name."""
    name = F.col("_metadata.file_name")
    own = [F.col(c).cast("long").alias(c) if c in df.columns else F.regexp_extract(name, IDENTITY, i).try_cast("long").alias(c) for i, c in enumerate(SERIES, 1)]
    return df.select(*[c for c in df.columns if c not in SERIES], *own)


def _csv(spark: SparkSession, path: str, table: str, header: bool = True) -> DataFrame:
    return with_identity(spark.read.schema(CSV[table]).option("header", header).csv(path))


def measurements(spark: SparkSession, path: str) -> DataFrame:
    """Saved measurement results (JSON)."""
    return with_identity(spark.read.schema(RAW).option("multiLine", True).json(path))


def raw_hops(spark: SparkSession, path: str) -> DataFrame:
    """Every row as it stands, with its place in the file."""
    return _csv(spark, path, "historial").withColumn("row", F.monotonically_increasing_id())


def hops(spark: SparkSession, path: str, mode: str = "verify") -> DataFrame:
    """S3 (verify: an ip is needed, a round trip isn't), S4 (segment: hop and round
    trip are needed), S5 (resample: like verify, but a cycle in which no hop answered
    stays, as one row without a hop).  Of rows for one cycle and hop the last in the file
    counts."""
    return typed_hops(raw_hops(spark, path), SERIES, mode)


def typed_hops(raw: DataFrame, keys: list[str], mode: str = "verify", row: str = "row") -> DataFrame:
    cols = {"cycle_ts": parse_time("timestamp"), "hop": F.trim("hop").try_cast("int"), "ip": F.trim("ip"), "asn": F.trim("asn"), "rtt_ms": number("rtt_ms")}
    rows = raw.select(*keys, row, *[v.alias(k) for k, v in cols.items()]).filter("cycle_ts is not null")
    usable = F.col("hop").isNotNull() & (F.col("rtt_ms").isNotNull() if mode == "segment" else F.coalesce(F.col("ip") != "", F.lit(False)))
    if mode != "resample":
        rows = rows.filter(usable)
    r = F.when(usable, F.struct("ip", "asn", "rtt_ms"))
    last = rows.groupBy(*keys, "cycle_ts", F.when(usable, F.col("hop")).alias("hop")).agg(F.max_by(r, row).alias("r"))
    if mode == "resample":
        answers = F.count("hop").over(Window.partitionBy(*keys, "cycle_ts"))
        last = last.withColumn("__a", answers).filter("hop is not null or __a = 0")
    return last.select(*keys, "cycle_ts", "hop", "r.ip", "r.asn", "r.rtt_ms")


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks with their lengths as an array (their own length if none are named)."""
    b = _csv(spark, path, "bloques_longitud")
    lengths = F.filter(F.transform(F.split("longitudes", r"\|"), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull())
    lengths = F.when(F.coalesce(F.size(lengths), F.lit(0)) > 0, lengths).otherwise(F.array("longitud"))
    return b.select(*SERIES, F.col("bloque_id").alias("block_id"), F.col("longitud").alias("length"), parse_time("inicio").alias("start_ts"), parse_time("fin").alias("end_ts"), "ciclos", "fuera", F.split("ruta", ">").alias("path"), lengths.alias("lengths"))


def excluded(spark: SparkSession, path: str) -> DataFrame:
    """Excluded cycles; without a reason they count as sin_destino."""
    return _csv(spark, path, "ciclos_excluidos").select(*SERIES, parse_time("ciclo").alias("cycle_ts"), F.coalesce("motivo", F.lit("sin_destino")).alias("motivo"), F.col("bloque_id").alias("block_id")).filter("cycle_ts is not null")


def excluded_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Flickers and transients of each block."""
    is_ = lambda m: F.sum((F.col("motivo") == m).cast("long"))
    return rows.filter("block_id is not null").groupBy(*keys, "block_id").agg(is_("parpadeo").alias("parpadeo"), is_("transitorio").alias("transitorio"))


def event_counts(spark: SparkSession, path: str) -> DataFrame:
    """Events of each kind by time."""
    kinds = ["rtt_light", "rtt_medium", "rtt_dark", "cambio_ip_asn", "cambio_longitud", "cambio_destino"]
    rows = _csv(spark, path, "eventos").withColumn("cycle_ts", parse_time("timestamp"))
    return rows.groupBy(*SERIES, "cycle_ts").pivot("categoria", kinds).count().na.fill(0, kinds)


def truth(spark: SparkSession, path: str) -> DataFrame:
    """Truth by cycle; gaps and cycles that don't reach are left out."""
    t = _csv(spark, path, "verdad_ciclos")
    zero = lambda c: F.coalesce(number(c), F.lit(0.0)).alias(c)
    bad = (F.coalesce(number("hueco"), F.lit(0.0)) != 0) | (F.coalesce(number("sin_destino"), F.lit(0.0)) != 0)
    return t.filter(~bad).select(*SERIES, "idx", parse_time("timestamp").alias("cycle_ts"), "regimen", zero("delta_ms"), zero("nivel_ultimo_ms"), zero("spike_ms"), number("rtt_ultimo_ms").alias("rtt_ms"))


def main_block(spark: SparkSession, path: str) -> DataFrame:
    """S11."""
    return spark.read.schema(MAIN_BLOCK).option("multiLine", True).json(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """S12."""
    s = _csv(spark, path, "segmentos_caracterizados")
    return s.withColumns({"start_ts": parse_time("start_ts"), "end_ts": parse_time("end_ts")})


def macro_map(spark: SparkSession, path: str) -> DataFrame:
    """State to macro state; rows that aren't two whole numbers are skipped."""
    m = spark.read.schema(CSV["mapa_macro"]).option("header", False).csv(path)
    return m.select(F.trim("state").try_cast("int").alias("state"), F.trim("macro").try_cast("int").alias("macro")).filter("state is not null and macro is not null")


def default_macro_map(spark: SparkSession) -> DataFrame:
    """The map that holds where no file is given."""
    return spark.createDataFrame(list(DEFAULT_MACROS.items()), "state int, macro int")


def apply_macro_map(rows: DataFrame, mapping: DataFrame, state: str = "state") -> DataFrame:
    """States without an entry stay as they are."""
    m = mapping.select(F.col("state").cast("long").alias("__s"), F.col("macro").cast("long").alias("__m"))
    return rows.join(m, F.col(state) == F.col("__s"), "left").withColumn(state, F.coalesce("__m", F.col(state).cast("long"))).drop("__s", "__m")


def with_asn(rows: DataFrame, asn_of_ip: DataFrame) -> DataFrame:
    """AS from a table (ip, asn); addresses without an entry are Unknown."""
    names = asn_of_ip.groupBy("ip").agg(F.min("asn").alias("__asn"))
    return rows.join(names, "ip", "left").withColumn("asn", F.when(F.col("ip").isNotNull(), F.coalesce("__asn", F.lit("Unknown")))).drop("__asn")
