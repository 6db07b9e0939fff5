"""The whole flow over saved measurements: extract, verify, view."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import private_ip, view_url
from ..operators import paths, reports
from ..sources import readers
from ..sources.files import write_file

KEYS, CYCLE = readers.SERIES, ["cycle_ts"]


@dataclass
class Outcome:
    """status 0: all steps; 1: no history, nothing after it; 2: the files of the check
    or the addresses of the views are missing."""

    status: int = 0
    files: dict[str, str] = field(default_factory=dict)
    notes: list[str] = field(default_factory=list)
    views: DataFrame | None = None


def extract(spark: SparkSession, raw: str, folder: str, max_hops: int = 15, asn_of_ip: DataFrame | None = None) -> dict[str, str]:
    """K1, K2: the history of hops, silent ones too, and the log of events."""
    hops = paths.flatten_measurements(readers.measurements(spark, raw), KEYS, max_hops)
    hops = hops.withColumn("cycle_ts", F.timestamp_seconds("timestamp").cast("timestamp_ntz")).drop("timestamp")
    hops = hops.withColumn("asn", F.lit(None).cast("string")) if asn_of_ip is None else readers.with_asn(hops, asn_of_ip)
    files = {"historial_traceroute": write_file(hops, "historial_traceroute", folder, KEYS, [*CYCLE, "hop"])}
    target = hops.groupBy(*KEYS, *CYCLE).agg(F.min("dst_addr").alias("ip"))
    target = target.withColumn("asn", F.lit(None).cast("string")) if asn_of_ip is None else readers.with_asn(target, asn_of_ip)
    target = target.withColumnsRenamed({"ip": "dst", "asn": "dst_asn"})
    cyc = paths.cycles(hops, KEYS, CYCLE).join(target, [*KEYS, *CYCLE])
    events = paths.events(hops, cyc, KEYS, CYCLE, asn_of_ip is not None, dst="dst", dst_asn="dst_asn")
    return files | {"eventos": write_file(events, "eventos", folder, KEYS, [*CYCLE, "ordinal"])}


def verify(spark: SparkSession, history: str, folder: str, persistence: int = 4, fuse: bool = False) -> dict[str, str]:
    """K3-K8: what the history says of runs, blocks, exclusions and comparisons."""
    cyc = paths.cycles(readers.hops(spark, history), KEYS, CYCLE)
    seen = cyc.select("last_ip").distinct().withColumn("__private", private_ip(F.col("last_ip")))
    cyc = paths.reachability(cyc.join(seen, "last_ip", "left"), KEYS, CYCLE, F.col("__private"))
    # Every table below starts from the cycles: they are built and written once.
    cyc.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/ciclos")
    cyc = spark.read.parquet(f"{folder.rstrip('/')}/ciclos")
    tables = {
        "tramos_longitud": (reports.run_table(cyc, KEYS, CYCLE, persistence), ["inicio"]),
        "bloques_longitud": (reports.block_report(cyc, KEYS, CYCLE, persistence, fuse), ["bloque_id"]),
        "ciclos_excluidos": (reports.excluded_report(cyc, KEYS, CYCLE, persistence, F.col("__private"), fuse), ["ciclo"]),
        "destinos_ip_final": (reports.destination_report(cyc, KEYS, CYCLE), ["ciclos", "ip_final"]),
        "diagnostico_longitudes": (reports.length_report(cyc, KEYS, CYCLE, fuse), ["ciclos", "longitud"]),
        "caminos": (reports.path_report(cyc, KEYS, CYCLE), ["timestamp"]),
    }
    files = {"ciclos": f"{folder.rstrip('/')}/ciclos"}
    files |= {name: write_file(df, name, folder, KEYS, order) for name, (df, order) in tables.items()}
    main = f"{folder.rstrip('/')}/bloque_principal"
    # One row a series, one file a folder: each file is one JSON object.
    chosen = reports.main_block_report(cyc, KEYS, CYCLE, persistence, fuse=fuse).withColumns({"measurement": F.col(KEYS[0]).cast("string"), "probe": F.col(KEYS[1]).cast("string")})
    chosen.repartition(*KEYS).write.mode("overwrite").partitionBy(*KEYS).json(main)
    return files | {"bloque_principal": main}


def analyse(spark: SparkSession, raw: str, folder: str, base_url: str, start: str, stop: str, persistence: int = 4, max_hops: int = 15, asn_of_ip: DataFrame | None = None, fuse: bool = False) -> Outcome:
    """All three steps; a failure of the first ends the flow, one of the others is noted."""
    out = Outcome()
    try:
        out.files |= extract(spark, raw, folder, max_hops, asn_of_ip)
    except Exception as e:
        return Outcome(1, notes=[f"extract: {e}"])
    try:
        out.files |= verify(spark, out.files["historial_traceroute"], folder, persistence, fuse)
    except Exception as e:
        out.status, out.notes = 2, [*out.notes, f"verify: {e}"]
    at = lambda t: F.lit(t).try_cast("timestamp_ntz")
    series = readers.raw_hops(spark, out.files["historial_traceroute"]).select(*KEYS).distinct()
    out.views = series.withColumn("url", view_url(base_url, KEYS[0], KEYS[1], at(start), at(stop)))
    if spark.range(1).select(view_url(base_url, F.lit(0), F.lit(0), at(start), at(stop)).alias("u")).first().u is None:
        out.status, out.notes = 2, [*out.notes, "view: stop is not later than start"]
    return out
