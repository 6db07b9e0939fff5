"""Scalar rules of the domain as Column functions (scalar inventory F1-F20).  All run in the JVM."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings of "no known AS", for verification and for resampling.
UNKNOWN_ASN = ("", "unknown", "na", "none", "nan", "null")
UNKNOWN_ASN_RESAMPLING = ("", "?", "*", "unknown", "none", "nan", "null")
#: Thresholds in ms and minutes of the segment classes.
SEVERE_MS, MODERATE_MS = 5.0, 2.0


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def known_asn(asn: str | Column, unknown: tuple[str, ...] = UNKNOWN_ASN) -> Column:
    """the AS as written (trimmed), null where it says that it isn't known."""
    text = F.trim(c(asn).cast("string"))
    return F.when(~F.lower(text).isin(*unknown), text)


def as_path(hops: str | Column) -> Column:
    """known AS numbers in hop order, neighbours that are equal once.
    hops: array of structs sorted by hop, with a field asn."""
    known = F.filter(F.transform(hops, lambda h: known_asn(h["asn"])), lambda a: a.isNotNull())
    empty = F.array().cast("array<string>")
    return F.aggregate(known, empty, lambda acc, a: F.when(F.try_element_at(acc, F.lit(-1)).eqNullSafe(a), acc).otherwise(F.concat(acc, F.array(a))))


def parse_time(text: str | Column) -> Column:
    """with or without seconds."""
    return F.coalesce(F.try_to_timestamp(c(text), F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(c(text), F.lit("yyyy-MM-dd HH:mm"))).cast("timestamp_ntz")


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970; times are UTC."""
    return F.unix_micros(c(ts).cast("timestamp"))


def number(text: str | Column) -> Column:
    """Double, or null where the text is no number (NaN counts as none)."""
    x = c(text).try_cast("double")
    return F.when(~F.isnan(x), x)


def severity(pct: str | Column) -> Column:
    """F5."""
    return F.when(c(pct) > 200, "dark").when(c(pct) > 40, "medium").otherwise("light")


def segment_class(minutes: str | Column, delta: str | Column, severe: float = SEVERE_MS, moderate: float = MODERATE_MS) -> Column:
    """signed class of a segment; the first rule that holds counts."""
    d, m = c(minutes), F.abs(c(delta))
    sign = F.when(c(delta) > 0, "degradacion").otherwise("mejora")
    return (
        F.when((d > 60) & (m > severe), F.concat(sign, F.lit("_severa_sostenida")))
        .when((d > 30) & (m > moderate), F.concat(sign, F.lit("_moderada_sostenida")))
        .when((d < 10) & (m > 10), F.lit("pico_transitorio"))
        .when(m < 1, F.lit("regimen_base"))
        .otherwise(F.lit("variacion_normal"))
    )


def segment_class_unsigned(minutes: str | Column, mean: str | Column, floor: str | Column) -> Column:
    """the older class, of the mean against one floor for all."""
    d, m = c(minutes), F.abs(c(mean) - c(floor))
    return F.when((d > 60) & (m > 5), "degradacion_severa_sostenida").when((d > 30) & (m > 2), "degradacion_moderada_sostenida").when((d < 10) & (m > 10), "pico_transitorio").when(m < 1, "regimen_base").otherwise("variacion_normal")


def route_change_class(delta: str | Column) -> Column:
    """F12."""
    sign = F.when(c(delta) > 0, "degradacion").otherwise("mejora")
    return F.when(F.abs(c(delta)) > SEVERE_MS, F.concat(sign, F.lit("_severa"))).when(F.abs(c(delta)) > MODERATE_MS, F.concat(sign, F.lit("_moderada"))).otherwise("sin_cambio_relevante")


def reference_key(length: str | Column, path: str | Column, mode: str = "longitud_ruta") -> Column:
    """what a segment is compared within; path is an array or null."""
    n, p = c(length).cast("string"), F.array_join(c(path), ">")
    return {"longitud": n, "ruta": F.coalesce(p, F.lit("")), "longitud_ruta": F.coalesce(F.concat(F.lit("L"), n, F.lit(":"), p), n)}[mode]


def bhattacharyya(m1: str | Column, s1: str | Column, m2: str | Column, s2: str | Column) -> Column:
    """distance of two normal distributions; spreads are at least 1e-6."""
    a, b = F.greatest(c(s1), F.lit(1e-6)), F.greatest(c(s2), F.lit(1e-6))
    v = a * a + b * b
    d = c(m1) - c(m2)
    return d * d / v / 4 + F.log(v / (a * b * 2)) / 2


def is_ambiguous(delta: str | Column, band: float = 0.5) -> Column:
    """within ``band`` of a class border."""
    return (F.abs(F.abs(c(delta)) - MODERATE_MS) <= band) | (F.abs(F.abs(c(delta)) - SEVERE_MS) <= band)


def hour_of(ts: str | Column, offset_h: float = 0.0) -> Column:
    """F16: hour of the day, shifted by an offset that may be a fraction."""
    return F.floor(F.pmod(micros(ts) + F.lit(round(offset_h * 3_600_000_000)), F.lit(86_400_000_000)) / F.lit(3_600_000_000)).cast("int")


def day_of(ts: str | Column, offset_h: float = 0.0) -> Column:
    shifted = micros(ts) + F.lit(round(offset_h * 3_600_000_000))
    return F.timestamp_micros(shifted).cast("date")


def percent(part: str | Column, whole: str | Column) -> Column:
    """'n/d' where there is no whole."""
    return F.when(c(whole) > 0, F.format_string("%.1f%%", c(part) * 100.0 / c(whole))).otherwise("n/d")


def view_window(start: str | Column, stop: str | Column) -> Column:
    """centre and half-range (ms) of a time range, null unless stop is later."""
    a, b = F.floor(micros(start) / 1000), F.floor(micros(stop) / 1000)
    half = F.floor((b - a) / 2)
    return F.when(b > a, F.struct((a + half).cast("long").alias("center_ms"), half.cast("long").alias("window_ms")))


def _query(base: str, measurement: str | Column, probe: str | Column, center: Column, window: Column, mode: str = "") -> Column:
    return F.concat(F.lit(base + "?sourceProbeId="), c(probe).cast("string"), F.lit("&measurementId="), c(measurement).cast("string"), F.lit(mode + "&center="), center, F.lit("&window="), window)


def view_url(base: str, measurement: str | Column, probe: str | Column, start: str | Column, stop: str | Column) -> Column:
    """address of the view of a time range, null unless stop is later."""
    w = view_window(start, stop)
    at = F.date_format(F.timestamp_millis(w["center_ms"]).cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return _query(base, measurement, probe, at, w["window_ms"].cast("string"), "&sequentialMode=true")


def event_url(base: str, measurement: str | Column, probe: str | Column, ts: str | Column) -> Column:
    """the same around one cycle, two hours to each side."""
    return _query(base, measurement, probe, F.floor(micros(ts) / 1000).cast("string"), F.lit("7200000"))


def duration_text(seconds: str | Column, interval_s: str | Column) -> Column:
    """hours where the interval is an hour or more, else minutes; two decimals at most."""
    hours = c(interval_s) >= 3600
    number_ = F.format_string("%.2f", F.when(hours, c(seconds) / 3600.0).otherwise(c(seconds) / 60.0))
    return F.concat(F.regexp_replace(number_, r"\.?0+$", ""), F.when(hours, " h").otherwise(" min"))


def private_v4(ip: str | Column) -> Column:
    """F3/F4 for IPv4 texts: private, loopback or link-local; null for others."""
    part = lambda n: F.regexp_extract(c(ip).cast("string"), r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", n).try_cast("int")
    a, b = part(1), part(2)
    return (a == 10) | (a == 127) | ((a == 192) & (b == 168)) | ((a == 172) & b.between(16, 31)) | ((a == 169) & (b == 254))


#: Documentation ranges that the verifier takes for public.
_DOCUMENTATION = (ipaddress.ip_network("2001:db8::/32"), ipaddress.ip_network("3fff::/20"))


def is_private_ip(text: str | None, verifier: bool = True) -> bool:
    """F3 (verifier) and F4; what is no address is not private."""
    try:
        ip = ipaddress.ip_address((text or "").strip())
    except ValueError:
        return False
    if verifier and any(ip.version == n.version and ip in n for n in _DOCUMENTATION):
        return False
    return ip.is_private or (verifier and (ip.is_loopback or ip.is_link_local))


def private_ip(ip: Column, verifier: bool = True) -> Column:
    """The same as a column, for distinct addresses (IPv6 needs the library)."""

    @F.pandas_udf(T.BooleanType())
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: is_private_ip(t, verifier)).astype(bool)

    return of(ip)
