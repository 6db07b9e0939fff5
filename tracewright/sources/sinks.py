"""Writers of the domain's files (K1-K23): names and formats are the tables' own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIME = "yyyy-MM-dd HH:mm:ss"


def flat(df: DataFrame, decimals: dict[str, int] | None = None) -> DataFrame:
    """Columns as CSV holds them: times as text, flags as 0/1, paths joined by '>',
    other arrays by '|', numbers rounded where asked."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, TIME)
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("int")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ">" if isinstance(f.dataType.elementType, T.StringType) else "|")
        elif decimals and f.name in decimals:
            c = F.round(c, decimals[f.name])
        out.append(c.alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, decimals: dict[str, int] | None = None, mode: str = "overwrite", by: list[str] | None = None) -> None:
    w = flat(df, decimals).write.mode(mode).option("header", True)
    (w.partitionBy(*by) if by else w).csv(path)


def write_table(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet, for everything that is read again."""
    w = df.write.mode(mode)
    (w.partitionBy(*by) if by else w).parquet(path)


def append_summary(df: DataFrame, path: str) -> str:
    """Appends; where what stands there has other columns, writes beside it.
    Returns the path written to."""
    spark = df.sparkSession
    try:
        old = spark.read.option("header", True).csv(path).columns
    except Exception as e:  # nothing there yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        old = df.columns
    target = path if old == df.columns else f"{path.rstrip('/')}_v{len(df.columns)}"
    write_csv(df, target, mode="append")
    return target


def viewer_json(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON text a row, '</' escaped for use inside a page."""
    rest = [c for c in nodes.columns if c not in keys]
    return nodes.select(*keys, F.regexp_replace(F.to_json(F.struct(*rest)), "</", "<\\\\\\\\/").alias("json"))
