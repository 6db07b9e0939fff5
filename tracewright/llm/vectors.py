"""What both vector operators need: valid rows, and copies as one entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_valid(vec: str) -> Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vec) > 0) & ~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


def keyed(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec, h1, h2): 128 bits of hash stand for the vector."""
    vec = F.col(vec_col).cast("array<float>")
    return df.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(7), "vec")})
