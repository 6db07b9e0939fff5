"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

_TABLES: dict[str, SparkSession] = {}


@lru_cache
def _local() -> str:
    made = tempfile.mkdtemp(prefix="tracewright-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return "file://" + made


def folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; a local session without it has a folder of this process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or _local()).rstrip("/")


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read again: cuts the lineage, so that what was computed once
    stays as it is and a lost executor costs a read.  Goes with the process or ``dropped``."""
    path = f"{folder(df.sparkSession)}/tw-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TABLES[path] = df.sparkSession
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tw_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes settled tables that nothing reads any more."""
    for path in [getattr(t, "_tw_path", None) for t in tables]:
        if path in _TABLES:
            spark = _TABLES.pop(path)
            with contextlib.suppress(Exception):  # the session may have ended; the folder is scratch space
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


@atexit.register
def _drop_all() -> None:
    for path in list(_TABLES):
        dropped(type("T", (), {"_tw_path": path}))
