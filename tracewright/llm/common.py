"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows handed to a Python worker at once.  Documents can be long, so this is
#: far below Spark's default; it bounds a worker's memory, not the result.
ARROW_ROWS = 1000
#: Bytes after which a batch is closed even with fewer rows.
ARROW_BYTES = 4 << 20


#: Below U+0300, for the standard library's regular expressions: letters, the
#: other numbers besides digits, and white space as Unicode has them.
_NUMBERS = "²³¹¼½¾"
LATIN_LETTER = rf"[^\W\d_{_NUMBERS}]"
LATIN_NUMBER = rf"[\d{_NUMBERS}]"
LATIN_SPACE = r" \t-\r\x85\xa0"
NOT_LATIN = "[^\x00-\u02ff]"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``.  Only on one machine (unit
    tests) may it be unset: then a temporary folder is made, for this process.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        known = _local_dir()
    return known.rstrip("/")


@lru_cache
def _local_dir() -> str:
    """This process's folder where no other is named; gone at its end."""
    made = tempfile.mkdtemp(prefix="tracewright-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return "file://" + made


#: Settled tables of this process that are still there: folder -> session.
_SETTLED: dict[str, SparkSession] = {}


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation,
    and values that were assigned once (ranks, roots) can't change on retry.
    The table goes when it is handed to ``unsettle``, or with the process: results
    are lazy, so what they read must stay until then.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tw-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SETTLED[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._tw_path = path
    return out


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new name in the shared folder for files that an operator writes itself; goes with the process."""
    path = f"{scratch_dir(spark)}/tw-{name}-{uuid.uuid4().hex}"
    _SETTLED[path] = spark
    return path


def _remove(path: str) -> None:
    spark = _SETTLED.pop(path)
    with contextlib.suppress(Exception):  # the session may have ended; the folder is scratch space
        jvm = spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def unsettle(*tables: DataFrame | None) -> None:
    """Remove settled tables that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_tw_path", None)
        if path in _SETTLED:
            _remove(path)


@atexit.register
def _remove_all() -> None:
    for path in list(_SETTLED):
        _remove(path)


#: A key is broadcast in a join where it has more than one in so many of the rows:
#: at most so many rows are broadcast, whatever the input.
HOT = 1024


def attach(rows: DataFrame, table: DataFrame, on: Column, hot: Column) -> DataFrame:
    """``rows`` joined to a table with unique keys; its ``hot`` keys, at most ``HOT``, are broadcast."""
    few, rest = F.broadcast(table.filter(hot)), table.filter(~hot)
    return rows.join(few, on).unionByName(rows.join(few, on, "left_anti").join(rest, on))


def rows_of(df: DataFrame) -> DataFrame:
    """``df`` as one column ``row``, so that no name of an operator meets one of its columns."""
    return df.select(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row"))


def quoted(name: str, of: str = "") -> str:
    """A column's name as an expression, whatever characters it has."""
    return of + "`" + name.replace("`", "``") + "`"


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, as texts have no length limit."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def text_of(col: str = "text"):
    """The text, with null as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_held_out(id_col: str = "doc_id", folds: int = 5):
    """True where crc32 of the id as text leaves no remainder; null ids never."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


LONG, INT, STRING = T.LongType(), T.IntegerType(), T.StringType()


#: What operators keep in a worker process between tasks: name -> how to drop it.
_KEPT: dict = {}


def keeps(name: str, drop) -> None:
    """Register what an operator keeps in worker processes."""
    _KEPT[name] = drop


def working_on(name: str) -> None:
    """Called by worker functions when they start: workers are used again by later
    stages, so what other operators have kept in this process goes."""
    for other, drop in _KEPT.items():
        if other != name:
            drop()
