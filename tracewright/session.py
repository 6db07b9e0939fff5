"""Sessions, and the package on the workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: What every query relies on.
PINNED = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}


def build_session(master: str = "local[*]", app: str = "tracewright", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    for k, v in {**PINNED, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers once, so that functions for grouped
    operators can be imported there wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_tracewright_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tracewright-")) / "tracewright.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._tracewright_shipped = True
