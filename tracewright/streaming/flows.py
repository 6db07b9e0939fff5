"""The same analyses over streams: windows in event time and stateful comparison."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import quantile
from ..operators.windows import QS


def windowed_quantiles(stream: DataFrame, keys: list[str], ts: str, x: str, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Exact quantiles by window; rows later than ``late`` don't count."""
    timed = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    w = F.window("__ts", size, slide) if slide else F.window("__ts", size)
    return timed.groupBy(*keys, w.alias("w")).agg(F.count(x).alias("n"), quantile(x, QS).alias("q")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "q")


def sessions(stream: DataFrame, keys: list[str], ts: str, x: str, gap: str = "90 minutes", late: str = "10 minutes") -> DataFrame:
    """Sequences without a longer gap."""
    timed = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return timed.groupBy(*keys, F.session_window("__ts", gap).alias("w")).agg(F.count(x).alias("n"), F.avg(x).alias("mean")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean")


def state_changes(stream: DataFrame, key: str, ts: str, state: str) -> DataFrame:
    """Rows whose state differs from the series' last one, across batches."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], memory) -> Iterator[pd.DataFrame]:
        last = memory.get[0] if memory.exists else None
        rows = pd.concat(list(batches)).sort_values(ts)
        out = []
        for t, s in zip(rows[ts], rows[state]):
            if last is not None and s != last:
                out.append((k[0], t, last, s))
            last = s
        memory.update((last,))
        yield pd.DataFrame(out, columns=[key, ts, "prev_state", "state"])

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {ts} {kinds[ts]}, prev_state {kinds[state]}, state {kinds[state]}", f"last {kinds[state]}", "append", "NoTimeout")
