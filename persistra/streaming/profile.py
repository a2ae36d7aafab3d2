"""Exact dyad state over a stream of events with a declared horizon.

Counts, masks, first and last times merge, so late events only set bits and no
watermark is needed; the state is one row for each dyad."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from persistra.functions.exprs import window_index, window_mask
from persistra.operators.census import canonical, headline


def dyad_state(events: DataFrame, t0: float, t1: float, windows: int = 5) -> DataFrame:
    """Streaming (u, v, t) -> n, first, last, m5 of each dyad; for update or complete mode."""
    e = canonical(events).withColumns({"t0": F.lit(t0), "t1": F.lit(t1)}).withColumn("w", window_index("t", "t0", "t1", windows))
    return e.groupBy("u", "v").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"), window_mask("w").alias(f"m{windows}"))


def start_profile(events: DataFrame, t0: float, t1: float, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the headline profile after every micro-batch under ``path/batch=<n>``."""

    def sink(state: DataFrame, batch: int) -> None:
        headline(state).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return dyad_state(events, t0, t1).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
