"""The keyed sums of this library on unbounded prediction tables.

Every projection works on a streaming DataFrame as it is. Counts of outcomes need state for each key only; sweeps, curves and
metrics follow from them in ``foreachBatch``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tallyframe.operators.metrics import confusion, metric_columns


def running_confusion(stream: DataFrame, threshold: float = 0.5, op: str = ">=", keys: Sequence[str] = ()) -> DataFrame:
    """Outcome counts since the start, for the ``complete`` or ``update`` output mode; state is a row a key."""
    return confusion(stream, threshold, op, keys)


def windowed_metrics(stream: DataFrame, time: str, width: str, late: str, threshold: float = 0.5, keys: Sequence[str] = ()) -> DataFrame:
    """Metrics of each time window, final once the watermark has passed; later rows count nowhere."""
    from pyspark.sql import functions as F

    timed = stream.withWatermark(time, late).withColumn("_window", F.window(time, width))
    out = confusion(timed, threshold, keys=["_window", *keys]).withColumns(metric_columns())
    return out.withColumns({"window_start": F.col("_window.start"), "window_end": F.col("_window.end")}).drop("_window")
