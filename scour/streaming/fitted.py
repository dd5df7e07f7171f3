"""Fitted operations on a stream: the statistics come from a batch table, the stream is only mapped row by row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from scour.functions.columns import col
from scour.operators.features import Bins, Scale, discretise
from scour.operators.impute import Fill, apply_fills
from scour.operators.outliers import Bounds, ForestFit, ZScale, clip, remove_far, replace_anomalies


def apply_fitted(stream: DataFrame, steps: Sequence[object]) -> DataFrame:
    """Apply fitted fills, fences, z-scales, forests, scales and (column, bins) pairs in order."""
    for step in steps:
        if isinstance(step, Fill):
            stream = apply_fills(stream, [step])
        elif isinstance(step, Bounds):
            stream = clip(stream, [step])
        elif isinstance(step, ZScale):
            stream = remove_far(stream, step)
        elif isinstance(step, ForestFit):
            stream = replace_anomalies(stream, step)
        elif isinstance(step, Scale):
            stream = step.apply(stream)
        elif isinstance(step, tuple) and isinstance(step[1], Bins):
            stream = discretise(stream, step[0], step[1])
        else:
            raise TypeError(f"not a fitted row-wise step: {step!r}")
    return stream


def remove_stream_duplicates(stream: DataFrame, subset: Sequence[str], ts: str, delay: str = "1 hour") -> DataFrame:
    """Duplicate rows of a stream within the watermark; state is dropped after the delay."""
    timed = stream.withColumn(ts, col(ts).cast("timestamp")).withWatermark(ts, delay)
    return timed.dropDuplicatesWithinWatermark([*subset]) if subset else timed.dropDuplicatesWithinWatermark()


