"""Apply fitted feature transforms to a Structured Streaming DataFrame.

The reference has no streams; this is the §7.5 extension: statistics fitted
on a batch table are literals, so every row-local transform runs unchanged on
``readStream`` input, and label / frequency / target encodings become
stream-static joins against the staged lookup tables.  NTILE needs the
whole table and is refused on a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.transforms import FittedTransforms, fit_transforms


def fit_for_stream(batch: DataFrame, raw_specs: list[dict], **kw) -> FittedTransforms:
    """Fit on a batch table; its lookup tables are staged, so every micro-batch reads them."""
    return fit_transforms(batch, raw_specs, **kw)


def transform_stream(stream: DataFrame, fitted: FittedTransforms, include_original: bool = True) -> DataFrame:
    if not stream.isStreaming:
        raise ValueError("expected a streaming DataFrame")
    return fitted.transform(stream, include_original).df


def run_to_memory(stream_out: DataFrame, name: str, checkpoint: str):
    """Drive a streaming result to completion into an in-memory table (tests,
    smoke runs); returns the finished query."""
    q = (stream_out.writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q
