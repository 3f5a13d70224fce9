"""Row-wise pipelines over a streaming source.

Ratios, fills, casts, one-hot with a given vocabulary and encoders fitted on a batch frame are
projections and stream-static joins, so the same pipeline object runs over a stream. There is
no state and thus no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.pipeline import Pipeline


def streamable(pipeline: Pipeline, stream: DataFrame) -> DataFrame:
    """The pipeline's plan over a stream; an error if a step would need a batch job."""
    if not stream.isStreaming:
        raise ValueError("the frame is no stream")
    if pipeline.counter.mode != "off":
        raise ValueError("row counts of a stream come from its progress reports; use metrics='off'")
    out = pipeline.run(stream)
    if not out.isStreaming:
        raise ValueError("a step left the stream")
    return out


def run_stream(pipeline: Pipeline, stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet"):
    """Writes what is there, exactly once over restarts with the same checkpoint, and returns the query."""
    writer = streamable(pipeline, stream).writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()
