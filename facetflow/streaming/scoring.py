"""Scores and diagnostics of a stream by a fitted model: stateless projections, so no watermark or state is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from facetflow.operators.pca import PCAModel


def scored(stream: DataFrame, model: PCAModel, diagnostics: bool = True) -> DataFrame:
    """The stream with component scores and, if asked for, T^2, residuals and the outlier flag."""
    return model.diagnostics(stream) if diagnostics else model.transform(stream)


def write(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to Parquet; started again with the same checkpoint it goes on where it ended."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
