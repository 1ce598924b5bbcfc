"""Models of streams: moments of what has arrived so far, merged batch by batch, from which a model is fitted at any time.

After each batch the folder holds the moments of all batches up to it, a row of features x features doubles, and those of
the batch before. A batch that runs again after a failure starts from the state before it and puts its own in the same place, so nothing counts twice.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from facetflow.operators.pca import Moments, PCAModel, fit_moments, merged, moments
from facetflow.operators.preprocess import Preprocess

_STATE = "features array<string>, n long, counts array<double>, means array<double>, products array<double>"


def _place(folder: str, batch: int) -> str:
    return f"{folder.rstrip('/')}/batch={batch}"


def _files(spark: SparkSession, folder: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _kept(spark: SparkSession, folder: str) -> list[int]:
    """Batches whose states are kept, in order."""
    place, files = _files(spark, folder)
    names = [p.getPath().getName() for p in files.listStatus(place)] if files.exists(place) else []
    return sorted(int(x.partition("=")[2]) for x in names if x.startswith("batch="))


def _read(row) -> Moments:
    m = len(row["features"])
    return Moments(row["n"], np.array(row["counts"]), np.array(row["means"]), np.array(row["products"]).reshape(m, m))


def state(spark: SparkSession, folder: str, features: list[str], before: int | None = None) -> Moments:
    """Moments of all batches, or of those ``before`` one; none have come is a state of no rows."""
    m = len(features)
    kept = [b for b in _kept(spark, folder) if before is None or b < before]
    if not kept:
        return Moments(0, np.zeros(m), np.zeros(m), np.zeros((m, m)))
    last = spark.read.schema(_STATE).parquet(_place(folder, kept[-1])).first()
    if list(last["features"]) != list(features):
        raise ValueError(f"the state is of {last['features']}, not of {list(features)}")
    return _read(last)


def learn(stream: DataFrame, features: list[str], folder: str, checkpoint: str) -> StreamingQuery:
    """Adds what arrives to the moments in ``folder``. Rows with a missing or non-finite feature take no part.

    The model of the moments after any batch is that of a fit of all rows up to it.
    """
    if not features or len(set(features)) < len(features):
        raise ValueError("features are missing or repeat")
    parts = [F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(features)]
    complete = F.forall(F.array(*[F.col(f"f{i}") for i in range(len(features))]), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = moments(batch, [F.col(c) for c in batch.columns])
        now = merged(state(spark, folder, features, before=number), own)
        row = (list(features), int(now.rows), now.counts.tolist(), now.means.tolist(), now.products.ravel().tolist())
        spark.createDataFrame([row], _STATE).coalesce(1).write.mode("overwrite").parquet(_place(folder, number))
        for old in _kept(spark, folder):
            if old < number - 1:
                place, files = _files(spark, _place(folder, old))
                files.delete(place, True)

    chosen = stream.select(*parts).where(complete)
    return chosen.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def model(spark: SparkSession, folder: str, features: list[str], k: int = 2, preprocess: Preprocess | None = None) -> PCAModel:
    """The model of all rows so far: centred, and standardised if asked for. Other steps need more than moments and raise."""
    return fit_moments(state(spark, folder, features), features, k, preprocess)
