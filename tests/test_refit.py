"""Moments of streams against fits of all rows."""

import numpy as np
import pytest

from facetflow.operators import pca
from facetflow.operators.preprocess import Preprocess
from facetflow.streaming import refit

FEATURES = ["a", "b", "c"]


def _arrive(spark, path, rows):
    spark.createDataFrame(rows, "a double, b double, c double").coalesce(1).write.mode("append").parquet(path)


def _learn(spark, path, state, checkpoint):
    stream = spark.readStream.schema("a double, b double, c double").option("maxFilesPerTrigger", 1).parquet(path)
    refit.learn(stream, FEATURES, state, checkpoint).awaitTermination()


def test_three_batches_and_a_restart(spark, tmp_path):
    rng = np.random.default_rng(3)
    path, state, checkpoint = (str(tmp_path / x) for x in ("in", "state", "checkpoint"))
    parts = [(rng.normal(size=(n, 3)) @ rng.normal(size=(3, 3)) + 100.0 * (i + 1)).tolist() for i, n in enumerate((40, 1, 25))]
    for part in parts[:2]:
        _arrive(spark, path, part)
    _learn(spark, path, state, checkpoint)
    _arrive(spark, path, [*parts[2], [None, 1.0, 2.0], [float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0]])
    _learn(spark, path, state, checkpoint)
    table = spark.createDataFrame(sum(parts, []), "a double, b double, c double")
    for pre in (Preprocess(), Preprocess(scale="standard"), Preprocess(center=False)):
        mine, whole = refit.model(spark, state, FEATURES, 2, pre), pca.fit(table, FEATURES, 2, pre)
        assert mine.rows == whole.rows == 66
        assert np.allclose(mine.eigenvalues, whole.eigenvalues, rtol=1e-8)
        assert np.allclose(mine.loadings, whole.loadings, atol=1e-6)
    assert refit._kept(spark, state) == [1, 2]


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    path, state, checkpoint = (str(tmp_path / x) for x in ("in", "state", "checkpoint"))
    _arrive(spark, path, [[1.0, 2.0, 3.0], [2.0, 1.0, 0.0], [0.0, 5.0, 1.0]])
    _learn(spark, path, state, checkpoint)
    _learn(spark, path, state, str(tmp_path / "forgotten"))  # batch 0 once more, its checkpoint lost
    assert refit.state(spark, state, FEATURES).rows == 3


def test_refusals(spark, tmp_path):
    state = str(tmp_path / "none")
    assert refit.state(spark, state, FEATURES).rows == 0
    with pytest.raises(ValueError, match="two rows"):
        refit.model(spark, state, FEATURES)
    with pytest.raises(ValueError, match="medians"):
        refit.model(spark, state, FEATURES, preprocess=Preprocess(scale="robust"))
