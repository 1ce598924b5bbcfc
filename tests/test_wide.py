"""Many columns at once, kernels in blocks, and documents, against plain computations."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from facetflow.operators import analysis, correlate, document, kernel, pairwise, pca, ranks
from facetflow.operators.preprocess import Preprocess


def _gapped(n, m, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, m)) + rng.standard_normal((n, 1))
    x[:, 1], x[:, 2] = 0.1, 1e7 + x[:, 2]
    x[rng.random((n, m)) < 0.15] = np.nan
    x[:, 3] = np.nan
    x[2:, 4] = np.nan
    return x


def _table(spark, x):
    return spark.createDataFrame([[None if math.isnan(v) else float(v) for v in r] for r in x], ", ".join(f"c{i} double" for i in range(x.shape[1]))).repartition(3)


@pytest.mark.parametrize("tile, block", [(512, 64), (5, 2)])
def test_correlations_of_gapped_columns(spark, monkeypatch, tile, block):
    monkeypatch.setattr(pairwise, "TILE", tile)
    monkeypatch.setattr(pairwise, "BLOCK_ROWS", block)
    x = _gapped(150, 12)
    df = _table(spark, x)
    names = df.columns

    def plain(i, j):
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        a, b = x[both, i], x[both, j]
        flat = both.sum() < 2 or np.ptp(a) == 0 or np.ptp(b) == 0
        return (0.0 if flat else float(np.corrcoef(a, b)[0, 1])), int(both.sum())

    def agree(got, want):
        return got[1] == want[1] and math.isclose(got[0], want[0], abs_tol=1e-6)

    for found in (correlate.pearson_matrix(df, names), pairwise.pairs(df, names[:5], names[5:])):
        rows = found.collect()
        assert all(agree((r.r, r.n), plain(int(r.a[1:]), int(r.b[1:]))) for r in rows) and len(rows) in (66, 35)
    assert len({(r.a, r.b) for r in correlate.pearson_matrix(df, names).collect()}) == 66
    assert pairwise.pairs(df.limit(0), names).collect() == []


@pytest.mark.parametrize("few", [10**6, 5])
def test_ranks_of_many_columns(spark, monkeypatch, few):
    monkeypatch.setattr(ranks, "SHARED", 20)
    rng = np.random.default_rng(5)
    x = np.where(rng.random((200, 4)) < 0.3, 1.5, np.round(rng.standard_normal((200, 4)), 1))
    x[rng.random((200, 4)) < 0.1] = np.nan
    x[:, 3] = np.nan
    df = _table(spark, x).withColumn("k", F.monotonically_increasing_id()).withColumn("text", F.lit("t"))
    before = df.orderBy("k").toPandas()
    got = ranks.mean_ranks(df, ["c0", "c1", "c2", "c3"], few).orderBy("k").toPandas()
    assert list(got.columns) == df.columns and (got.text == "t").all()
    pd.testing.assert_frame_equal(got[["c0", "c1", "c2", "c3"]].astype(float), before[["c0", "c1", "c2", "c3"]].astype(float).rank(), check_dtype=False)


def test_levels_of_a_category_have_no_limit(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal(3000)
    groups = [f"g{i % 1500}" if i % 50 else None for i in range(3000)]
    df = spark.createDataFrame(list(zip(x.tolist(), groups, strict=True)), "PC1 double, g string")
    for method in ("pearson", "spearman"):
        got = {r.variable: r for r in correlate.eigencorrelations(df, ["PC1"], [], ["g"], method).collect()}
        v = pd.Series(x).rank().to_numpy() if method == "spearman" else x
        assert len(got) == len({g for g in groups if g})
        for g in ("g1", "g77", "g1499"):
            r = np.corrcoef(v, [a == g for a in groups])[0, 1]
            assert math.isclose(got[f"g_{g}"].r, r, abs_tol=1e-9) and got[f"g_{g}"].n == 3000 and 0 <= got[f"g_{g}"].p_value <= 1


@pytest.mark.parametrize("how", [{"kernel": "rbf", "gamma": 0.05}, {"kernel": "linear"}, {"kernel": "poly", "gamma": 0.1, "coef0": 1.0, "degree": 2}])
def test_kernels_in_blocks_agree_with_whole_ones(spark, monkeypatch, how):
    monkeypatch.setattr(kernel, "BLOCK_ROWS", 70)
    x = np.random.default_rng(8).standard_normal((300, 4)) * [3, 2, 1, 0.5]
    df = spark.createDataFrame(x.tolist(), ["a", "b", "c", "d"])
    whole, blocks = kernel.fit(df, df.columns, 3, **how), kernel.fit(df, df.columns, 3, local_rows=1, **how)
    assert np.allclose(blocks.eigenvalues, whole.eigenvalues[:3], rtol=1e-9) and np.allclose(blocks.vectors, whole.vectors, atol=1e-7) and np.allclose(blocks.ratios, whole.ratios, rtol=1e-5)
    again = kernel.KernelModel.from_json(blocks.to_json())
    key = ["a", "b", "c", "d"]
    one, two = (np.array(m.transform(df).orderBy(*key).collect()) for m in (blocks, again))
    assert np.array_equal(one, two)
    with pytest.raises(ValueError):
        kernel.KernelModel.from_json(json.dumps({"kind": "kernel", "train": [[1.0]]}))


@pytest.fixture(scope="module")
def points(spark):
    x = np.random.default_rng(2).standard_normal((60, 4)) @ np.array([[3, 1, 0, 0], [0, 1, 1, 0], [0, 0, 1, 2], [1, 0, 0, 1]]) + 5
    return spark.createDataFrame([(i, f'r"{i}', "ab"[i % 2] if i % 9 else None, *map(float, r)) for i, r in enumerate(x)], "row_idx long, name string, g string, f0 double, f1 double, f2 double, f3 double").repartition(4)


@pytest.mark.parametrize("scale, center", [("standard", True), ("none", True), ("none", False), ("robust", True)])
def test_models_are_the_same_after_a_round_trip(spark, points, scale, center):
    features = ["f0", "f1", "f2", "f3"]
    model = pca.fit(points, features, 1, Preprocess(center=center, scale=scale))
    again = pca.PCAModel.from_json(model.to_json())
    foreign = model.document()
    for field in ("feature_spread", "eigenvalues", "n_samples", "score_covariance"):
        del foreign["model"][field]
    foreign["results"] = {"samples": {"names": [""] * 60, "scores": [[0.0]] * 60}}
    other = pca.PCAModel.from_json(json.dumps(foreign))
    assert again.limits() == model.limits() and other.rows == 60 and math.isclose(other.eigenvalues.sum(), model.eigenvalues.sum(), rel_tol=1e-9)
    assert all(o.limits()[k] > 0 for o in (again, other) for k in ("t2_limit_95", "q_limit_95"))
    want = [(r.value, r.correlation) for r in model.loading_rows(spark).collect()]
    for m in (again, other):
        assert np.allclose([(r.value, r.correlation) for r in m.loading_rows(spark).collect()], want)
    flags = [m.diagnostics(points).orderBy("row_idx").select("t2", "is_outlier").collect() for m in (model, again)]
    assert flags[0] == flags[1] and all(abs(c) <= 1 + 1e-9 for _, c in want)
    for field in ("results", "model"):
        broken = {**foreign, field: {k: v for k, v in foreign[field].items() if k not in ("samples", "explained_variance_ratio")}}
        with pytest.raises(ValueError):
            pca.PCAModel.from_json(json.dumps(broken))


def test_models_of_incomplete_rows_keep_their_deviations(spark, points):
    df = points.withColumn("f1", F.when(F.col("row_idx") % 7 != 0, F.col("f1")))
    model = pca.fit(df, ["f0", "f1", "f2"], 1, method="nipals", missing="native")
    again = pca.PCAModel.from_json(model.to_json())
    assert model.loading_rows(spark).collect() == again.loading_rows(spark).collect()
    assert all(abs(r.correlation) <= 1.05 for r in again.loading_rows(spark).collect())


def test_documents_are_written_by_tasks(spark, points, tmp_path):
    found = analysis.analyse(points, ["f0", "f1", "f2", "f3"], 2)
    found.scores = found.scores.withColumn("target", F.when(F.col("row_idx") != 4, F.col("f0")))
    path = str(tmp_path / "d")
    document.write(found, path, names="name", preserved=["g", "target"], description="x")
    document.joined(spark, path, str(tmp_path / "d.json"))
    got = json.loads((tmp_path / "d.json").read_text())
    assert document.problems(got) == [] and document.problems(got, "facetflow") == [] and len(document.problems(got, "other")) == 1
    rows = found.scores.orderBy("row_idx").collect()
    samples = got["results"]["samples"]
    assert samples["names"] == [r.name for r in rows] and samples["scores"] == [[r.PC1, r.PC2] for r in rows]
    metrics = got["results"]["metrics"]
    assert metrics["hotelling_t2"] == [r.t2 for r in rows] and metrics["is_outlier"] == [r.is_outlier for r in rows]
    assert got["preservedColumns"] == {"categorical": {"g": [r.g for r in rows]}, "numericTarget": {"target": [r.target for r in rows]}}
    assert got["diagnostics"] == found.limits
    assert pca.PCAModel.from_json(json.dumps(got)).limits() == found.limits == document.load(spark, path).limits()
    back = document.saved_scores(spark, path, 2).orderBy("position").collect()
    assert [(r.position, r.PC1, r.PC2) for r in back] == [(i, r.PC1, r.PC2) for i, r in enumerate(rows)]
    document.write(found, str(tmp_path / "plain"), metrics=False)
    document.joined(spark, str(tmp_path / "plain"), str(tmp_path / "plain.json"))
    assert document.problems(json.loads((tmp_path / "plain.json").read_text())) == []


@pytest.mark.parametrize("path, value", [("metadata", None), ("metadata.software", None), ("metadata.config.method", None), ("preprocessing.snv", None), ("preprocessing.snv", 1), ("model.loadings", [1.0]), ("model.feature_labels", None), ("results.samples", None), ("results.samples.scores", 3)])
def test_broken_documents_are_named(points, path, value):
    good = pca.fit(points, ["f0", "f1"], 1).document() | {"results": {"samples": {"names": ["a"], "scores": [[1.0]]}}}
    assert document.problems(good) == []
    part = good
    *above, last = path.split(".")
    for key in above:
        part = part[key]
    if value is None:
        del part[last]
    else:
        part[last] = value
    assert document.problems(good)


def test_wide_rows_with_gaps(spark, monkeypatch):
    """By passes and by patterns of gaps alike, and loadings of one true component whatever the gaps."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((200, 6)) @ np.diag([5, 4, 3, 1, 0.7, 0.5]) @ np.linalg.qr(rng.standard_normal((6, 6)))[0]
    x[rng.random(x.shape) < 0.08] = np.nan
    df = _table(spark, x)
    one = pca.fit(df, df.columns, 3, method="nipals", missing="native")
    monkeypatch.setattr(pca, "PATTERNS", 1)
    monkeypatch.setattr(pca, "BLOCK_BYTES", 100)
    two = pca.fit(df, df.columns, 3, method="nipals", missing="native")
    assert np.allclose(one.loadings, two.loadings, atol=1e-6) and np.allclose(one.eigenvalues, two.eigenvalues)
    t, w = rng.standard_normal((100, 1)), rng.random((1, 40)) + 0.5
    x = t @ w
    x[rng.random(x.shape) < 0.1] = np.nan
    x[0] = np.nan
    model = pca.fit(_table(spark, x), [f"c{i}" for i in range(40)], 1, Preprocess(center=False), "nipals", "native")
    assert np.allclose(model.loadings[:, 0], w[0] / np.linalg.norm(w)) and np.allclose(model.eigenvalues[1:], 0)


@pytest.mark.parametrize("scale, center", [("standard", True), ("none", True), ("none", False)])
def test_more_features_than_rows(spark, monkeypatch, scale, center):
    from facetflow.operators import thin

    x = np.random.default_rng(1).standard_normal((12, 40)) + 2
    x[:, 7] = 3.3
    df = _table(spark, x).withColumn("k", F.lit("k"))
    names = df.columns[:-1]
    pre = Preprocess(center=center, scale=scale)
    plain = pca.fit(df, names, 3, pre)
    for module, name, value in ((pca, "MOST_FEATURES", 30), (pca, "EXPRESSIONS", 30), (thin, "CHUNK", 9), (thin, "BLOCK_ROWS", 5)):
        monkeypatch.setattr(module, name, value)
    wide = pca.fit(df, names, 3, pre)
    assert np.allclose(wide.loadings, plain.loadings, atol=1e-7) and np.allclose(wide.eigenvalues, plain.eigenvalues, atol=1e-9) and np.allclose(wide.spread(), plain.spread())
    arrays = df.select(F.array(*names).alias("spectrum"))
    assert np.array_equal(pca.fit_array(arrays, "spectrum", names, 3, pre).loadings, wide.loadings)
    with pytest.raises(ValueError):
        pca.fit_array(arrays.unionByName(arrays.select(F.slice("spectrum", 1, 3).alias("spectrum"))), "spectrum", names, 3, pre)
    got = wide.diagnostics(df).orderBy("PC1").collect()
    monkeypatch.setattr(pca, "EXPRESSIONS", 1024)
    want = plain.diagnostics(df).orderBy("PC1").collect()
    assert wide.transform(df).columns == plain.transform(df).columns
    for c in ("PC1", "PC3", "t2", "rss"):
        assert np.allclose([r[c] for r in got], [r[c] for r in want], atol=1e-6)
    with pytest.raises(ValueError):
        pca.fit(df.withColumn("c1", F.lit(None).cast("double")), names, 2, pre)
    with pytest.raises(ValueError):
        pca.fit(df.limit(1), names, 1, pre)


def test_nearly_collinear_features_keep_small_eigenvalues(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 3)) * [1, 1e-5, 1e-9] @ np.linalg.qr(rng.standard_normal((3, 3)))[0]
    x = x @ np.linalg.qr(rng.standard_normal((3, 3)))[0]
    df = _table(spark, x).repartition(7)
    want = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2 / 299
    assert np.allclose(pca.fit(df, df.columns, 3, exact=True).eigenvalues, want, rtol=1e-5, atol=0)
    assert abs(pca.fit(df, df.columns, 3).eigenvalues[2] / want[2] - 1) > 0.01


@pytest.mark.parametrize("how", [{"kernel": "rbf", "gamma": 0.05}, {"kernel": "linear"}, {"kernel": "poly", "gamma": 0.1, "coef0": 1.0, "degree": 2}])
def test_factored_kernels_agree_with_whole_ones(spark, monkeypatch, how):
    """More rows than are broadcast are fitted by pivots; some of those are no part of the first rows."""
    x = np.random.default_rng(9).standard_normal((400, 2)) * [2, 1]
    df = spark.createDataFrame(x.tolist(), ["a", "b"]).repartition(3)
    whole = kernel.fit(df, df.columns, 3, **how)
    monkeypatch.setattr(kernel, "MOST_ROWS", 25)
    found = kernel.fit(df, df.columns, 3, **how)
    k = len(found.eigenvalues)
    assert len(found.train) < 300 and k == min(3, 2 if how["kernel"] == "linear" else 3)
    assert np.allclose(found.eigenvalues, whole.eigenvalues[:k], rtol=1e-9) and np.allclose(found.ratios, whole.ratios[:k], rtol=1e-7)
    again = kernel.KernelModel.from_json(found.to_json())
    for compat in (False, True):
        one, two, three = (np.array(m.transform(df, compat).orderBy("a", "b").collect())[:, 2 : 2 + k] for m in (whole, found, again))
        assert np.allclose(np.abs(one), np.abs(two), atol=1e-7) and np.array_equal(two, three)


def test_kernels_of_low_rank_in_blocks(spark):
    """What rounding leaves of products is no direction: six copies of a thousand rows, in another order, settle."""
    x = np.tile(np.random.default_rng(3).uniform([-1, 0], [10, 25], (1000, 2)).round(2), (6, 1))
    x = x[np.random.default_rng(1).permutation(len(x))]
    found = kernel.fit(spark.createDataFrame(x.tolist(), ["a", "b"]), ["a", "b"], 2, kernel="linear")
    assert np.allclose(found.eigenvalues, np.linalg.eigvalsh((x - x.mean(0)).T @ (x - x.mean(0)))[::-1], rtol=1e-9)


def test_kernel_totals_of_few_rows(spark):
    """The trace is told whichever way the kernel is made."""
    x = spark.createDataFrame([(float(i), float(i * i % 7)) for i in range(10)], ["a", "b"])
    assert math.isclose(kernel.fit(x, ["a", "b"], 2, local_rows=10).total, kernel.fit(x, ["a", "b"], 2, local_rows=1).total, rel_tol=1e-9)


def test_kernel_matrices_have_no_limit_on_rows(spark, monkeypatch):
    monkeypatch.setattr(kernel, "TASK_PAIRS", 1_000_000)
    df = spark.range(2001).select("id", (F.col("id") % 5).cast("double").alias("x"))
    for most in (10_000, 100):
        monkeypatch.setattr(kernel, "BROADCAST_ROWS", most)
        pairs = kernel.kernel_pairs(df, "id", ["x"], "linear")
        assert pairs.count() == 2001 * 2002 // 2 == pairs.select("i", "j").distinct().count()
        assert math.isclose(kernel.centered(pairs).where("i = 3").agg(F.sum("kc")).first()[0], sum((3 - 2 + 2 / 2001) * (i % 5 - 2 + 2 / 2001) for i in range(3, 2001)), abs_tol=1e-6)


def test_means_of_a_kernel_take_a_row_of_the_matrix_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(kernel, "TASK_PAIRS", 40_000)
    x = pd.DataFrame({"id": range(401), "x": np.random.default_rng(6).standard_normal(401)})
    df = spark.createDataFrame(x)
    made = kernel.kernel_pairs(df, "id", ["x"], gamma=0.5, whole=True).select("i", F.spark_partition_id().alias("at"))
    assert made.count() == 401 * 401 and made.distinct().count() == 401 and made.select("at").distinct().count() > 2
    got = kernel.centered(kernel.kernel_pairs(df, "id", ["x"], gamma=0.5), kernel.row_means(df, "id", ["x"], gamma=0.5)).toPandas()
    whole = np.exp(-0.5 * (x.x.to_numpy()[:, None] - x.x.to_numpy()) ** 2)
    want = whole - whole.mean(0) - whole.mean(0)[:, None] + whole.mean()
    assert len(got) == 401 * 402 // 2 and np.allclose(got.kc, want[got.i, got.j], atol=1e-12)


def test_columns_of_few_values_are_ranked_where_they_are(spark, monkeypatch):
    """One column of many values doesn't put the cells of the others through joins."""
    rng = np.random.default_rng(4)
    x = pd.DataFrame({"a": rng.integers(0, 5, 400).astype(float), "b": rng.standard_normal(400), "c": rng.integers(0, 9, 400).astype(float)})
    x.loc[::7, "c"] = None
    seen, looked_up = [], ranks._looked_up
    monkeypatch.setattr(ranks, "_looked_up", lambda df, columns, low, values: seen.append(low) or looked_up(df, columns, low, values))
    df = spark.createDataFrame(x.assign(i=range(400))).repartition(3)
    got = ranks.mean_ranks(df, ["a", "b", "c"], few=20).toPandas().sort_values("i")
    assert seen == [[0, 2]]
    assert np.allclose(got[["a", "b", "c"]].to_numpy(float), x.rank().to_numpy(), equal_nan=True)


def test_places_of_scores_need_no_window_over_rows(spark, points, tmp_path):
    found = analysis.analyse(points, ["f0", "f1", "f2", "f3"], 2)
    document.write(found, str(tmp_path / "d"))
    scores = document.saved_scores(spark, str(tmp_path / "d"), 2)
    assert "row_number" not in scores._jdf.queryExecution().toString()
    assert [r.position for r in scores.orderBy("position").collect()] == list(range(60))
