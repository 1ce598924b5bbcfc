"""Fits, ingestion, edits and diagnostics on small inputs."""

import math
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from facetflow.functions import numbers, transforms
from facetflow.operators import analysis, correlate, edits, kernel, pca, profile, quantiles, rows, validate, views
from facetflow.operators.preprocess import Preprocess
from facetflow.plans import checks
from facetflow.sources import tables
from facetflow.streaming import scoring

POINTS = [(2.5, 2.4), (0.5, 0.7), (2.2, 2.9), (1.9, 2.2), (3.1, 3.0), (2.3, 2.7), (2.0, 1.6), (1.0, 1.1), (1.5, 1.6), (1.1, 0.9)]


def _frame(spark, x):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row_idx long, " + ", ".join(f"f{j} double" for j in range(len(x[0]))))


@pytest.mark.parametrize("m", [2, 5, 60])
def test_fit_agrees_with_a_direct_decomposition(spark, m):
    x = np.random.default_rng(m).normal(size=(120, m)) * np.arange(1, m + 1) + 100
    df, names = _frame(spark, x.tolist()), [f"f{j}" for j in range(m)]
    model = pca.fit(df, names, min(3, m))
    c = x - x.mean(0)
    s = np.linalg.svd(c, compute_uv=False)
    assert np.allclose(model.eigenvalues, s**2 / 119)
    assert np.allclose(model.loadings.T @ model.loadings, np.eye(model.k))
    if m <= 5:
        got = np.array([[r[p] for p in model.labels] for r in model.transform(df).orderBy("row_idx").collect()])
        assert np.allclose(got, c @ model.loadings)


def test_full_rank_leaves_no_residual_and_models_survive_json(spark):
    df = _frame(spark, POINTS)
    model = pca.fit(df, ["f0", "f1"], 2, Preprocess(scale="standard"))
    again = pca.PCAModel.from_json(model.to_json())
    for m in (model, again):
        got = m.diagnostics(df).orderBy("row_idx").collect()
        assert all(r.rss < 1e-10 and math.isclose(r.mahalanobis**2, r.t2, abs_tol=1e-12) for r in got)
    assert model.q_limit(0.95) == 0 and 0 < model.t2_limit(0.95) < model.t2_limit(0.99)
    with pytest.raises(ValueError):
        pca.PCAModel.from_json('{"model": {}}')
    with pytest.raises(ValueError):
        model.transform(df.drop("f1"))


def test_incomplete_rows(spark):
    x = [list(map(float, r)) for r in np.random.default_rng(1).normal(size=(40, 2)) @ np.array([[3, 1, 2, 1], [0, 1, -1, 2]])]
    full = pca.fit(_frame(spark, x), [f"f{j}" for j in range(4)], 2, method="nipals")
    df = _frame(spark, x).withColumn("f1", F.when(F.col("row_idx") != 3, F.col("f1")))
    names = [f"f{j}" for j in range(4)]
    with pytest.raises(ValueError):
        pca.fit(df, names, 2)
    model = pca.fit(df, names, 2, method="nipals", missing="native")
    assert np.allclose(np.linalg.norm(model.loadings, axis=0), 1)
    assert np.allclose(np.abs(model.loadings[:, 0]), np.abs(full.loadings[:, 0]), atol=0.05)
    assert pca.fit(df, names, 2, missing="drop").rows == 39


def test_kernel_scores(spark):
    df = _frame(spark, POINTS)
    model = kernel.fit(df, ["f0", "f1"], 2, kernel="linear")
    linear = pca.fit(df, ["f0", "f1"], 2)
    got = np.array([[r.PC1, r.PC2] for r in model.transform(df).orderBy("row_idx").collect()])
    want = np.array([[r.PC1, r.PC2] for r in linear.transform(df).orderBy("row_idx").collect()])
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-8)
    with pytest.raises(ValueError):
        kernel.fit(df, ["f0"], 1, kernel="sigmoid")


def test_quantiles():
    assert math.isclose(numbers.f_quantile(0.95, 3, 97), 2.698, abs_tol=2e-3)
    assert math.isclose(numbers.f_quantile(0.99, 1, 10), 10.044, abs_tol=2e-3)
    assert numbers.correlation_p_value(0.5, 2) == 0 and 0 < numbers.correlation_p_value(0.5, 40) < 0.01


def test_ranges():
    assert rows.parse_ranges("1,3-5, 4-7") == [(0, 0), (2, 6)]
    for bad in ("0", "5-2", "x"):
        with pytest.raises(ValueError):
            rows.parse_ranges(bad)


def test_fills_cross_ranges(spark, monkeypatch):
    monkeypatch.setattr(rows, "RANGE_ROWS", 3)
    monkeypatch.setattr(rows, "RANGES", 100)
    values = [None, 1.0, None, None, None, None, None, 2.0, None, None]
    df = spark.createDataFrame(list(enumerate(values)), "row_idx long, x double")
    ahead = [r.x for r in rows.fill(df, ["x"]).orderBy("row_idx").collect()]
    back = [r.x for r in rows.fill(df, ["x"], "backward").orderBy("row_idx").collect()]
    assert ahead == [None, 1, 1, 1, 1, 1, 1, 2, 2, 2] and back == [1, 1, 2, 2, 2, 2, 2, 2, None, None]
    got = [r.row_idx for r in edits.delete_rows([0, 4, 9])(df).orderBy("row_idx").collect()]
    assert got == list(range(7))


@pytest.mark.parametrize(("gone", "pattern"), [([0, 1], "top"), ([8, 9], "bottom"), ([1, 4, 7], "systematic"), ([1, 2, 7], "random"), ([], "none")])
def test_missing_patterns(spark, gone, pattern):
    df = spark.createDataFrame([(i, None if i in gone else 1.0) for i in range(10)], "row_idx long, x double")
    assert rows.missing_pattern(df, ["x"]).first().pattern == pattern


def test_files_in_and_out(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("id;a;b;c#target\n" + "".join(f"r{i};{i},5;{'x' if i % 2 else 'NA'};{i}\n" for i in range(30)))
    options = tables.sniff(spark, str(path))
    assert (options.delimiter, options.decimal, options.header) == (";", ",", True)
    df = tables.read_mixed(spark, str(path), options)
    assert tables.features(df) == ["a"]
    got = df.orderBy("row_idx").collect()
    assert [r.row_idx for r in got] == list(range(30)) and got[3].a == 3.5 and got[2].b is None and got[4]["c#target"] == 4
    tables.write_csv(df, str(tmp_path / "out"), tables.EUROPEAN)
    assert tables.read_mixed(spark, str(tmp_path / "out"), tables.EUROPEAN).count() == 30
    with pytest.raises(ValueError):
        tables.read_numeric(spark, str(path), options)


def test_strict_transforms_raise(spark):
    df = spark.createDataFrame([(-1.0,)], "x double")
    for kind in ("log", "sqrt"):
        with pytest.raises(Exception, match=kind):
            df.select(transforms.strict(kind, "x")).collect()
    assert transforms.apply(df, "minmax", ["x", "y"])[1] == ["no column y"]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "row_idx long, x double, y double, g string")
    assert correlate.ellipses(df, "g", "x", "y").collect() == []
    assert views.density(df, "x", "y").collect() == [] and profile.histogram(df, "x").collect() == []
    assert rows.average_rank(df, "x").collect() == [] and rows.fill(df, ["x"]).collect() == []
    assert validate.readiness(df, ["x", "y"])[0][0] == "ERROR"
    assert correlate.pearson_matrix(df, ["x", "y"]).first().r == 0


def test_history(spark):
    h = edits.History(_frame(spark, POINTS))
    h.do("set", edits.set_cell(0, "f0", 9.0))
    h.do("insert", edits.insert_row(1, f0=7.0))
    assert h.table.count() == 11 and h.undo().count() == 10 and h.table.where("row_idx = 0").first().f0 == 9.0
    assert h.undo().where("row_idx = 0").first().f0 == 2.5 and h.redo().where("row_idx = 0").first().f0 == 9.0


def test_streams_are_scored(spark, tmp_path):
    df = _frame(spark, POINTS)
    model = pca.fit(df, ["f0", "f1"], 1)
    df.write.parquet(str(tmp_path / "in"))
    stream = scoring.scored(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), model)
    scoring.write(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    got = {r.row_idx: r.t2 for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.row_idx: r.t2 for r in model.diagnostics(df).collect()}


@pytest.mark.parametrize("lower", [False, True])
def test_quantiles_of_long_tables_are_those_of_short_ones(spark, lower, monkeypatch):
    monkeypatch.setattr(quantiles, "FEW", 50)
    rng = np.random.default_rng(3)
    x = np.where(rng.random(5000) < 0.4, 0.0, rng.normal(size=5000).round(2))
    df = spark.createDataFrame([(float(v), None if i % 3 else float(i % 7)) for i, v in enumerate(x)], "x double, y double")
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    assert quantiles.exact_quantiles(df, ["x", "y"], probabilities, lower, built_in=0) == pytest.approx(np.array(quantiles.exact_quantiles(df, ["x", "y"], probabilities, lower)))
    assert quantiles.exact_mode(df, "x") == 0.0 and quantiles.exact_mode(df, "y") == 0.0


def test_spectra_of_a_thousand_wavelengths(spark):
    x = np.random.default_rng(5).normal(size=(60, 1000)) + np.linspace(0, 3, 1000)
    names = [f"w{i}" for i in range(1000)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names)).repartition(3)
    model = pca.fit(df, names, 3, Preprocess(snv=True))
    z = (x - x.mean(1, keepdims=True)) / x.std(1, ddof=1, keepdims=True)
    s = np.linalg.svd(z - z.mean(0), compute_uv=False)
    assert np.allclose(model.eigenvalues[:59], s[:59] ** 2 / 59)


def test_incomplete_rows_leave_residual_variance_and_have_scores(spark):
    x = np.random.default_rng(8).normal(size=(50, 4)) @ np.diag([4, 2, 1, 0.5])
    names = [f"f{j}" for j in range(4)]
    df = _frame(spark, x.tolist()).withColumn("f2", F.when(F.col("row_idx") % 9 != 0, F.col("f2")))
    model = pca.fit(df, names, 2, method="nipals", missing="native")
    assert len(model.eigenvalues) == 4 and 0 < model.ratios.sum() < 100 and model.q_limit(0.95) > 0
    scored = model.diagnostics(df)
    assert scored.where("PC1 is null or PC2 is null or t2 is null or rss is null").count() == 0
    s = scored.agg(*[(F.sum(F.col(p) * F.col(p)) / 49).alias(p) for p in model.labels]).first()
    assert np.allclose([s[p] for p in model.labels], model.eigenvalues[:2])
    assert pca.PCAModel.from_json(model.to_json()).transform(df).where("PC1 is null").count() == 0


def test_hot_values_are_ranked_like_others(spark, monkeypatch):
    monkeypatch.setattr(rows, "HOT", 3)
    monkeypatch.setattr(rows, "SHARED", 20)
    values = [0.0] * 50 + [float(i % 17) for i in range(100)] + [None]
    df = spark.createDataFrame(list(enumerate(values)), "row_idx long, x double")
    got = {r.row_idx: r["rank"] for r in rows.average_rank(df, "x").collect()}
    known = sorted(v for v in values if v is not None)
    assert len(got) == len(values)
    for i, v in enumerate(values):
        assert got[i] == (None if v is None else (known.index(v) + 1 + len(known) - known[::-1].index(v)) / 2)


def test_conventions_are_tried_in_turn(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("n;a\n" + "".join(f"r{i};{i},25\n" for i in range(5)))
    assert tables.features(tables.read_any(spark, str(path))) == ["a"]
    assert tables.file_format(spark, str(path)) == "csv"


def test_all_groups_without_ellipses_raise(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0)], "g string, x double, y double")
    assert analysis.ellipses_at_levels(df, "g", [("x", "y")]).count() == 0
    with pytest.raises(ValueError):
        analysis.ellipses_at_levels(df, "g", [("x", "y")], required=True)


def test_analyses_by_kernel(spark):
    found = analysis.analyse(_frame(spark, POINTS), ["f0", "f1"], 2, method="kernel", kernel_type="linear")
    assert found.scores.count() == 10 and found.variance.count() == 2
    with pytest.raises(ValueError):
        analysis.analyse(_frame(spark, POINTS), ["f0"], 1, method="kernel", kernel_type="sigmoid")


def test_patterns_and_rounds_agree(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(60, 5)) @ np.diag([5, 3, 2, 1, 1])
    names = [f"f{j}" for j in range(5)]
    df = _frame(spark, x.tolist()).withColumn("f1", F.when(F.col("row_idx") % 7 != 0, F.col("f1"))).withColumn("f3", F.when(F.col("row_idx") % 5 != 1, F.col("f3")))
    one = pca.fit(df, names, 2, method="nipals", missing="native")
    monkeypatch.setattr(pca, "PATTERNS", 1)
    other = pca.fit(df, names, 2, method="nipals", missing="native")
    assert np.allclose(one.loadings, other.loadings, atol=1e-6) and np.allclose(one.eigenvalues, other.eigenvalues)


def test_analyses_are_saved_and_loaded(spark, tmp_path):
    df = _frame(spark, POINTS).withColumn("g", F.when(F.col("row_idx") % 2 == 0, "a").otherwise("b"))
    found = analysis.analyse(df, ["f0", "f1"], 2, group="g", categorical=["g"])
    assert {k: v.count() for k, v in analysis.report(found).items()} == {"scores": 10, "variance": 2, "loadings": 2, "limits": 4}
    analysis.save(found, str(tmp_path / "a"))
    again = analysis.load_model(spark, str(tmp_path / "a"))
    assert np.allclose(again.loadings, found.model.loadings)
    assert spark.read.parquet(str(tmp_path / "a" / "scores")).columns == found.scores.columns


def test_refused_files_of_several_parts(spark):
    """Each part has the header, and its rows of one cell are told from it; names of columns may hold dots."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted(r.refused for r in checks.refused_csv(spark, "/root/testdata/sf0.01").collect()) == ["ragged", "text"]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_names_with_dots_are_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("51.99,b.c\n1,2\n3,4\n")
    plain = replace(tables.DEFAULT, row_names=False)
    assert [tuple(r) for r in tables.read_numeric(spark, str(tmp_path), plain).orderBy("row_idx").collect()] == [(0, 1.0, 2.0), (1, 3.0, 4.0)]
    assert [tuple(r) for r in tables.read_mixed(spark, str(tmp_path), plain).orderBy("row_idx").collect()] == [(0, 1.0, 2.0), (1, 3.0, 4.0)]


def test_fills_do_not_begin_anew_at_each_row(spark):
    """A window that ends at the end of its rows is worked out anew for each row, so its cost grows with their square."""
    df = spark.createDataFrame([(0, None), (1, 2.0)], "row_idx long, x double")
    for direction in ("forward", "backward"):
        assert "unboundedfollowing" not in rows.fill(df, ["x"], direction)._jdf.queryExecution().toString().lower()
