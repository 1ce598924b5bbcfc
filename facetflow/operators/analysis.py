"""A whole component analysis in one call: exclusions, missing cells, fit, scores, diagnostics, correlations, ellipses."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetflow.functions.numbers import CHI_SQUARE_2
from facetflow.operators import correlate, kernel, pca, rows, validate
from facetflow.operators.preprocess import Preprocess, scale_ratio


@dataclass
class Analysis:
    """Tables are lazy; ``limits`` and ``overview`` are of the size of the model."""

    model: pca.PCAModel | kernel.KernelModel
    scores: DataFrame
    variance: DataFrame
    loadings: DataFrame | None = None
    limits: dict[str, float] = field(default_factory=dict)
    overview: dict[str, object] = field(default_factory=dict)
    correlations: DataFrame | None = None
    ellipses: DataFrame | None = None


def analyse(
    df: DataFrame, features: list[str], k: int = 2, preprocess: Preprocess | None = None, method: str = "svd", missing: str = "error",
    exclude_rows: str | list[int] = "", exclude_columns: list[str] = (), numeric: list[str] = (), categorical: list[str] = (), group: str | None = None,
    kernel_type: str = "rbf", gamma: float | None = None, degree: int = 3, coef0: float = 0.0, correlation: str = "pearson",
) -> Analysis:
    """Metadata columns (numeric, categorical, group) stay with their rows, so what is dropped is dropped for all of them.

    method: svd, nipals or kernel. Diagnostics, limits and loadings are of linear models only.
    """
    table = rows.exclude(df, exclude_rows, list(exclude_columns) or None)
    features = [c for c in features if c not in exclude_columns]
    if missing == "drop":
        table, missing = rows.drop_missing(table, features), "error"
    elif missing in ("mean", "median", "zero"):
        from facetflow.functions.transforms import impute

        table, missing = impute(table, features, missing), "error"
    if method == "kernel":
        validate.check_kernel(kernel_type, gamma or 0.0, degree)
        fitted = kernel.fit(table, features, k, kernel_type, gamma, degree, coef0, preprocess)
        scores = fitted.transform(table)
        out = Analysis(fitted, scores, fitted.variance(df.sparkSession))
    else:
        model = pca.fit(table, features, k, preprocess, method, missing)
        scores = model.diagnostics(table)
        out = Analysis(model, scores, model.variance(df.sparkSession), model.loading_rows(df.sparkSession), model.limits(), model.overview())
        out.overview["scale_ratio"] = scale_ratio(table, features)
        if (preprocess or Preprocess()).scale == "none" and (out.overview["scale_ratio"] or 1) > 100:
            out.overview["warning"] = "the features' variances differ widely; scale them"
    labels = [c for c in scores.columns if c in {f"PC{i + 1}" for i in range(k)}]
    if numeric or categorical:
        out.correlations = correlate.eigencorrelations(scores, labels, list(numeric), list(categorical), correlation)
    if group and len(labels) > 1:
        out.ellipses = ellipses_at_levels(scores, group, list(combinations(labels, 2)))
    return out


def ellipses_at_levels(scores: DataFrame, group: str, pairs: list[tuple[str, str]], levels: tuple[float, ...] = (0.90, 0.95, 0.99), required: bool = False) -> DataFrame:
    """group, x, y, level and the ellipse of each group, pair of components and level; groups without one are left out.

    The sizes grow with the level and nothing else does, so each pair takes one aggregate. required: none at all raises.
    """
    out = None
    for x, y in pairs:
        one = correlate.ellipses(scores, group, x, y, levels[0])
        factor = F.explode(F.array(*[F.struct(F.lit(v).alias("level"), F.lit((CHI_SQUARE_2[v] / CHI_SQUARE_2[levels[0]]) ** 0.5).alias("by")) for v in levels])).alias("f")
        own = one.select("*", factor).select(group, F.lit(x).alias("x"), F.lit(y).alias("y"), "f.level", "n", "center_x", "center_y", (F.col("major") * F.col("f.by")).alias("major"), (F.col("minor") * F.col("f.by")).alias("minor"), "angle")
        out = own if out is None else out.unionByName(own)
    if out is None or (required and out.isEmpty()):
        raise ValueError("no group has an ellipse")
    return out


def eigenvalues_from_scores(scores: DataFrame, labels: list[str]) -> DataFrame:
    """pc, eigenvalue: sums of squared scores by n - 1."""
    s = scores.agg(*[(F.sum(F.col(p) * F.col(p)) / (F.count(p) - 1)).alias(p) for p in labels])
    return s.select(F.explode(F.array(*[F.struct(F.lit(p).alias("pc"), F.col(p).alias("eigenvalue")) for p in labels])).alias("x")).select("x.*")


def score_covariance(scores: DataFrame, labels: list[str], ridge: float = 0.0) -> DataFrame:
    """a, b, covariance of the scores (n - 1), with the ridge on the diagonal."""
    pairs = [(a, b) for i, a in enumerate(labels) for b in labels[i:]]
    s = scores.agg(*[(F.covar_samp(a, b) + (ridge if a == b else 0.0)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return s.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("covariance")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def report(found: Analysis) -> dict[str, DataFrame]:
    """Tables for a console: the first and last scores, loadings by component, variance and limits."""
    labels = [c for c in found.scores.columns if c.startswith("PC") and c[2:].isdigit()]
    scores = found.scores.select(*[c for c in ("row_idx", "row_name") if c in found.scores.columns], *labels)
    out = {"scores": rows.head_and_tail(scores) if "row_idx" in scores.columns else scores.limit(20), "variance": found.variance}
    if found.loadings is not None:
        of = [F.max(F.when(F.col("pc") == p, F.col("value"))).alias(p) for p in labels]
        out["loadings"] = found.loadings.groupBy("feature_idx", "feature").agg(*of).orderBy("feature_idx").drop("feature_idx")
        out["limits"] = found.variance.sparkSession.createDataFrame(list(found.limits.items()), "name string, value double")
    return out


def save(found: Analysis, path: str, description: str = "") -> None:
    """The model as JSON, and scores with all preserved columns, loadings, correlations and ellipses as Parquet, below ``path``.

    Scores stay distributed; the JSON holds what has the size of the model.
    """
    spark = found.scores.sparkSession
    text = found.model.to_json(description) if isinstance(found.model, pca.PCAModel) else found.model.to_json()
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/model")
    for name in ("scores", "variance", "loadings", "correlations", "ellipses"):
        table = getattr(found, name)
        if table is not None:
            table.write.parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str) -> pca.PCAModel | kernel.KernelModel:
    text = "".join(r["value"] for r in spark.read.text(f"{path}/model").collect())  # one line
    return kernel.KernelModel.from_json(text) if '"kind": "kernel"' in text[:40] else pca.PCAModel.from_json(text)
