"""Linear principal component analysis: fit, scores, diagnostics, limits, and models as JSON.

A fit is one pass over the features for counts, means and co-moments, from which the moments of the preprocessed features
follow (robust scaling also asks for medians), and an eigendecomposition of features x features on the driver. Up to
DECLARED features the pass is one declarative aggregate; beyond, each task adds up its rows' products, and the sums meet
as binary blocks of matrix rows, so that what is gathered is one matrix of doubles. Scores, T^2 and residuals are
projections: lazy, without Python, and as good on streams.

Components are given the sign that makes their largest loading positive (within 1e-9 the first feature counts).
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, field, replace
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from facetflow.functions.numbers import f_quantile, normal_quantile
from facetflow.operators.preprocess import DIVISOR, SHIFT, Preprocess, total
from facetflow.operators.thin import dual, triangular
from facetflow.sources.scratch import for_a_while

#: Features up to which the Gram matrix is a declarative aggregate, and at most.
DECLARED, MOST_FEATURES = 16, 8192
#: Features up to which scores are expressions.
EXPRESSIONS = 1024
#: Bytes of a block of matrix rows.
BLOCK_BYTES = 1 << 20
#: Patterns of gaps whose sums are gathered, at most.
PATTERNS = 2048
ALPHA = 0.001
VERSION = "1.0"


@dataclass
class Moments:
    """Of a table's features: rows, how many values each has, means and sums of products of deviations (complete rows)."""

    rows: int
    counts: np.ndarray
    means: np.ndarray
    products: np.ndarray

    @property
    def complete(self) -> bool:
        return bool((self.counts == self.rows).all())


def moments(df: DataFrame, parts: list[Column]) -> Moments:
    """Moments of the columns in one pass; only those of complete tables are meaningful, ``counts`` tell."""
    m = len(parts)
    if m > MOST_FEATURES:
        raise ValueError(f"{m} features; at most {MOST_FEATURES}")
    if m <= DECLARED:
        x = df.select(*[p.alias(f"x{i}") for i, p in enumerate(parts)])
        cells = [(i, j) for i in range(m) for j in range(i, m)]
        s = x.agg(F.count(F.lit(1)).alias("n"), *[f(f"x{i}").alias(f"{k}{i}") for i in range(m) for k, f in (("c", F.count), ("m", F.avg))], *[F.covar_pop(f"x{i}", f"x{j}").alias(f"g{i}_{j}") for i, j in cells]).first()
        products = np.zeros((m, m))
        for i, j in cells:
            products[i, j] = products[j, i] = s["n"] * (s[f"g{i}_{j}"] or 0.0)
        return Moments(s["n"], np.array([s[f"c{i}"] for i in range(m)]), np.array([s[f"m{i}"] or 0.0 for i in range(m)], float), products)
    return _wide_moments(df.select(F.array(*parts).alias("x")), m)


def _wide_moments(x: DataFrame, m: int) -> Moments:
    """Of an array column."""
    return gathered_moments(x, m, lambda batch: [batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, m)])


def gathered_moments(x: DataFrame, m: int, of: Callable[[pa.RecordBatch], Iterable[np.ndarray]]) -> Moments:
    """Of matrices that ``of`` makes of a batch: each task merges its own, and blocks of rows of the sums are merged by block."""
    step = max(1, BLOCK_BYTES // (8 * m))
    kind = "block int, n long, counts binary, means binary, products binary"
    schema = pa.schema([("block", pa.int32()), ("n", pa.int64()), ("counts", pa.binary()), ("means", pa.binary()), ("products", pa.binary())])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, counts, means, sums = 0, np.zeros(m), np.zeros(m), np.zeros((m, m))
        for v in (v for batch in batches for v in of(batch)):
            counts += (~np.isnan(v)).sum(0)
            mean = v.mean(0) if len(v) else means
            n, means, sums = _met(n, means, sums, len(v), mean, (v - mean).T @ (v - mean))
        for b, i in enumerate(range(0, m, step)):
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((b, n, counts.tobytes(), means.tobytes(), sums[i : i + step].tobytes()), schema, strict=True)], schema=schema)

    def meet(table: pa.Table) -> pa.Table:
        b = table.column("block")[0].as_py()
        rows = slice(b * step, (b + 1) * step)
        n, counts, means, sums = 0, np.zeros(m), np.zeros(m), np.zeros((min(step, m - b * step), m))
        for k, c, mu, raw in zip(*[table.column(x).to_pylist() for x in ("n", "counts", "means", "products")], strict=True):
            counts = counts + np.frombuffer(c)
            n, means, sums = _met(n, means, sums, k, np.frombuffer(mu), np.frombuffer(raw).reshape(-1, m), rows)
        return pa.table([pa.array([x], f.type) for x, f in zip((b, n, counts.tobytes(), means.tobytes(), sums.tobytes()), schema, strict=True)], schema=schema)

    found = x.mapInArrow(products, kind).groupBy("block").applyInArrow(meet, kind).orderBy("block").collect()  # one m x m matrix
    if not found:
        return Moments(0, np.zeros(m), np.zeros(m), np.zeros((m, m)))
    return Moments(found[0]["n"], np.frombuffer(found[0]["counts"]), np.frombuffer(found[0]["means"]), np.concatenate([np.frombuffer(r["products"]).reshape(-1, m) for r in found]))


def _met(n: int, means: np.ndarray, sums: np.ndarray, k: int, mean: np.ndarray, own: np.ndarray, rows: slice = slice(None)) -> tuple[int, np.ndarray, np.ndarray]:
    """Moments of two sets of rows together."""
    if not k or not n:
        return (k, mean, own) if k else (n, means, sums)
    apart = mean - means
    return n + k, means + apart * (k / (n + k)), sums + own + np.outer(apart[rows], apart) * (n * k / (n + k))


def signed(vectors: np.ndarray) -> np.ndarray:
    """Columns turned so that the first of their largest entries is positive."""
    size = np.abs(vectors)
    lead = np.argmax(size >= size.max(axis=0) - 1e-9, axis=0)
    return vectors * np.where(vectors[lead, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


@dataclass
class PCAModel:
    """Loadings (features x k), all eigenvalues, and what scoring and the limits need."""

    preprocess: Preprocess
    loadings: np.ndarray
    eigenvalues: np.ndarray
    rows: int
    method: str = "svd"
    score_cov: np.ndarray | None = None
    extra: dict = field(default_factory=dict)

    @property
    def features(self) -> tuple[str, ...]:
        return self.preprocess.features

    @property
    def k(self) -> int:
        return self.loadings.shape[1]

    @property
    def labels(self) -> list[str]:
        return [f"PC{i + 1}" for i in range(self.k)]

    @property
    def ratios(self) -> np.ndarray:
        """Shares of the total variance in per cent."""
        whole = self.eigenvalues.sum()
        return 100 * self.eigenvalues[: self.k] / whole if whole > 0 else np.zeros(self.k)

    def variance(self, spark: SparkSession) -> DataFrame:
        """pc, eigenvalue, ratio_pct, cumulative_pct."""
        rows = zip(self.labels, self.eigenvalues[: self.k], self.ratios, np.cumsum(self.ratios), strict=True)
        return spark.createDataFrame([(p, float(e), float(r), float(c)) for p, e, r, c in rows], "pc string, eigenvalue double, ratio_pct double, cumulative_pct double")

    def loading_rows(self, spark: SparkSession) -> DataFrame:
        """feature_idx, feature, pc, value, correlation (loading * sqrt(eigenvalue) / deviation of the fitted feature)."""
        spread = self.spread()
        rows = []
        for j, f in enumerate(self.features):
            for i, p in enumerate(self.labels):
                value = float(self.loadings[j, i])
                rows.append((j, f, p, value, float(value * math.sqrt(max(self.eigenvalues[i], 0)) / spread[j]) if spread[j] > 0 else None))
        return spark.createDataFrame(rows, "feature_idx int, feature string, pc string, value double, correlation double")

    def spread(self) -> np.ndarray:
        """Deviations of the features as they were fitted, about zero where they weren't centred."""
        if "spread" in self.extra:
            return np.asarray(self.extra["spread"], float)
        pre = self.preprocess
        if self.extra.get("incomplete") or len(pre.deviations) != len(self.features) or len(pre.means) != len(self.features) or self.rows < 2:
            raise ValueError("the model doesn't tell the deviations of its features")
        shift, scale = np.array(pre.shifts_and_scales()).T
        apart = np.array(pre.means) - shift
        return np.sqrt(np.array(pre.deviations) ** 2 + apart**2 * (self.rows / (self.rows - 1))) / scale

    def score_columns(self) -> list[Column]:
        x = self.preprocess.expressions()
        return [total([x[j] * float(self.loadings[j, i]) for j in range(len(x))]) for i in range(self.k)]

    def aligned(self, df: DataFrame) -> DataFrame:
        missing = [f for f in self.features if f not in df.columns]
        if missing:
            raise ValueError(f"features are missing: {missing}")
        return df

    def _projected(self, df: DataFrame) -> DataFrame:
        """``df`` prepared, with the scores.

        Models of incomplete tables regress each row on the cells that are there, a component after the other.
        """
        df = self.preprocess.prepared(self.aligned(df))
        if self.by_arrays:
            return self._projected_arrays(df)
        if not self.extra.get("incomplete"):
            return df.withColumns(dict(zip(self.labels, self.score_columns(), strict=True)))
        cells = self.preprocess.expressions()
        names = [f"__x{j}" for j in range(len(cells))]
        df = df.withColumns({n: F.when(~F.isnan(c), c) for n, c in zip(names, cells, strict=True)})
        for i, p in enumerate(self.labels):
            w = self.loadings[:, i]
            top = total([F.coalesce(F.col(n) * float(v), F.lit(0.0)) for n, v in zip(names, w, strict=True)])
            under = total([F.when(F.col(n).isNotNull(), float(v * v)).otherwise(0.0) for n, v in zip(names, w, strict=True)])
            df = df.withColumn(p, F.coalesce(F.try_divide(top, under), F.lit(0.0))).withColumns({n: F.col(n) - F.col(p) * float(v) for n, v in zip(names, w, strict=True)})
        return df

    @property
    def by_arrays(self) -> bool:
        """Whether rows are scored as arrays, as expressions of many features take longer to plan than to compute."""
        return len(self.features) > EXPRESSIONS and not self.extra.get("incomplete")

    def _projected_arrays(self, df: DataFrame) -> DataFrame:
        """``df`` with the scores and ``__rss``, from one product a batch; null where a feature is."""
        shift, scale = np.array(self.preprocess.shifts_and_scales()).T
        sent, m, labels, width = df.sparkSession.sparkContext.broadcast((shift, scale, self.loadings)), len(self.features), self.labels, len(df.columns)
        given = df.withColumn("__x", F.array(*[F.coalesce(c, F.lit(float("nan"))) for c in self.preprocess.rows(self.features)]))
        schema = StructType([*df.schema.fields, *[StructField(c, DoubleType()) for c in (*labels, "__rss")]])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shift, scale, loadings = sent.value
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    b = whole.slice(at, 512)
                    x = (b.column(width).flatten().to_numpy(zero_copy_only=False).reshape(-1, m) - shift) / scale
                    t = x @ loadings
                    rest = x - t @ loadings.T
                    yield pa.RecordBatch.from_arrays([*b.columns[:width], *[pa.array(c, from_pandas=True) for c in (*t.T, (rest * rest).sum(1))]], names=schema.names)

        return given.mapInArrow(run, schema)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with PC1 to PCk; a row with a null feature gets null scores, unless the model is of incomplete rows.

        Order and further columns don't matter.
        """
        return self._projected(df).drop(SHIFT, DIVISOR, "__rss", *([] if self.by_arrays else [f"__x{j}" for j in range(len(self.features))]))

    def diagnostics(self, df: DataFrame) -> DataFrame:
        """transform(), t2, mahalanobis, rss (of preprocessed features) and is_outlier (T^2 beyond its 99.9 % limit)."""
        out = self._projected(df)
        inverse = self.inverse_covariance()
        t = [F.col(p) for p in self.labels]
        t2 = total([t[i] * t[j] * float(inverse[i, j]) for i in range(self.k) for j in range(self.k)])
        if self.by_arrays:
            out = out.withColumns({"t2": t2, "rss": F.col("__rss")}).drop("__rss")
            rest = None
        elif self.extra.get("incomplete"):
            rest = [F.coalesce(F.col(f"__x{j}"), F.lit(0.0)) for j in range(len(self.features))]
        else:
            x = self.preprocess.expressions()
            rest = [x[j] - total([t[i] * float(self.loadings[j, i]) for i in range(self.k)]) for j in range(len(x))]
        if rest is not None:
            out = out.withColumns({"t2": t2, "rss": total([r * r for r in rest])}).drop(*[f"__x{j}" for j in range(len(self.features))])
        out = out.drop(SHIFT, DIVISOR)
        limit = self.t2_limit(1 - ALPHA)
        return out.withColumns({"mahalanobis": F.sqrt(F.greatest("t2", F.lit(0.0))), "is_outlier": F.col("t2") > limit if limit > 0 else F.lit(False)})

    def inverse_covariance(self) -> np.ndarray:
        """Inverse of the scores' covariance with a ridge of 1e-4 (1e-3 for more than half as many components as rows)."""
        cov = self.score_cov if self.score_cov is not None else np.diag(self.eigenvalues[: self.k])
        ridge = 1e-3 if self.k > self.rows // 2 else 1e-4
        try:
            return np.linalg.inv(cov + ridge * np.eye(self.k))
        except np.linalg.LinAlgError:
            return np.linalg.inv(cov + 11 * ridge * np.eye(self.k))

    def t2_limit(self, level: float) -> float:
        n, p = self.rows, self.k
        return p * (n - 1) / (n - p) * f_quantile(level, p, n - p) if n > p else 0.0

    def q_limit(self, level: float) -> float:
        """Jackson and Mudholkar's limit of the residual sum of squares; 0 without residual variance."""
        rest = self.eigenvalues[self.k :]
        a, b, c = (float((rest**i).sum()) for i in (1, 2, 3))
        if a <= 0 or b <= 0:
            return 0.0
        h = 1 - 2 * a * c / (3 * b * b)
        term = normal_quantile(level) * math.sqrt(max(2 * b * h, 0)) / a + 1 + b * h * (h - 1) / a**2 if h else 0.0
        return a * term ** (1 / h) if term > 0 and h else 0.0

    def limits(self) -> dict[str, float]:
        return {"t2_limit_95": self.t2_limit(0.95), "t2_limit_99": self.t2_limit(0.99), "q_limit_95": self.q_limit(0.95), "q_limit_99": self.q_limit(0.99)}

    def overview(self) -> dict[str, object]:
        """Leading feature of each component, components for 80 %, and components of an eigenvalue of 1 or more."""
        cumulative = np.cumsum(100 * self.eigenvalues / max(self.eigenvalues.sum(), 1e-300))
        return {
            "leading": {p: self.features[int(np.argmax(np.abs(self.loadings[:, i]) >= np.abs(self.loadings[:, i]).max() - 1e-9))] for i, p in enumerate(self.labels)},
            "components_80": int(np.searchsorted(cumulative, 80 - 1e-9)) + 1,
            "kaiser": max(1, int((self.eigenvalues >= 1).sum())) if self.preprocess.scale == "standard" else None,
        }

    def to_json(self, description: str = "", software: str = "facetflow") -> str:
        return json.dumps(self.document(description, software))

    def document(self, description: str = "", software: str = "facetflow") -> dict:
        """The model as the parts of a document; results are those of operators.document."""
        pre = self.preprocess
        return {
            "metadata": {"software": software, "analysis_id": str(uuid.uuid4()), "software_version": VERSION, "created_at": datetime.now(UTC).isoformat(), "description": description, "config": {"method": self.method, "n_components": self.k, "missing_strategy": "native" if self.extra.get("incomplete") else "error"}},
            "preprocessing": {
                "mean_center": pre.center, "standard_scale": pre.scale == "standard", "robust_scale": pre.scale == "robust", "scale_only": pre.scale_only, "snv": pre.snv, "vector_norm": pre.vector_norm,
                "parameters": {"feature_means": pre.means, "feature_stddevs": pre.deviations, "feature_medians": pre.medians, "feature_mads": pre.mads},
            },
            "model": {
                "loadings": self.loadings.tolist(), "explained_variance": self.eigenvalues[: self.k].tolist(), "explained_variance_ratio": self.ratios.tolist(), "cumulative_variance": np.cumsum(self.ratios).tolist(),
                "component_labels": self.labels, "feature_labels": list(self.features), "eigenvalues": self.eigenvalues.tolist(), "n_samples": self.rows, "score_covariance": None if self.score_cov is None else self.score_cov.tolist(),
                "feature_spread": self.spread().tolist(),
            },
            "diagnostics": self.limits(),
        }

    @staticmethod
    def from_json(text: str) -> PCAModel:
        """The model of a document, of this library or of another with the same fields.

        The number of rows is that of the model or else of the results' samples. With the kept eigenvalues alone, what the
        ratios leave is spread evenly over the rest. Raises ValueError for what scores or limits need and the text lacks.
        """
        d = json.loads(text)
        missing = [f"{a}.{b}" for a, b in (("preprocessing", "parameters"), ("model", "loadings"), ("model", "feature_labels"), ("model", "explained_variance"), ("metadata", "config")) if b not in d.get(a, {})]
        if missing:
            raise ValueError(f"not a model, without {missing}")
        if d["metadata"]["config"].get("method") == "kernel":
            raise ValueError("a document of a kernel model holds no training rows to score with")
        p, m = d["preprocessing"], d["model"]
        of = {k: tuple(v or ()) for k, v in p["parameters"].items()}
        scale = "robust" if p.get("robust_scale") else "standard" if p.get("standard_scale") else "none"
        pre = Preprocess(p.get("mean_center", False), scale, p.get("scale_only", False), p.get("snv", False), p.get("vector_norm", False), tuple(m["feature_labels"]), of.get("feature_means", ()), of.get("feature_stddevs", ()), of.get("feature_medians", ()), of.get("feature_mads", ()))
        loadings = np.array(m["loadings"], float)
        if len(loadings) != len(pre.features) or (scale == "robust" and len(pre.medians) != len(pre.features)) or len(pre.deviations) != len(pre.features):
            raise ValueError("loadings, features and fitted parameters don't match")
        rows = m.get("n_samples") or len(d.get("results", {}).get("samples", {}).get("scores") or ())
        if rows < 2:
            raise ValueError("the number of fitted rows isn't given, nor are results to count")
        kept = np.array(m["explained_variance"], float)
        if len(kept) != loadings.shape[1] or not np.isfinite(loadings).all():
            raise ValueError("loadings and eigenvalues don't match")
        values, rank = np.array(m.get("eigenvalues") or kept, float), min(rows, len(loadings))
        if "eigenvalues" not in m and len(kept) < rank:
            ratios = np.array(m.get("explained_variance_ratio") or (), float)
            if len(ratios) != len(kept) or not ratios.sum() > 0:
                raise ValueError("neither all eigenvalues nor their ratios are given")
            rest = kept.sum() * max(100 / ratios.sum() - 1, 0)
            values = np.concatenate([kept, np.full(rank - len(kept), rest / (rank - len(kept)))])
        extra: dict = {"incomplete": d["metadata"]["config"].get("missing_strategy") == "native"}
        if m.get("feature_spread"):
            extra["spread"] = np.array(m["feature_spread"], float)
        cov = m.get("score_covariance")
        return PCAModel(pre, loadings, values, rows, d["metadata"]["config"].get("method", "svd"), None if cov is None else np.array(cov), extra)

    def config(self) -> dict:
        return asdict(self.preprocess) | {"k": self.k, "method": self.method}


def fit(df: DataFrame, features: list[str], k: int = 2, preprocess: Preprocess | None = None, method: str = "svd", missing: str = "error", exact: bool = False) -> PCAModel:
    """A model of ``features`` with k components.

    More than MOST_FEATURES features are fitted by the products of rows with each other, if there are few rows. exact:
    a second pass by partial QR factors, for nearly collinear features, whose small eigenvalues their products lose.

    method: svd or nipals, which differ in the eigenvalues beyond k (nipals spreads what is left evenly). missing: error,
    drop, mean, median, zero, or native (nipals only; see ``nipals_missing``).
    """
    from facetflow.functions.transforms import impute

    pre = preprocess or Preprocess()
    if method not in ("svd", "nipals"):
        raise ValueError("method is svd or nipals; see operators.kernel for kernels")
    if missing == "native" and method != "nipals":
        raise ValueError("native handling of missing values needs nipals")
    if not features:
        raise ValueError("needs at least one feature")
    x = df.select(*[F.col(c).cast("double").alias(c) for c in features])
    x = x.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in features])

    if len(features) > MOST_FEATURES:
        return _fit_dual(x, features, k, pre, method, missing)

    def measured(x: DataFrame) -> Moments:
        return moments(pre.prepared(x, features), pre.rows(features))

    found = measured(x)
    if not found.complete:
        if missing == "error":
            raise ValueError("missing values; name a strategy")
        if missing == "native":
            return nipals_missing(x, features, k, pre.center)
        x = x.na.drop() if missing == "drop" else impute(x, features, missing)
        found = measured(x)

    def factored(ready: Preprocess) -> tuple[np.ndarray, np.ndarray]:
        _, sizes, turned = np.linalg.svd(triangular(ready.prepared(x.na.drop()).select(F.array(*ready.expressions()).alias("x")), len(features)))
        return sizes, turned.T

    return _of_moments(found, features, k, pre, method, x, factored if exact else None)


def fit_moments(found: Moments, features: list[str], k: int = 2, preprocess: Preprocess | None = None, method: str = "svd") -> PCAModel:
    """The model of rows of which only the moments are left; centring, standard scaling and scale_only follow from them."""
    pre = preprocess or Preprocess()
    if pre.snv or pre.vector_norm or pre.scale == "robust":
        raise ValueError("rows can't be normalised, nor medians found, from moments")
    if not found.complete:
        raise ValueError("moments of incomplete rows")
    return _of_moments(found, features, k, pre, method)


def merged(one: Moments, other: Moments) -> Moments:
    """Moments of the rows of both."""
    n, means, products = _met(one.rows, one.means, one.products, other.rows, other.means, other.products)
    return Moments(n, one.counts + other.counts, means, products)


def _of_moments(found: Moments, features: list[str], k: int, pre: Preprocess, method: str, x: DataFrame | None = None, factored: Callable[[Preprocess], tuple[np.ndarray, np.ndarray]] | None = None) -> PCAModel:
    n = found.rows
    if n < 2:
        raise ValueError("needs at least two rows")
    if not 1 <= k <= min(n, len(features)):
        raise ValueError(f"components must be from 1 to {min(n, len(features))}")
    deviations = np.sqrt(np.maximum(np.diag(found.products), 0) / (n - 1))
    pre = pre.fitted(pre.normalised(x, features) if pre.scale == "robust" else x, features, found.means.tolist(), deviations.tolist())
    shift, scale = np.array(pre.shifts_and_scales()).T
    mean = (found.means - shift) / scale
    covariance = found.products / np.outer(scale, scale)
    g = covariance + n * np.outer(mean, mean)
    values, vectors = np.linalg.eigh(g / (n - 1))
    values, vectors = np.maximum(values[::-1], 0), signed(vectors[:, ::-1])
    if factored:
        sizes, turned = factored(pre)
        values = np.concatenate([sizes**2 / (n - 1), np.zeros(len(features) - len(sizes))])
        vectors = signed(turned)
    values = values[: min(n, len(features))]
    spread = np.sqrt(np.diag(g) / (n - 1))
    if method == "nipals" and len(values) > k:
        values = np.concatenate([values[:k], np.full(len(values) - k, values[k:].sum() / (len(values) - k))])
    model = PCAModel(pre, vectors[:, :k], values, n, method, extra={"spread": spread})
    if not pre.center or pre.scale_only:  # scores aren't centred, so their covariance is not diagonal
        model.score_cov = model.loadings.T @ covariance @ model.loadings / (n - 1)
    return model


def _fit_dual(x: DataFrame, features: list[str], k: int, pre: Preprocess, method: str, missing: str) -> PCAModel:
    """fit() of tables with more features than a matrix of features x features is made for, but few rows."""
    if missing not in ("error", "drop") or pre.scale == "robust" or pre.snv or pre.vector_norm:
        raise ValueError(f"more than {MOST_FEATURES} features take complete rows, and centring and scaling by columns only")
    rows = x.select(F.array(*[F.coalesce(F.col(c), F.lit(float("nan"))) for c in features]).alias("x"))
    if missing == "drop":
        rows = rows.where(~F.exists("x", F.isnan))
    return _dual_model(rows, features, k, pre, method)


def fit_array(df: DataFrame, column: str, features: list[str], k: int = 2, preprocess: Preprocess | None = None) -> PCAModel:
    """A model of the elements of an array column, such as spectra, whose names are ``features``: of few rows and any
    number of features, which as columns of a table would take long to plan. Rows of another length or with nulls raise."""
    pre = preprocess or Preprocess()
    if pre.scale == "robust" or pre.snv or pre.vector_norm:
        raise ValueError("arrays take centring and scaling by features only")
    x = F.col(column).cast("array<double>")
    odd = x.isNull() | (F.size(x) != len(features)) | F.exists(x, lambda v: v.isNull() | F.isnan(v))
    if df.where(odd).limit(1).count():
        raise ValueError("missing values or rows of another length")
    return _dual_model(df.select(x.alias("x")), features, k, pre, "svd")


def _dual_model(rows: DataFrame, features: list[str], k: int, pre: Preprocess, method: str) -> PCAModel:
    loadings, values, means, deviations, n, squares = dual(rows, len(features), k, pre.center, pre.scale == "standard", pre.scale_only)
    if not 1 <= k <= n:
        raise ValueError(f"components must be from 1 to {n}")
    if method == "nipals" and len(values) > k:
        values = np.concatenate([values[:k], np.full(len(values) - k, values[k:].sum() / (len(values) - k))])
    pre = replace(pre, features=tuple(features), means=tuple(means.tolist()), deviations=tuple(deviations.tolist()))
    model = PCAModel(pre, signed(loadings), values, n, method, extra={"spread": np.sqrt(squares / (n - 1))})
    if not pre.center or pre.scale_only:
        shift, scale = np.array(pre.shifts_and_scales()).T
        middle = ((means - shift) / scale) @ model.loadings
        model.score_cov = np.diag(values[:k]) - np.outer(middle, middle) * (n / (n - 1))
    return model


def nipals_missing(x: DataFrame, features: list[str], k: int, center: bool = True, tolerance: float = 1e-8, rounds: int = 1000) -> PCAModel:
    """NIPALS on incomplete rows: loadings and scores are regressions over the cells that are there.

    Rows with the same gaps share the weights of those regressions, so all that a round asks for follows from the sums of
    products by pattern of gaps: they take one aggregate, and rounds and deflation work on them alone. With more than
    PATTERNS patterns or DECLARED features, see ``_nipals_by_passes``. What the components leave is spread evenly over
    the eigenvalues beyond them. Raises if a component doesn't settle.
    """
    m = len(features)
    means = x.agg(*[f(c).alias(f"{k}{i}") for k, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count)) for i, c in enumerate(features)]).first()
    shift = [float(means[i] or 0.0) if center else 0.0 for i in range(m)]
    table = x.select(*[(F.col(c) - shift[i]).alias(f"x{i}") for i, c in enumerate(features)])
    sums = _pattern_sums(table, m) if m <= DECLARED else None
    if sums is None:
        cells = F.array(*[F.coalesce(F.col(f"x{i}"), F.lit(float("nan"))) for i in range(m)])
        with for_a_while(table.select(cells.alias("x"))) as arrays:
            loadings, variances, n = _nipals_by_passes(arrays, m, k, tolerance, rounds)
    else:
        loadings, variances, n = _nipals_by_patterns(*sums, k, tolerance, rounds)
    pre = Preprocess(center=center, features=tuple(features), means=tuple(shift), deviations=(1.0,) * m)
    about_zero = [0.0 if center else (means[f"m{i}"] or 0.0) ** 2 * means[f"n{i}"] / max(means[f"n{i}"] - 1, 1) for i in range(m)]
    spread = [math.sqrt((means[f"v{i}"] or 0.0) + about_zero[i]) for i in range(m)]
    return PCAModel(pre, loadings, np.array(variances), n, "nipals", extra={"incomplete": True, "spread": np.array(spread)})


def _pattern_sums(table: DataFrame, m: int) -> tuple[np.ndarray, np.ndarray, int] | None:
    """(which cells are there, sums of products) by pattern of gaps, and the number of rows; None for too many patterns."""
    names = [f"x{i}" for i in range(m)]
    mask = total([F.when(F.col(c).isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(names)]).alias("mask")
    cells = [(i, j) for i in range(m) for j in range(i, m)]
    grouped = table.groupBy(mask).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"g{i}_{j}") for i, j in cells])
    rows = grouped.limit(PATTERNS + 1).collect()
    if len(rows) > PATTERNS:
        return None
    there = np.array([[bool(r["mask"] >> i & 1) for i in range(m)] for r in rows]).reshape(-1, m)
    products = np.zeros((len(rows), m, m))
    for i, j in cells:
        products[:, i, j] = products[:, j, i] = [r[f"g{i}_{j}"] or 0.0 for r in rows]
    return there, products, sum(r["n"] for r in rows)


def _nipals_by_patterns(there: np.ndarray, products: np.ndarray, n: int, k: int, tolerance: float, rounds: int) -> tuple[np.ndarray, list[float], int]:
    m = there.shape[1]
    found, variances = [], []
    for _ in range(k):
        power = np.einsum("pii->i", products)
        if power.max(initial=0) / max(n, 1) < tolerance:
            break
        p = np.zeros(m)
        p[int(power.argmax())] = 1.0
        for _ in range(rounds):
            own = there * p
            weight = (own**2).sum(1)
            scale = np.where(weight > 0, 1 / np.where(weight > 0, weight, 1), 0)  # of a row's product to its score
            both = np.einsum("pij,pj->pi", products, own) * scale[:, None]
            square = (both * own).sum(1) * scale
            under = there.T.astype(float) @ square
            new = np.where(under > 0, both.sum(0) / np.where(under > 0, under, 1), 0.0)
            new /= np.linalg.norm(new) or 1.0
            move, p = float(np.linalg.norm(new - p)), new
            if move < tolerance:
                break
        else:
            raise ArithmeticError("a component did not converge")
        p = signed(p[:, None])[:, 0]
        own = there * p
        weight = (own**2).sum(1)
        scale = np.where(weight > 0, 1 / np.where(weight > 0, weight, 1), 0)
        found.append(p)
        variances.append(float((np.einsum("pi,pij,pj->p", own, products, own) * scale**2).sum()) / max(n - 1, 1))
        step = np.eye(m) - own[:, :, None] * own[:, None, :] * scale[:, None, None]
        products = step @ products @ step.transpose(0, 2, 1)
    rest = float(np.einsum("pii->", products)) / max(n - 1, 1)
    if found and len(found) < m:
        variances += [rest / (m - len(found))] * (m - len(found))
    return np.array(found).T if found else np.zeros((m, 0)), variances, n


def _gap_sums(x: DataFrame, m: int, before: list[np.ndarray], p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, int]:
    """One pass over array rows with NaN for gaps: sums of weighted products of what the components ``before`` leave,
    of squared scores by feature, of squares by feature, of squared scores, and the number of rows.

    A row's score on p is its product with p times a weight, one by the squares of p where the row has cells; each row's
    residuals are made anew from the components before, so nothing is stored between passes.
    """
    step = max(1, BLOCK_BYTES // (8 * m))
    kind = "block int, n long, vectors binary, products binary"
    sent = x.sparkSession.sparkContext.broadcast((np.array(before).reshape(-1, m), p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, current = sent.value
        n, vectors, products = 0, np.zeros((3, m)), np.zeros((m, m))
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                v = batch.column(0).slice(at, 2048).flatten().to_numpy(zero_copy_only=False).reshape(-1, m)
                there = ~np.isnan(v)
                rest, there = np.where(there, v, 0.0), there.astype(float)
                for q in known:
                    under = there @ (q * q)
                    t = np.where(under > 0, rest @ q / np.where(under > 0, under, 1), 0.0)
                    rest -= np.outer(t, q) * there
                under = there @ (current * current)
                weight = np.where(under > 0, 1 / np.where(under > 0, under, 1), 0.0)
                t = rest @ current * weight
                n += len(v)
                vectors += [there.T @ (t * t), (rest * rest).sum(0), np.full(m, float(t @ t) / m)]
                products += (rest * weight[:, None]).T @ rest
        if n:
            for b, i in enumerate(range(0, m, step)):
                yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "n": [n], "vectors": [vectors.tobytes()], "products": [products[i : i + step].tobytes()]})

    def meet(table: pa.Table) -> pa.Table:
        total = lambda name: sum(np.frombuffer(r.as_py()) for r in table[name])
        return pa.table({"block": table["block"].slice(0, 1), "n": [sum(table["n"].to_pylist())], "vectors": [total("vectors").tobytes()], "products": [total("products").tobytes()]})

    found = x.mapInArrow(run, kind).groupBy("block").applyInArrow(meet, kind).orderBy("block").collect()  # one m x m matrix
    sent.destroy()
    if not found:
        return np.zeros((m, m)), np.zeros(m), np.zeros(m), 0.0, 0
    vectors = np.frombuffer(found[0]["vectors"]).reshape(3, m)
    return np.concatenate([np.frombuffer(r["products"]).reshape(-1, m) for r in found]), vectors[0], vectors[1], float(vectors[2].sum()), found[0]["n"]


def _nipals_by_passes(x: DataFrame, m: int, k: int, tolerance: float, rounds: int) -> tuple[np.ndarray, list[float], int]:
    """NIPALS on array rows with gaps, of any number of features and patterns.

    A step of NIPALS regresses scores on loadings and loadings on scores. With the rows' weights and the features' sums of
    squared scores held as they are at the present loadings, all further steps are powers of one matrix, whose leading
    vector is found at once; a pass over the rows then renews weights and sums. Both have the same fixed point, but
    a pass stands for as many steps as there would be, and what changes between passes is the effect of the gaps only.
    Where that doesn't come nearer, as with close eigenvalues and many gaps, passes are single steps from there on.
    """
    found, variances = [], []
    p = np.full(m, m**-0.5)
    rest, n = 0.0, 0
    for _ in range(k):
        products, under, power, square, n = _gap_sums(x, m, found, p)
        rest = float(power.sum())
        if power.max(initial=0) / max(n, 1) < tolerance:
            break
        stalls, last = 0, math.inf
        for _ in range(rounds):
            if stalls < 3:
                scale = np.where(under > 0, 1 / np.sqrt(np.where(under > 0, under, 1)), 0.0)
                new = np.linalg.eigh(products * np.outer(scale, scale))[1][:, -1] * scale
            else:  # leaps that don't come nearer: single steps from here on
                new = np.where(under > 0, products @ p / np.where(under > 0, under, 1), 0.0)
            new /= np.linalg.norm(new) or 1.0
            new = new if new @ p >= 0 else -new
            move, p = float(np.linalg.norm(new - p)), new
            stalls, last = stalls + (move > 0.5 * last), move
            if move < tolerance:
                break
            products, under, power, square, n = _gap_sums(x, m, found, p)
        else:
            raise ArithmeticError("a component did not converge")
        found.append(signed(p[:, None])[:, 0])
        variances.append(square / max(n - 1, 1))
        p = np.full(m, m**-0.5)
    else:
        rest = float(_gap_sums(x, m, found, p)[2].sum())
    if found and len(found) < m:
        variances += [rest / max(n - 1, 1) / (m - len(found))] * (m - len(found))
    return np.array(found).T if found else np.zeros((m, 0)), variances, n
