"""Tables for plots: labels, loadings, biplots, diagnostics, and densities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of a density grid, at most, along each side.
MOST_GRID = 200
#: Rows of a matrix product.
ROWS = 4096


def farthest(df: DataFrame, x: str, y: str, n: int = 10, key: str = "row_idx") -> DataFrame:
    """The n points farthest from the origin, to be labelled."""
    d = F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y))
    return df.select(key, x, y, d.alias("distance")).orderBy(F.desc("distance"), key).limit(n)


def largest_loadings(loadings: DataFrame, pc: str, n: int) -> DataFrame:
    return loadings.where(F.col("pc") == pc).orderBy(F.desc(F.abs("value")), "feature_idx").limit(n)


def leading_feature(loadings: DataFrame) -> DataFrame:
    """pc, feature of the largest absolute loading; the first feature of equals."""
    top = F.min(F.struct((-F.abs("value")).alias("size"), "feature_idx", "feature")).alias("t")
    return loadings.groupBy("pc").agg(top).select("pc", F.col("t.feature").alias("feature"))


def biplot_vectors(loadings: DataFrame, x: str = "PC1", y: str = "PC2", least: float = 0.01, n: int = 100) -> DataFrame:
    """feature, x, y, magnitude of at most n arrows, the longest first."""
    of = lambda p: F.max(F.when(F.col("pc") == p, F.col("value")))
    both = loadings.groupBy("feature_idx", "feature").agg(of(x).alias("x"), of(y).alias("y"))
    both = both.withColumn("magnitude", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")))
    return both.where(F.col("magnitude") >= least).orderBy(F.desc("magnitude"), "feature_idx").limit(n)


def quadrants(diagnosed: DataFrame, t2_limit: float, rss_limit: float) -> DataFrame:
    """``diagnosed`` with ``kind``: regular, good leverage, orthogonal or bad leverage."""
    far, off = F.col("t2") > t2_limit, F.col("rss") > rss_limit
    return diagnosed.withColumn("kind", F.when(far & off, "bad leverage").when(far, "good leverage").when(off, "orthogonal").otherwise("regular"))


def normalised(df: DataFrame, column: str, name: str = "shade") -> DataFrame:
    """``df`` with the column scaled to 0..1 over its finite values; missing stays null, a constant is 0.5."""
    x = F.col(column).cast("double")
    finite = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    s = df.agg(F.min(finite).alias("a"), F.max(finite).alias("b")).first()
    if s["a"] is None or s["a"] == s["b"]:
        return df.withColumn(name, F.when(finite.isNotNull(), 0.5))
    return df.withColumn(name, (finite - s["a"]) / (s["b"] - s["a"]))


def density(df: DataFrame, x: str, y: str, grid: int = 25, bandwidth: str | float = "scott") -> DataFrame:
    """i, j, x, y, density of a Gaussian estimate on grid x grid points over the range of the data.

    Each task sums its rows over the grid by matrix products; the shuffle moves a row a point and task.
    """
    if not 1 < grid <= MOST_GRID:
        raise ValueError(f"grid is from 2 to {MOST_GRID}")
    p = df.select(F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py")).na.drop()
    s = p.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("px").alias("sx"), F.stddev_samp("py").alias("sy"), F.min("px").alias("ax"), F.max("px").alias("bx"), F.min("py").alias("ay"), F.max("py").alias("by")).first()
    kind = "i int, j int, x double, y double, density double"
    if s["n"] < 2 or not s["sx"] or not s["sy"]:
        return df.sparkSession.createDataFrame([], kind)
    factor = {"scott": s["n"] ** (-1 / 6), "silverman": s["n"] ** (-1 / 6)}.get(bandwidth, bandwidth)
    hx, hy = (s["sx"] * factor, s["sy"] * factor) if isinstance(bandwidth, str) else (factor, factor)
    dx, dy = (s["bx"] - s["ax"]) / (grid - 1), (s["by"] - s["ay"]) / (grid - 1)
    ax, ay, n = s["ax"], s["ay"], s["n"]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((grid, grid))
        for batch in batches:
            px, py = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for a in range(0, len(px), ROWS):
                u = (ax + np.arange(grid)[:, None] * dx - px[a : a + ROWS]) / hx
                v = (ay + np.arange(grid)[:, None] * dy - py[a : a + ROWS]) / hy
                total += np.exp(-u * u / 2) @ np.exp(-v * v / 2).T
        i, j = np.divmod(np.arange(grid * grid), grid)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "s"])

    total = p.mapInArrow(partial, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    gx, gy = F.lit(ax) + F.col("i") * dx, F.lit(ay) + F.col("j") * dy
    return total.select("i", "j", gx.alias("x"), gy.alias("y"), (F.col("s") / (2 * 3.141592653589793 * hx * hy * n)).alias("density"))


def axis_label(pc: str, ratio_pct: float) -> str:
    return f"{pc} ({ratio_pct:.1f}%)"


def label_place(x: str, y: str) -> Column:
    """Where a point's label goes, away from the origin."""
    return F.concat(F.when(F.col(y) >= 0, "top").otherwise("bottom"), F.lit(" "), F.when(F.col(x) >= 0, "right").otherwise("left"))


def circle_vectors(loadings: DataFrame, x: str = "PC1", y: str = "PC2", least: float = 0.1) -> DataFrame:
    """feature, x, y, magnitude of the variables' correlations with two components, without those near the centre."""
    return biplot_vectors(loadings.withColumn("value", F.col("correlation")), x, y, least, 1 << 30)


def scaled_loadings(loadings: DataFrame, variance: DataFrame, scores: DataFrame, kind: str = "correlation", x: str = "PC1", y: str = "PC2") -> DataFrame:
    """feature, x, y of a biplot's arrows: loadings by share of variance, then by one factor that fits them to the scores.

    kind: correlation (by the root of the share), symmetric (its fourth root), pca (as they are). The factor is 0.65 of
    the largest score by the largest loading, from 0.1 to 100.
    """
    power = {"correlation": 0.5, "symmetric": 0.25, "pca": 0.0}[kind]
    both = loadings.where(F.col("pc").isin(x, y)).join(F.broadcast(variance.select("pc", "ratio_pct")), "pc")  # a row a component
    both = both.withColumn("value", F.col("value") * F.pow(F.col("ratio_pct") / 100, F.lit(power)))
    top = both.agg(F.max(F.abs("value"))).first()[0] or 0.0
    reach = scores.agg(F.greatest(F.max(F.abs(x)), F.max(F.abs(y)))).first()[0] or 0.0
    factor = min(100.0, max(0.1, 0.65 * reach / top)) if top > 0 else 1.0
    return biplot_vectors(both.withColumn("value", F.col("value") * factor), x, y, 0.0, 1 << 30).drop("magnitude")


def gabriel_loadings(loadings: DataFrame, scores: DataFrame, scale: float = 0.5, x: str = "PC1", y: str = "PC2") -> DataFrame:
    """feature, x, y: loadings by n^scale, fitted to 0.8 of the largest score."""
    s = scores.agg(F.count(F.lit(1)).alias("n"), F.greatest(F.max(F.abs(x)), F.max(F.abs(y))).alias("m")).first()
    own = loadings.where(F.col("pc").isin(x, y))
    alpha = s["n"] ** scale
    top = (own.agg(F.max(F.abs("value"))).first()[0] or 0.0) * alpha
    factor = alpha * 0.8 * (s["m"] or 0.0) / top if top else 0.0
    return biplot_vectors(own.withColumn("value", F.col("value") * factor), x, y, 0.0, 1 << 30).drop("magnitude")


def plotted_loadings(loadings: DataFrame, scores: DataFrame, x: str = "PC1", y: str = "PC2", least: float = 0.01, n: int = 100) -> DataFrame:
    """feature, x, y of the arrows as drawn: the longest n, stretched to 0.7 of 1.2 times the largest score (1 at least)."""
    own = biplot_vectors(loadings, x, y, least, n)
    reach = scores.agg(F.greatest(F.max(F.abs(x)), F.max(F.abs(y)))).first()[0] or 0.0
    top = loadings.where(F.col("pc").isin(x, y)).agg(F.max(F.abs("value"))).first()[0] or 0.0
    factor = 0.7 * max(1.2 * reach, 1.0) / top if top else 1.0
    return own.select("feature_idx", "feature", (F.col("x") * factor).alias("x"), (F.col("y") * factor).alias("y"))


def space_vectors(loadings: DataFrame, axes: tuple[str, str, str] = ("PC1", "PC2", "PC3"), n: int = 50) -> DataFrame:
    """feature, x, y, z, magnitude of the n longest arrows in three components."""
    of = lambda p: F.max(F.when(F.col("pc") == p, F.col("value")))
    found = loadings.groupBy("feature_idx", "feature").agg(*[of(p).alias(a) for p, a in zip(axes, "xyz", strict=True)])
    found = found.withColumn("magnitude", F.sqrt(sum((F.col(a) * F.col(a) for a in "xyz"), F.lit(0.0))))
    return found.orderBy(F.desc("magnitude"), "feature_idx").limit(n)


def diagnostic_labels(diagnosed: DataFrame, n: int = 10, key: str = "row_idx", x_limit: float | None = None, y_limit: float | None = None) -> DataFrame:
    """key, mahalanobis, rss, distance of the n rows farthest from the origin, both axes by their limits or largest values."""
    s = diagnosed.agg(F.max("mahalanobis").alias("x"), F.max("rss").alias("y")).first()
    x, y = x_limit or s["x"] or 1.0, y_limit or s["y"] or 1.0
    d = F.sqrt(F.pow(F.col("mahalanobis") / x, F.lit(2.0)) + F.pow(F.col("rss") / y, F.lit(2.0)))
    return diagnosed.select(key, "mahalanobis", "rss", d.alias("distance")).orderBy(F.desc("distance"), key).limit(n)


def by_strength(correlations: DataFrame, first: str = "PC1") -> DataFrame:
    """variable, pc, r, place: cells of a heat map, variables by falling absolute correlation with the first component."""
    order = Window.orderBy(F.desc(F.abs("r")), "variable")
    places = correlations.where(F.col("pc") == first).select("variable", F.row_number().over(order).alias("place"))  # a row a variable
    return correlations.join(F.broadcast(places), "variable").select("variable", "pc", "r", "place")


def scree(variance: DataFrame) -> DataFrame:
    """component, ratio_pct, cumulative_pct, label."""
    return variance.select(F.substring("pc", 3, 9).cast("int").alias("component"), "ratio_pct", "cumulative_pct", F.format_string("%s (%.1f%%)", "pc", "ratio_pct").alias("label"))


def evenly(df: DataFrame, target: int) -> DataFrame:
    """``target`` rows at rounded even distances, both ends included; all rows if there are no more."""
    n = df.count()
    if n <= target:
        return df
    if target < 2:
        return df.where(F.col("row_idx") == n - 1)
    step = (n - 1) / (target - 1)
    i = F.ceil((F.col("row_idx") - 0.5) / step)
    return df.where(((F.floor(i * step + 0.5) == F.col("row_idx")) & (i < target)) | (F.col("row_idx") == n - 1))


def sample_names(df: DataFrame, name: str = "row_name") -> DataFrame:
    """``df`` with names Sample_1 and so on where it has none."""
    given = F.concat(F.lit("Sample_"), (F.col("row_idx") + 1).cast("string"))
    return df.withColumn(name, F.coalesce(F.col(name), given) if name in df.columns else given)
