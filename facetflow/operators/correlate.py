"""Correlations of columns, of components with metadata, and confidence ellipses of groups."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetflow.functions.numbers import CHI_SQUARE_2, correlation_p_value
from facetflow.operators import pairwise
from facetflow.operators.ranks import mean_ranks

#: Pairs up to which correlations are one declarative aggregate.
DECLARED_PAIRS = 6


def pearson(x: str, y: str) -> Column:
    """Correlation over the pairs without nulls; 0 for constants or fewer than two pairs."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    both = a.isNotNull() & b.isNotNull()
    sx, sy = F.stddev_pop(F.when(both, a)), F.stddev_pop(F.when(both, b))
    return F.coalesce(F.try_divide(F.covar_pop(a, b), sx * sy), F.lit(0.0))


def _stacked(df: DataFrame, pairs: list[tuple[str, str]], names: tuple[str, str]) -> DataFrame:
    """One row a pair: its names, r and n, from one aggregate."""
    aggs = [e for i, (a, b) in enumerate(pairs) for e in (pearson(a, b).alias(f"r{i}"), F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias(f"n{i}"))]
    rows = F.array(*[F.struct(F.lit(a).alias(names[0]), F.lit(b).alias(names[1]), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n")) for i, (a, b) in enumerate(pairs)])
    return df.agg(*aggs).select(F.explode(rows).alias("x")).select("x.*")


def pearson_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r, n for every pair of columns a before b: one aggregate for a few, products of masked matrices for more."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return _stacked(df, pairs, ("a", "b")) if len(pairs) <= DECLARED_PAIRS else pairwise.pairs(df, columns)


def _with_levels(df: DataFrame, components: list[str], column: str) -> DataFrame:
    """variable, pc, r, n of the 0/1 column of each level of a category with each component, by one grouping: a level's
    count and sum of a component's deviations are all that its correlation asks for, however many levels there are."""
    x = [F.col(c).cast("double") for c in components]
    x = [F.when(~F.isnan(v), v) for v in x]
    whole = df.agg(*[f(v).alias(f"{k}{i}") for i, v in enumerate(x) for k, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_pop))]).first()
    text = F.col(f"__of_{column}").cast("string")
    own = df.where(text.isNotNull() & (F.trim(text) != "")).groupBy(text.alias("level"))
    sums = own.agg(*[e for i, v in enumerate(x) for e in (F.count(v).alias(f"k{i}"), F.sum(v - F.lit(whole[f"m{i}"])).alias(f"d{i}"))])
    rows = []
    for i, c in enumerate(components):
        n, s = whole[f"n{i}"], whole[f"s{i}"] or 0.0
        share = F.col(f"k{i}") / F.lit(float(max(n, 1)))
        r = F.coalesce(F.try_divide(F.col(f"d{i}") / F.lit(float(max(n, 1))), F.sqrt(share * (1 - share)) * s), F.lit(0.0))
        rows.append(F.struct(F.lit(c).alias("pc"), r.alias("r"), F.lit(n).cast("long").alias("n")))
    return sums.select("level", F.explode(F.array(*rows)).alias("x")).select(F.concat(F.lit(f"{column}_"), "level").alias("variable"), "x.*")


def eigencorrelations(scores: DataFrame, components: list[str], numeric: list[str], categorical: list[str] = (), method: str = "pearson") -> DataFrame:
    """variable, pc, r, n, p_value for components against metadata columns of the same rows; r and p are 0 below 3 pairs.

    Each level of a category counts as a 0/1 column ``name_level``, with no limit on levels. Spearman ranks each column
    over all its values first, ties by their mean; ranks of a 0/1 column are as good as the column itself.
    """
    if method not in ("pearson", "spearman"):
        raise ValueError("method is pearson or spearman")
    measures = list(dict.fromkeys([*components, *numeric]))
    numeric = list(dict.fromkeys(numeric))
    df = scores.select(*measures, *[F.col(c).alias(f"__of_{c}") for c in categorical])
    if method == "spearman":
        df = mean_ranks(df, measures)
    parts = []
    if numeric:
        pairs = [(v, p) for v in numeric for p in components]
        found = _stacked(df, pairs, ("variable", "pc")) if len(pairs) <= DECLARED_PAIRS else pairwise.pairs(df, numeric, components)
        parts.append(found.toDF("variable", "pc", "r", "n"))
    parts += [_with_levels(df, components, c) for c in categorical]
    if not parts:
        return scores.sparkSession.createDataFrame([], "variable string, pc string, r double, n long, p_value double")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)

    def with_p(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r, n = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            kept = [x if m >= 3 else 0.0 for x, m in zip(r, n, strict=True)]
            p = [correlation_p_value(x, m) for x, m in zip(r, n, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.float64()), batch.column(3), pa.array(p, pa.float64())], names=["variable", "pc", "r", "n", "p_value"])

    return found.mapInArrow(with_p, "variable string, pc string, r double, n long, p_value double")


def ordered_by_first(correlations: DataFrame, first: str = "PC1") -> DataFrame:
    """Variables by falling correlation with the first component."""
    return correlations.where(F.col("pc") == first).orderBy(F.desc("r"), "variable").select("variable", "r")


def ellipses(df: DataFrame, group: str, x: str, y: str, level: float = 0.95) -> DataFrame:
    """group, n, center_x, center_y, major, minor (semi-axes) and angle; groups below three points or flat are left out."""
    if level not in CHI_SQUARE_2:
        raise ValueError(f"level is one of {sorted(CHI_SQUARE_2)}")
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    finite = a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b) & (F.abs(a) < float("inf")) & (F.abs(b) < float("inf"))
    s = df.where(finite).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(a).alias("center_x"), F.avg(b).alias("center_y"), F.var_samp(a).alias("vx"), F.var_samp(b).alias("vy"), F.covar_samp(a, b).alias("c"))
    half, gap = (F.col("vx") + F.col("vy")) / 2, F.sqrt(F.pow((F.col("vx") - F.col("vy")) / 2, F.lit(2.0)) + F.col("c") * F.col("c"))
    s = s.where("n >= 3").withColumns({"l1": half + gap, "l2": half - gap}).where("l2 > 0")
    chi = CHI_SQUARE_2[level]
    return s.select(group, "n", "center_x", "center_y", F.sqrt(chi * F.col("l1")).alias("major"), F.sqrt(chi * F.col("l2")).alias("minor"), (F.atan2(2 * F.col("c"), F.col("vx") - F.col("vy")) / 2).alias("angle"))


def ellipse_paths(found: DataFrame, group: str, points: int = 100) -> DataFrame:
    """group, i, x, y along each ellipse."""
    t = 2 * F.pi() * F.col("i") / points
    e = found.select("*", F.explode(F.sequence(F.lit(0), F.lit(points))).alias("i"))
    u, v = F.col("major") * F.cos(t), F.col("minor") * F.sin(t)
    return e.select(group, "i", (F.col("center_x") + u * F.cos("angle") - v * F.sin("angle")).alias("x"), (F.col("center_y") + u * F.sin("angle") + v * F.cos("angle")).alias("y"))
