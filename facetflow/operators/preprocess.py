"""Row- and column-wise preprocessing with fitted statistics.

Rows first: standard normal variate (over vector norm), recomputed for every row: its mean and deviation are columns of
their own (``prepared``), so expressions stay linear in the number of features. Then columns, by precedence robust, scale
only, centre and standard. Statistics are fitted on the row-normalised table and applied as literals.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetflow.operators.quantiles import exact_quantiles

#: Below this a deviation or norm counts as zero.
NEAR_ZERO = 1e-8
#: Columns of a prepared table: what each row's features lose and are divided by.
SHIFT, DIVISOR = "__row_shift", "__row_divisor"
MAD_FACTOR = 1.4826


def total(parts: list[Column]) -> Column:
    """Sum of columns as a balanced tree, so that expressions of many features stay shallow."""
    while len(parts) > 1:
        parts = [reduce(add, parts[i : i + 8]) for i in range(0, len(parts), 8)]
    return parts[0]


@dataclass(frozen=True)
class Preprocess:
    """What to do; ``fit`` gives a copy with the statistics of the columns."""

    center: bool = True
    scale: str = "none"
    scale_only: bool = False
    snv: bool = False
    vector_norm: bool = False
    features: tuple[str, ...] = ()
    means: tuple[float, ...] = ()
    deviations: tuple[float, ...] = ()
    medians: tuple[float, ...] = ()
    mads: tuple[float, ...] = ()
    extra: dict = field(default_factory=dict, compare=False)

    def __post_init__(self) -> None:
        if self.scale not in ("none", "standard", "robust"):
            raise ValueError("scale is none, standard or robust")

    @property
    def does_anything(self) -> bool:
        return self.center or self.scale != "none" or self.scale_only or self.snv or self.vector_norm

    def prepared(self, df: DataFrame, features: list[str] | tuple[str, ...] | None = None) -> DataFrame:
        """``df`` with what rows() and expressions() refer to: each row's shift and divisor, where rows are normalised."""
        x = [F.col(c).cast("double") for c in (features if features is not None else self.features)]
        if self.snv:
            df = df.withColumn(SHIFT, total(x) / len(x))
            apart = [(c - F.col(SHIFT)) * (c - F.col(SHIFT)) for c in x]
            spread = F.sqrt(total(apart) / (len(x) - 1)) if len(x) > 1 else F.lit(0.0)
        elif self.vector_norm:
            df = df.withColumn(SHIFT, F.lit(0.0))
            spread = F.sqrt(total([c * c for c in x]))
        else:
            return df
        return df.withColumn(DIVISOR, F.when(spread > NEAR_ZERO, spread).when(spread.isNotNull(), 1.0))

    def rows(self, features: list[str] | tuple[str, ...]) -> list[Column]:
        """The row-normalised features of a table of prepared()."""
        x = [F.col(c).cast("double") for c in features]
        return [(c - F.col(SHIFT)) / F.col(DIVISOR) for c in x] if self.snv or self.vector_norm else x

    def normalised(self, df: DataFrame, features: list[str] | tuple[str, ...]) -> DataFrame:
        return self.prepared(df, features).withColumns(dict(zip(features, self.rows(features), strict=True))).drop(SHIFT, DIVISOR)

    def fit(self, df: DataFrame, features: list[str]) -> Preprocess:
        table = self.normalised(df, features).select(*[F.col(c).cast("double").alias(c) for c in features])
        wanted = [(f"m{i}", F.avg(c)) for i, c in enumerate(features)] + [(f"s{i}", F.stddev_samp(c)) for i, c in enumerate(features)]
        s = table.agg(*[e.alias(n) for n, e in wanted]).first()
        k = range(len(features))
        return self.fitted(table, features, [s[f"m{i}"] or 0.0 for i in k], [s[f"s{i}"] or 0.0 for i in k])

    def fitted(self, table: DataFrame, features: list[str], means: list[float], deviations: list[float]) -> Preprocess:
        """fit(), given moments of the row-normalised ``table``; medians are found only for robust scaling."""
        out = replace(self, features=tuple(features), means=tuple(means), deviations=tuple(deviations))
        if self.scale == "robust":
            medians = [x or 0.0 for (x,) in exact_quantiles(table, features, [0.5], lower=True)]
            apart = table.select(*[F.abs(F.col(c) - medians[i]).alias(c) for i, c in enumerate(features)])
            mads = exact_quantiles(apart, features, [0.5], lower=True)
            out = replace(out, medians=tuple(medians), mads=tuple(MAD_FACTOR * (x or 0.0) for (x,) in mads))
        return out

    def shifts_and_scales(self) -> list[tuple[float, float]]:
        """What each feature loses and is divided by; divisors near zero are 1, at fit and after loading alike."""
        safe = lambda s: s if s > NEAR_ZERO else 1.0
        if self.scale == "robust":
            return [(m, safe(s)) for m, s in zip(self.medians, self.mads, strict=True)]
        if self.scale_only:
            return [(0.0, safe(s)) for s in self.deviations]
        return [(m if self.center else 0.0, safe(s) if self.scale == "standard" else 1.0) for m, s in zip(self.means, self.deviations, strict=True)]

    def expressions(self) -> list[Column]:
        """The preprocessed features of a table of prepared(), in order."""
        return [(x - m) / s for x, (m, s) in zip(self.rows(self.features), self.shifts_and_scales(), strict=True)]

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with preprocessed features; other columns stay."""
        return self.prepared(df).withColumns(dict(zip(self.features, self.expressions(), strict=True))).drop(SHIFT, DIVISOR)

    def inverse(self, df: DataFrame) -> DataFrame:
        """The column steps undone."""
        return df.withColumns({c: F.col(c) * s + m for c, (m, s) in zip(self.features, self.shifts_and_scales(), strict=True)})


def constant_columns(df: DataFrame, columns: list[str], below: float = 1e-8) -> list[str]:
    """Columns whose population variance is below the limit."""
    s = df.agg(*[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if s[f"v{i}"] is not None and s[f"v{i}"] < below]


def variance_rank(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, variance (sample), rank from 1 by falling variance."""
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("column"), F.col(f"v{i}").alias("variance")) for i, c in enumerate(columns)])).alias("x")
    found = df.agg(*[F.var_samp(c).alias(f"v{i}") for i, c in enumerate(columns)]).select(values).select("x.*")
    from pyspark.sql import Window

    return found.select("column", "variance", F.row_number().over(Window.orderBy(F.desc("variance"), "i")).alias("rank"))  # a row a column


def scale_ratio(df: DataFrame, columns: list[str]) -> float | None:
    """Largest by smallest positive sample variance."""
    s = df.agg(*[F.var_samp(c).alias(f"v{i}") for i, c in enumerate(columns)]).first()
    found = [v for v in s if v is not None and v > 0]
    return max(found) / min(found) if found else None
