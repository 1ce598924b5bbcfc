"""Column transforms: strict and lenient functions, scaling, binning, one-hot columns, and a dispatcher by name.

Null cells stay null. Statistics are one aggregate; what follows is a projection of literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values a one-hot column may have.
MAX_LEVELS = 20


def strict(kind: str, column: str) -> Column:
    """Log, sqrt, square or reciprocal; a value outside the domain raises."""
    c = F.col(column).cast("double")
    if kind == "square":
        return c * c
    bad, value = {
        "log": (c <= 0, F.ln(c)),
        "sqrt": (c < 0, F.sqrt(c)),
        "reciprocal": (F.abs(c) < 1e-10, F.lit(1.0) / c),
    }[kind]
    return F.when(bad, F.raise_error(F.concat(F.lit(f"{kind} of {column}: "), c.cast("string"))).cast("double")).otherwise(value)


def lenient(kind: str, column: str) -> Column:
    """Log, sqrt or square; values outside the domain stay as they are."""
    c = F.col(column).cast("double")
    return {"log": F.when(c > 0, F.ln(c)).otherwise(c), "sqrt": F.when(c >= 0, F.sqrt(c)).otherwise(c), "square": c * c}[kind]


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation; columns of fewer than two values or a deviation below 1e-10 stay."""
    aggs = [f(c).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop), ("n", F.count))]
    s = df.agg(*aggs).first()
    use = [(i, c) for i, c in enumerate(columns) if s[f"n_{i}"] >= 2 and s[f"s_{i}"] >= 1e-10]
    return df.withColumns({c: (F.col(c) - s[f"m_{i}"]) / s[f"s_{i}"] for i, c in use})


def _bounds(df: DataFrame, columns: list[str]) -> list[tuple[str, float, float]]:
    s = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("l", F.min), ("h", F.max))]).first()
    return [(c, s[f"l_{i}"], s[f"h_{i}"]) for i, c in enumerate(columns)]


def min_max(df: DataFrame, columns: list[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Columns scaled to low..high (0..1 if that is empty); constant columns stay."""
    low, high = (low, high) if high > low else (0.0, 1.0)
    return df.withColumns({c: (F.col(c) - a) / (b - a) * (high - low) + low for c, a, b in _bounds(df, columns) if a is not None and b > a})


def bin_equal_width(df: DataFrame, columns: list[str], bins: int = 5) -> DataFrame:
    """Columns as labels Bin_1 to Bin_n of equal width; the maximum is in the last; constant columns stay."""
    bins = bins if bins >= 2 else 5
    out = {}
    for c, a, b in _bounds(df, columns):
        if a is not None and b > a:
            at = F.least(F.floor((F.col(c) - a) / ((b - a) / bins)), F.lit(bins - 1)) + 1
            out[c] = F.when(F.col(c).isNotNull(), F.concat(F.lit("Bin_"), at.cast("string")))
    return df.withColumns(out)


def levels(df: DataFrame, column: str, most: int = MAX_LEVELS) -> list[str] | None:
    """The column's sorted values other than null and empty; None if there are more than ``most``."""
    c = F.col(column).cast("string")
    found = df.where(c.isNotNull() & (F.trim(c) != "")).select(c.alias("v")).distinct().limit(most + 1).collect()
    return sorted(r["v"] for r in found) if len(found) <= most else None


def one_hot(df: DataFrame, column: str, most: int = MAX_LEVELS, keep: bool = False) -> DataFrame:
    """A 0/1 column ``column_value`` for each value, in place of the column; with too many values the table stays."""
    found = levels(df, column, most)
    if not found:
        return df
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    out = df.withColumns({f"{column}_{v}": F.when(text == v, 1).otherwise(0) for v in found})
    return out if keep else out.drop(column)


def apply(df: DataFrame, kind: str, columns: list[str], bins: int = 5, low: float = 0.0, high: float = 1.0) -> tuple[DataFrame, list[str]]:
    """The transform of that name on the columns that it fits, and messages about those that it doesn't."""
    types = dict(df.dtypes)
    numeric = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    said = [f"no column {c}" for c in columns if c not in types]
    have = [c for c in columns if c in types]
    if kind in ("onehot", "one_hot"):
        for c in have:
            before = df
            df = one_hot(df, c)
            if df is before:
                said.append(f"{c}: no values or more than {MAX_LEVELS}")
        return df, said
    fit = [c for c in have if types[c] in numeric and not c.lower().endswith("#target")]
    said += [f"{c} isn't numeric" for c in have if c not in fit]
    if kind in ("log", "sqrt", "square"):
        return df.withColumns({c: lenient(kind, c) for c in fit}), said
    if kind in ("standardize", "minmax", "bin"):
        how = {"standardize": lambda: standardize(df, fit), "minmax": lambda: min_max(df, fit, low, high), "bin": lambda: bin_equal_width(df, fit, bins)}
        return (how[kind]() if fit else df), said
    raise ValueError(f"no transform {kind!r}")


def statistic(df: DataFrame, columns: list[str], strategy: str, value: float | str | None = None, strict: bool = False) -> dict[str, object]:
    """What ``impute`` puts in each column. Median: mean of the two middle values; ``median_low``: the lower of them.

    strict: a column without values raises; else a numeric one gets 0.
    """
    if strategy == "zero":
        return dict.fromkeys(columns, 0.0)
    if strategy == "custom":
        return dict.fromkeys(columns, value)
    from facetflow.operators.quantiles import exact_mode, exact_quantiles

    types = dict(df.dtypes)
    modal = [c for c in columns if strategy == "mode" or types[c] == "string"]
    numeric = [c for c in columns if c not in modal]
    found: dict[str, object] = {c: exact_mode(df, c) for c in modal}
    if strategy == "mean" and numeric:
        s = df.agg(*[F.avg(c).alias(f"s{i}") for i, c in enumerate(numeric)]).first()
        found |= {c: s[f"s{i}"] for i, c in enumerate(numeric)}
    elif numeric:
        quantiles = exact_quantiles(df, numeric, [0.5], lower={"median": False, "median_low": True}[strategy])
        found |= {c: q for c, (q,) in zip(numeric, quantiles, strict=True)}
    if strict and any(v is None for v in found.values()):
        raise ValueError(f"no values in {[c for c, v in found.items() if v is None]}")
    return {c: found[c] if found[c] is not None else (None if types[c] == "string" else 0.0) for c in columns}


def impute(df: DataFrame, columns: list[str], strategy: str = "mean", value: float | str | None = None, strict: bool = False) -> DataFrame:
    """Missing cells filled by mean, median, median_low, mode, zero, custom, forward or backward.

    Text columns take their mode (ties: the smallest value) for mean and median. A numeric column without values gets 0, or raises if ``strict``.
    """
    if strategy in ("forward", "backward"):
        from facetflow.operators.rows import fill

        return fill(df, columns, strategy)
    put = statistic(df, columns, strategy, value, strict)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in put.items() if v is not None})
