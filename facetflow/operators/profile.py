"""Profiles of columns, missing values, outliers, duplicates, and the data-quality report."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetflow.functions.numbers import parse_number
from facetflow.operators.correlate import pearson_matrix
from facetflow.operators.quantiles import distinct_counts, exact_quantiles
from facetflow.sources.scratch import for_a_while

BINS = 10
#: Values that a histogram and a distribution's label ask for.
LEAST = 10
ADVICE = {"missing": "impute or drop", "duplicate": "drop duplicates", "outlier": "robust scaling or removal", "correlation": "drop one of each pair", "variance": "drop", "distribution": "log or square root"}


def _rows(pairs: list[tuple[str, list[Column]]]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(name).alias("column"), *own) for name, own in pairs])).alias("x")


def skewness(c: str) -> Column:
    """n^2 / ((n-1)(n-2)) times the population skewness; null below three values or for constants."""
    n = F.count(c).cast("double")
    return F.when((n >= 3) & (F.stddev_pop(c) > 0), F.try_divide(n * n, (n - 1) * (n - 2)) * F.skewness(c))


def kurtosis(c: str) -> Column:
    """Bias-corrected with z-scores of the population deviation; null below four values or for constants."""
    n = F.count(c).cast("double")
    head = F.try_divide(n * n * (n + 1), (n - 1) * (n - 2) * (n - 3)) * (F.kurtosis(c) + 3)
    return F.when((n >= 4) & (F.stddev_pop(c) > 0), head - F.try_divide(3 * (n - 1) * (n - 1), (n - 2) * (n - 3)))


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: counts, moments and exact interpolated quartiles; distinct values are grouped, not gathered."""
    stats = {"count": F.count, "missing": lambda c: F.count(F.when(F.col(c).isNull(), 1)), "mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max, "skewness": skewness, "kurtosis": kurtosis}
    order = ["count", "missing", "distinct", "mean", "median", "std", "min", "max", "q1", "q3", "skewness", "kurtosis", "iqr"]
    typed = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    one = typed.agg(*[f(c).alias(f"{k}_{i}") for i, c in enumerate(columns) for k, f in stats.items()]).first()
    distinct = {r["column"]: r["n_distinct"] for r in distinct_counts(typed, columns).collect()}  # a row a column
    rows = []
    for i, (c, (q1, q2, q3)) in enumerate(zip(columns, exact_quantiles(typed, columns, [0.25, 0.5, 0.75]), strict=True)):
        own = {k: one[f"{k}_{i}"] for k in stats} | {"distinct": distinct.get(c, 0), "q1": q1, "median": q2, "q3": q3, "iqr": None if q1 is None else q3 - q1}
        rows.append((c, *[own[k] if k in ("count", "missing", "distinct") or own[k] is None else float(own[k]) for k in order]))
    kinds = ", ".join(f"`{k}` {'long' if k in ('count', 'missing', 'distinct') else 'double'}" for k in order)
    return df.sparkSession.createDataFrame(rows, f"column string, {kinds}")


def categorical_profile(df: DataFrame, column: str) -> DataFrame:
    """value, n, is_mode (ties: the smallest value); empty and null aren't values."""
    text = F.col(column).cast("string")
    counts = df.where(text.isNotNull() & (F.trim(text) != "")).groupBy(text.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("t")).select(F.col("t.value").alias("top"))
    return counts.crossJoin(F.broadcast(top)).select("value", "n", (F.col("value") == F.col("top")).alias("is_mode"))  # one row


def _bin(x: Column, low: float, high: float, bins: int = BINS) -> Column:
    return F.least(F.floor((x - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """bin, low, high, n over equal widths; empty for fewer than ten values or a constant."""
    x = F.col(column).cast("double")
    s = df.agg(F.min(x).alias("a"), F.max(x).alias("b"), F.count(x).alias("n")).first()
    spark, kind = df.sparkSession, "bin int, low double, high double, n long"
    if s["n"] < LEAST or not s["b"] > s["a"]:
        return spark.createDataFrame([], kind)
    a, width = s["a"], (s["b"] - s["a"]) / bins
    counts = df.where(x.isNotNull()).groupBy(_bin(x, a, s["b"], bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edges = spark.createDataFrame([(i, a + i * width, s["b"] + 0.001 if i == bins - 1 else a + (i + 1) * width) for i in range(bins)], "bin int, low double, high double")
    return edges.join(counts, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def distribution(skew: float | None, kurt: float | None, counts: list[int]) -> str:
    """normal, right-skewed, left-skewed, bimodal or unknown; fewer than ten values are unknown."""
    if skew is None or kurt is None or sum(counts) < LEAST:
        return "unknown"
    if abs(skew) < 0.5 and abs(kurt) < 1:
        return "normal"
    if abs(skew) > 1:
        return "right-skewed" if skew > 0 else "left-skewed"
    return "bimodal" if sum(a < b > c for a, b, c in zip(counts, counts[1:], counts[2:], strict=False)) >= 2 else "unknown"


def _outlier(c: str, s: dict) -> Column:
    """column, value, method and score of a cell that is an outlier by the column's statistics, else null."""
    x, iqr, sd = F.col(c).cast("double"), s["iqr"], s["std"] or 0.0
    by_iqr = (x < s["q1"] - 1.5 * iqr) | (x > s["q3"] + 1.5 * iqr)
    z = F.abs(x - s["mean"]) / sd if sd > 0 else F.lit(0.0)
    score = F.when(by_iqr, F.abs(x - s["median"]) / iqr if iqr > 0 else F.lit(None).cast("double")).otherwise(z)
    return F.when(by_iqr | (z > 3), F.struct(F.lit(c).alias("column"), x.alias("value"), F.when(by_iqr, "iqr").otherwise("zscore").alias("method"), score.alias("score")))


def outliers(df: DataFrame, columns: list[str], key: str = "row_idx") -> DataFrame:
    """column, key, value, method (iqr before zscore), score; distances in quartile ranges from the median, or in deviations.

    The score is null where the quartiles are equal.
    """
    stats = {r["column"]: r for r in numeric_profile(df, columns).collect()}
    parts = [_outlier(c, stats[c]) for c in columns if stats[c]["q1"] is not None]
    if not parts:
        return df.sparkSession.createDataFrame([], f"column string, {key} long, value double, method string, score double")
    return df.select(key, F.explode(F.filter(F.array(*parts), lambda p: p.isNotNull())).alias("x")).select("x.column", key, "x.value", "x.method", "x.score")


def missing_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_missing, pct_missing."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"m{i}") for i, c in enumerate(columns)])
    found = one.select("n", _rows([(c, [F.col(f"m{i}").alias("n_missing")]) for i, c in enumerate(columns)]))
    return found.select("x.column", "x.n_missing", F.coalesce(F.try_divide(F.lit(100.0) * F.col("x.n_missing"), F.col("n")), F.lit(0.0)).alias("pct_missing"))


def missing_rows(df: DataFrame, columns: list[str], key: str = "row_idx") -> DataFrame:
    """key, n_missing of the rows with missing cells."""
    n = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    return df.select(key, n.alias("n_missing")).where("n_missing > 0")


def duplicate_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """n_duplicates: rows beyond the first of their values."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def roles(df: DataFrame, columns: list[str], decimal: str = ".") -> DataFrame:
    """column, role (empty, numeric beyond 90 % numbers, categorical below 20 values or a fifth, else text, target), n_distinct.

    Cells and numbers are counted in one aggregate without a shuffle of rows. Values are told apart within tasks first
    (quantiles.distinct_counts), and only distinct ones are shuffled.
    """
    text = {c: F.trim(F.col(c).cast("string")) for c in columns}
    there = df.select(*[F.when(text[c] != "", text[c]).alias(f"x{i}") for i, c in enumerate(columns)])
    one = there.agg(*[f.alias(f"{k}{i}") for i in range(len(columns)) for k, f in (("t", F.count(f"x{i}")), ("n", F.count(parse_number(f"x{i}", decimal))))])
    n = distinct_counts(there, [f"x{i}" for i in range(len(columns))]).groupBy().pivot("column", [f"x{i}" for i in range(len(columns))]).agg(F.first("n_distinct"))
    one = one.crossJoin(F.broadcast(n.select(*[F.coalesce(f"x{i}", F.lit(0)).cast("long").alias(f"d{i}") for i in range(len(columns))])))  # one row each
    kind = [
        (c, [F.when(F.lit(c.lower().endswith("#target")), "target").when(F.col(f"t{i}") == 0, "empty").when(F.col(f"n{i}") > 0.9 * F.col(f"t{i}"), "numeric")
             .when((F.col(f"d{i}") < 0.2 * F.col(f"t{i}")) | (F.col(f"d{i}") < 20), "categorical").otherwise("text").alias("role"), F.col(f"d{i}").alias("n_distinct")])
        for i, c in enumerate(columns)
    ]
    return one.select(_rows(kind)).select("x.*")


def quality_report(df: DataFrame, numeric: list[str], categorical: list[str] = (), key: str = "row_idx") -> dict[str, object]:
    """Profiles, outlier counts, correlations, issues, recommendations and scores (0 to 100). Its size is that of the schema.

    The columns are settled once; the number of passes over them doesn't grow with their number. An empty table has a
    report too, whose numeric columns have no distribution.
    """
    columns = [*numeric, *categorical]
    with for_a_while(df.select(*dict.fromkeys([*([key] if key in df.columns else []), *columns]))) as table:
        return _report(table, list(numeric), columns)


def _counted(df: DataFrame, profile: dict[str, dict]) -> tuple[dict[str, int], dict[str, list[int]]]:
    """Outliers and histograms of all columns from one aggregate; a histogram of few values or a constant is empty."""
    spread = {c: p["count"] >= LEAST and p["max"] > p["min"] for c, p in profile.items()}
    finite = {c: math.isfinite(p["max"]) and math.isfinite(p["min"]) for c, p in profile.items() if spread[c]}
    drawn = [c for c in profile if spread[c] and finite[c]]
    sums = [F.count(_outlier(c, p)).alias(f"o_{i}") for i, (c, p) in enumerate(profile.items()) if p["q1"] is not None]
    for i, c in enumerate(profile):
        if c in drawn:
            at = _bin(F.col(c).cast("double"), profile[c]["min"], profile[c]["max"])
            sums += [F.count(F.when(at == b, 1)).alias(f"h_{i}_{b}") for b in range(BINS)]
    one = df.agg(*sums).first().asDict() if sums else {}
    found = {c: one.get(f"o_{i}", 0) for i, c in enumerate(profile)}
    return {c: n for c, n in found.items() if n}, {c: [one[f"h_{i}_{b}"] for b in range(BINS)] if c in drawn else [] for i, c in enumerate(profile)}


def issue_rows(spark: SparkSession, report: dict[str, object]) -> DataFrame:
    """level, kind, columns, advice of a report's issues; columns are joined by commas, none for those of the whole table."""
    rows = [(level, kind, ",".join(names), ADVICE[kind]) for level, kind, names in report["issues"]]
    return spark.createDataFrame(rows, "level string, kind string, columns string, advice string")


def _report(df: DataFrame, numeric: list[str], columns: list[str]) -> dict[str, object]:
    n = df.count()
    missing = {r["column"]: r for r in missing_profile(df, columns).collect()} if columns else {}
    profile = {r["column"]: r.asDict() for r in numeric_profile(df, numeric).collect()} if numeric else {}
    out_counts, drawn = _counted(df, profile)
    repeated = duplicate_rows(df, columns).first()[0] if columns else 0
    strong = [(r["a"], r["b"], r["r"]) for r in pearson_matrix(df, numeric).where("abs(r) > 0.95").collect()] if len(numeric) > 1 else []
    pct = 100 * sum(r["n_missing"] for r in missing.values()) / (n * len(columns)) if n and columns else 0.0
    issues: list[tuple[str, str, list[str]]] = []
    if pct > 10:
        issues.append(("error" if pct > 20 else "warning", "missing", []))
    issues += [("error", "missing", [c]) for c in columns if missing[c]["pct_missing"] > 50]
    if repeated:
        issues.append(("warning", "duplicate", []))
    issues += [("warning", "outlier", [c]) for c in numeric if profile[c]["count"] and out_counts.get(c, 0) > 0.1 * profile[c]["count"]]
    issues += [("warning", "correlation", [a, b]) for a, b, _ in strong]
    flat = [c for c in numeric if profile[c]["std"] is not None and profile[c]["std"] < 0.01]
    issues += [("info", "variance", [c]) for c in flat]
    for c in numeric:
        profile[c]["distribution"] = distribution(profile[c]["skewness"], profile[c]["kurtosis"], drawn[c])
    odd = [c for c in numeric if profile[c]["distribution"] != "normal"]
    if odd:
        issues.append(("info", "distribution", odd))
    score = 100 - 0.5 * pct - (30 * repeated / n if n else 0) - 5 * sum(missing[c]["pct_missing"] > 50 for c in columns) - (20 * sum(out_counts.values()) / (n * len(numeric)) if n and numeric else 0) - (20 if len(numeric) < 3 else 0)
    by_column = {
        c: min(100.0, max(0.0, 100 - 0.5 * missing[c]["pct_missing"] - (30 * out_counts.get(c, 0) / profile[c]["count"] if c in profile and profile[c]["count"] else 0) - (10 if c in flat else 0)))
        for c in columns
    }
    return {
        "rows": n, "missing_pct": pct, "duplicates": repeated, "profile": profile, "outliers": out_counts, "correlated": strong, "issues": issues, "recommendations": sorted({(k, ADVICE[k]) for _, k, _ in issues}),
        "score": min(100.0, max(0.0, score)), "column_scores": by_column,
    }
