"""Checks of tables before an analysis: column statistics, missing cells, structure, parameters, readiness.

Statistics are one aggregate of the size of the schema; what is said about them is built on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Below this a sample variance counts as none; above this share of missing cells a column is warned about.
NO_VARIANCE, MOSTLY_MISSING = 1e-10, 50.0
#: Rows beyond which a table is called large.
LARGE = 10_000


def _stack(pairs: list[tuple[str, list[Column]]]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(name).alias("column"), *own) for name, own in pairs])).alias("x")


def _value(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def column_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, missing, non_missing, missing_pct, min, max, mean, std (sample), zero_variance; NaN counts as missing."""
    stats = {"n": F.count, "min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_samp}
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[f(_value(c)).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in stats.items()])
    of = lambda i: [
        (F.col("rows") - F.col(f"n{i}")).alias("missing"), F.col(f"n{i}").alias("non_missing"),
        F.coalesce(F.try_divide(F.lit(100.0) * (F.col("rows") - F.col(f"n{i}")), F.col("rows")), F.lit(0.0)).alias("missing_pct"),
        *[F.col(f"{k}{i}").alias(k) for k in ("min", "max", "mean", "std")],
        F.coalesce((F.col(f"n{i}") > 1) & (F.col(f"std{i}") * F.col(f"std{i}") < NO_VARIANCE), F.lit(False)).alias("zero_variance"),
    ]
    return one.select(_stack([(c, of(i)) for i, c in enumerate(columns)])).select("x.*")


@dataclass
class Findings:
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def valid(self) -> bool:
        return not self.errors


def validate(df: DataFrame, columns: list[str], strict: bool = False) -> Findings:
    """Columns without any value are errors; near-zero variance and mostly missing cells are warnings, errors if strict."""
    out = Findings()
    found = column_statistics(df, columns).collect()  # a row a column
    if not found or found[0]["missing"] + found[0]["non_missing"] == 0:
        out.errors.append("the table is empty")
        return out
    for r in found:
        if not r["non_missing"]:
            out.errors.append(f"column {r['column']} holds only missing values")
            continue
        if r["zero_variance"]:
            out.warnings.append(f"column {r['column']} has near-zero variance")
        if r["missing_pct"] > MOSTLY_MISSING:
            out.warnings.append(f"column {r['column']} has {r['missing_pct']:.1f}% missing values")
    if strict:
        out.errors, out.warnings = out.errors + out.warnings, []
    return out


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """n_rows, n_columns, n_missing, missing_pct, memory (of about ten bytes a cell)."""
    gone = sum((F.count(F.when(_value(c).isNull() if t not in ("string", "boolean") else F.col(c).isNull(), 1)) for c, t in df.dtypes if c in columns), F.lit(0))
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), gone.cast("long").alias("n_missing"))
    cells = F.col("n_rows") * len(columns)
    return one.select("n_rows", F.lit(len(columns)).alias("n_columns"), "n_missing", F.coalesce(F.try_divide(F.lit(100.0) * F.col("n_missing"), cells), F.lit(0.0)).alias("missing_pct"), memory(cells * 10).alias("memory"))


def memory(size: Column) -> Column:
    """Bytes in the largest unit that fits, with one digit."""
    out = F.format_string("%.1f GB", size / float(1 << 30))
    for limit, unit in ((1 << 30, "MB"), (1 << 20, "KB")):
        out = F.when(size < limit, F.format_string(f"%.1f {unit}", size / float(limit >> 10))).otherwise(out)
    return F.when(size < 1024, F.format_string("%d B", size.cast("long"))).otherwise(out)


def missing_info(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: columns_with_missing, rows_affected, total_missing, total_pct."""
    any_gone = F.exists(F.array(*[F.col(c).isNull() for c in columns]), lambda x: x)
    one = df.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(any_gone, 1)).alias("rows_affected"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"m{i}") for i, c in enumerate(columns)])
    parts = [F.col(f"m{i}") for i in range(len(columns))]
    total = sum(parts, F.lit(0))
    return one.select(
        sum(((p > 0).cast("int") for p in parts), F.lit(0)).alias("columns_with_missing"), "rows_affected", total.cast("long").alias("total_missing"),
        F.coalesce(F.try_divide(F.lit(100.0) * total, F.col("n") * len(columns)), F.lit(0.0)).alias("total_pct"),
    )


def missing_by_row(df: DataFrame, columns: list[str], key: str = "row_idx", all_rows: bool = False) -> DataFrame:
    """key, n_missing, pct_missing of the rows with missing cells, or of all."""
    n = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    out = df.select(key, n.alias("n_missing"), (100.0 * n / max(len(columns), 1)).alias("pct_missing"))
    return out if all_rows else out.where("n_missing > 0")


def missing_analysis(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_missing, pct_missing, pattern."""
    from facetflow.operators.profile import missing_profile
    from facetflow.operators.rows import missing_pattern

    return missing_profile(df, columns).join(F.broadcast(missing_pattern(df, columns).select("column", "pattern")), "column")  # a row a column


def check_structure(df: DataFrame, features: list[str], columns: int | None = None) -> None:
    """At least two rows and one feature, all of them there, and as many columns as expected."""
    gone = [c for c in features if c not in df.columns]
    if gone:
        raise ValueError(f"no such columns: {gone}")
    if not features:
        raise ValueError("needs at least one feature")
    if columns is not None and len(df.columns) != columns:
        raise ValueError(f"{len(df.columns)} columns, expected {columns}")
    if len(df.select(features[0]).take(2)) < 2:
        raise ValueError("needs at least two rows")


def check_no_missing(df: DataFrame, features: list[str], allowed: bool = False) -> None:
    if not allowed:
        wrong = [r["column"] for r in column_statistics(df, features).where("missing > 0").collect()]
        if wrong:
            raise ValueError(f"missing values in {wrong}; handle them first")


def most_components(rows: int, columns: int) -> int:
    return min(rows, columns)


def check_components(k: int, most: int) -> None:
    if k < 1:
        raise ValueError(f"components must be positive, not {k}")
    if k > most:
        raise ValueError(f"at most {most} components, not {k}")


def check_kernel(kernel: str, gamma: float = 0.0, degree: int = 1) -> None:
    if not kernel:
        raise ValueError("a kernel must be named")
    if kernel not in ("rbf", "linear", "poly", "polynomial"):
        raise ValueError(f"no kernel {kernel!r}")
    if kernel != "linear" and gamma < 0:
        raise ValueError("gamma must not be negative")
    if kernel in ("poly", "polynomial") and degree < 1:
        raise ValueError("degree must be at least 1")


def check_input(df: DataFrame, features: list[str], k: int, method: str = "svd", missing: str = "error") -> None:
    """All that a fit asks of its input."""
    check_structure(df, features)
    check_no_missing(df, features, allowed=method == "nipals" and missing == "native" or missing not in ("error", "native"))
    check_components(k, most_components(df.count(), len(features)))


def check_number(value: object, low: float, high: float, whole: bool = False) -> float:
    """A number of user input within bounds."""
    try:
        number = float(value)
    except (TypeError, ValueError):
        raise ValueError(f"not a number: {value!r}") from None
    if number != number or not low <= number <= high or (whole and number != int(number)):
        raise ValueError(f"{value!r} isn't {'a whole number ' if whole else ''}from {low} to {high}")
    return int(number) if whole else number


def check_text(value: str, most: int) -> str:
    if not isinstance(value, str) or len(value) > most or any(ord(x) < 32 and x not in "\t\n\r" for x in value):
        raise ValueError(f"not a text of at most {most} characters without control characters")
    return value


def check_delimiter(value: str) -> str:
    if value not in (",", ";", "\t", "|", " ", ":"):
        raise ValueError(f"no delimiter: {value!r}")
    return value


def readiness(df: DataFrame, numeric: list[str], categorical: list[str] = (), targets: list[str] = (), row_names: bool = False) -> list[tuple[str, str]]:
    """(level, message) of what stands against a component analysis, or should be known before it."""
    columns = [*numeric, *categorical, *targets]
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    n, gone = one["n"], {c: one["n"] - one[f"c{i}"] for i, c in enumerate(columns)}
    said = [("ERROR", f"at least two rows are needed, not {n}")] if n < 2 else []
    said += [("WARNING", f"column {c} has {100 * g / n:.1f}% missing values") for c, g in gone.items() if n and 100 * g / n > MOSTLY_MISSING]
    said += [("INFO", f"{len(x)} {kind} columns are left out of the analysis but available for plots") for kind, x in (("categorical", categorical), ("target", targets)) if x]
    if len(numeric) < 2:
        said.append(("ERROR", f"at least two numeric columns are needed, not {len(numeric)}"))
    elif len(numeric) < 3:
        said.append(("WARNING", f"only {len(numeric)} numeric columns"))
    else:
        said.append(("INFO", f"{len(numeric)} numeric columns are analysed"))
    total = sum(gone.values())
    if total:
        said.append(("INFO", f"{100 * total / (n * len(columns)):.1f}% missing values ({total} cells)"))
    if n > LARGE:
        said.append(("INFO", f"large table ({n} rows)"))
    if row_names:
        said.append(("INFO", "the first column names rows"))
    return said


def is_ready(said: list[tuple[str, str]]) -> bool:
    return all(level != "ERROR" for level, _ in said)
