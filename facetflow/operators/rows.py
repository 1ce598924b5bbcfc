"""Row numbers, selections, gaps and running quantities over an ordered table, without putting it into one task.

``row_idx`` (long, from 0) is the order of a table. What depends on the order is found in two phases: within ranges of
row_idx, and from range to range over a small table of one row each (at most RANGES).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of an ordered table, at most, and rows of a range, at least.
RANGES, RANGE_ROWS = 4096, 10_000
#: Values whose ranks are broadcast, at most, and rows that make a value a hot one.
HOT, SHARED = 10_000, 10_000


def parse_ranges(text: str) -> list[tuple[int, int]]:
    """'1,3-5' (from 1) as sorted, disjoint (from, to) pairs from 0, both ends included."""
    found = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        low, _, high = part.partition("-")
        try:
            a, b = int(low), int(high or low)
        except ValueError:
            raise ValueError(f"not a range: {part!r}") from None
        if a < 1 or b < a:
            raise ValueError(f"not a range: {part!r}")
        found.append((a - 1, b - 1))
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _in_ranges(ranges: list[tuple[int, int]]) -> Column:
    found = F.lit(False)
    for a, b in ranges:
        found = found | F.col("row_idx").between(a, b)
    return found


def _check_rows(df: DataFrame, last: int, first: int = 0) -> None:
    n = (df.agg(F.max("row_idx")).first()[0] if last >= 0 else None) or 0
    if first < 0 or last > n:
        raise ValueError(f"rows are from 0 to {n}, not {first if first < 0 else last}")


def named(df: DataFrame, columns: list[str | int]) -> list[str]:
    """Columns by name, or by number from 1 over those that aren't row_idx or row_name."""
    data = [c for c in df.columns if c not in ("row_idx", "row_name")]
    out = []
    for c in columns:
        if isinstance(c, int) or (c not in df.columns and c.isdigit()):
            if not 1 <= int(c) <= len(data):
                raise ValueError(f"columns are from 1 to {len(data)}, not {c}")
            out.append(data[int(c) - 1])
        elif c in df.columns:
            out.append(c)
        else:
            raise ValueError(f"no such column: {c}")
    return out


def exclude(df: DataFrame, rows: str | list[int] = "", columns: list[str | int] | None = None, check: bool = True) -> DataFrame:
    """``df`` without those rows (ranges from 1, or row numbers from 0) and columns (by name, or by number from 1).

    check: rows beyond the table raise, for which its last row number is looked up.
    """
    if rows:
        ranges = parse_ranges(rows) if isinstance(rows, str) else [(r, r) for r in sorted(set(rows))]
        if check:
            _check_rows(df, ranges[-1][1], ranges[0][0])
        df = df.where(~(_in_ranges(ranges) if isinstance(rows, str) else F.col("row_idx").isin(*rows)))
    return df.drop(*named(df, list(columns or [])))


def select(df: DataFrame, rows: list[int], columns: list[str], check: bool = True) -> DataFrame:
    """The listed rows in the order of the list, repeated as often as there, renumbered, with the listed columns.

    check: rows beyond the table raise.
    """
    spark = df.sparkSession
    if check and rows:
        _check_rows(df, max(rows), min(rows))
    places = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "__place long, __row long")
    found = places.join(df, places["__row"] == df["row_idx"], "inner")
    return found.select(F.col("__place").alias("row_idx"), *columns)


def drop_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)


def remove_outliers(df: DataFrame, columns: list[str], threshold: float = 3.0) -> DataFrame:
    """Rows of which no column is further than ``threshold`` sample deviations from its mean; constant columns don't count."""
    stats = df.agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    far = F.lit(False)
    for i, c in enumerate(columns):
        mean, sd = stats[f"m_{i}"], stats[f"s_{i}"]
        if sd:
            far = far | F.coalesce(F.abs(F.col(c) - mean) / sd > threshold, F.lit(False))
    return df.where(~far)


def range_width(df: DataFrame) -> int:
    """Rows to a range, so that there are at most RANGES of them."""
    last = df.agg(F.max("row_idx")).first()[0] or 0
    return max(RANGE_ROWS, -(-(last + 1) // RANGES))


def fill(df: DataFrame, columns: list[str], direction: str = "forward") -> DataFrame:
    """Missing cells filled with the last (forward) or next (backward) value in row order; outer gaps stay."""
    if direction not in ("forward", "backward"):
        raise ValueError("direction is forward or backward")
    width = range_width(df)
    keyed = df.withColumn("__range", F.floor(F.col("row_idx") / F.lit(width)).cast("long"))
    ahead = direction == "forward"
    pick = F.max_by if ahead else F.min_by
    ends = keyed.groupBy("__range").agg(*[pick(F.col(c), F.when(F.col(c).isNotNull(), F.col("row_idx"))).alias(f"__v{i}") for i, c in enumerate(columns)])
    # both ways run from the start of a window: one that ends at its end is worked out anew for each row
    turned = F.asc if ahead else F.desc
    along = Window.orderBy(turned("__range")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("__range", *[F.last(f"__v{i}", ignorenulls=True).over(along).alias(f"__c{i}") for i in range(len(columns))])
    w = Window.partitionBy("__range").orderBy(turned("row_idx")).rowsBetween(Window.unboundedPreceding, 0)
    out = keyed.join(F.broadcast(carried), "__range")  # at most RANGES rows
    return out.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.col(f"__c{i}")) for i, c in enumerate(columns)}).select(*df.columns)


def missing_pattern(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_missing, pattern: none, top, bottom, systematic (equal gaps beyond 1, three at least) or random."""
    total = df.agg(F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("low")).first()
    n, low = total["n"], total["low"] or 0
    width = range_width(df)
    long = df.select("row_idx", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).isNull().alias("gone")) for c in columns])).alias("x"))
    gone = long.where("x.gone").select("x.column", "row_idx", F.floor(F.col("row_idx") / F.lit(width)).alias("range"))
    w = Window.partitionBy("column", "range").orderBy("row_idx")
    gaps = gone.withColumn("gap", F.col("row_idx") - F.lag("row_idx").over(w))
    parts = gaps.groupBy("column", "range").agg(F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("first"), F.max("row_idx").alias("last"), F.min("gap").alias("least"), F.max("gap").alias("most"))
    parts = parts.withColumn("between", F.col("first") - F.lag("last").over(Window.partitionBy("column").orderBy("range")))
    found = parts.groupBy("column").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.min(F.least("least", "between")).alias("least"), F.max(F.greatest("most", "between")).alias("most"))
    dense = (F.col("last") - F.col("first") + 1) == F.col("n")
    pattern = (
        F.when(dense & (F.col("first") == low), "top").when(dense & (F.col("last") == low + n - 1), "bottom")
        .when((F.col("n") > 2) & (F.col("least") == F.col("most")) & (F.col("least") > 1), "systematic").otherwise("random")
    )
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    found = names.join(found.select("column", "n", pattern.alias("pattern")), "column", "left")
    return found.select("column", F.coalesce("n", F.lit(0)).cast("long").alias("n_missing"), F.coalesce("pattern", F.lit("none")).alias("pattern"))


def average_rank(df: DataFrame, column: str, name: str = "rank") -> DataFrame:
    """``df`` with the rank of the column's value (ties share the mean rank; null has none).

    Equal values are counted first; the distinct values are cut at approximate quantiles and numbered within the cuts.
    """
    x = F.col(column).cast("double")
    values = df.where(F.col(column).isNotNull()).groupBy(x.alias("__x")).agg(F.count(F.lit(1)).alias("__n"))
    probabilities = [i / 256 for i in range(1, 256)]
    cuts = sorted(set(values.agg(F.percentile_approx("__x", F.array(*[F.lit(p) for p in probabilities]), 10_000)).first()[0] or []))
    if cuts:
        values = values.withColumn("__cut", F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("__x"))))
    else:
        values = values.withColumn("__cut", F.lit(0))
    sums = values.groupBy("__cut").agg(F.sum("__n").alias("__s"))
    before = sums.select("__cut", (F.sum("__s").over(Window.orderBy("__cut").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__s")).alias("__b"))
    w = Window.partitionBy("__cut").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    through = F.sum("__n").over(w)
    ranked = values.join(F.broadcast(before), "__cut").select("__x", "__n", (F.col("__b") + through - (F.col("__n") - 1) / 2).alias(name))  # 256 rows
    few = ranked.orderBy(F.desc("__n"), "__x").limit(HOT)
    if ranked.limit(HOT + 1).count() <= HOT:
        return df.join(F.broadcast(few.drop("__n")), x == F.col("__x"), "left").drop("__x")
    # values that many rows share are looked up where the rows are; only the others are shuffled
    hot = few.where(f"__n > {SHARED}").select(F.col("__x").alias("__h"), F.col(name).alias("__hot"))
    marked = df.join(F.broadcast(hot), x == F.col("__h"), "left")  # at most HOT rows
    cold = ranked.drop("__n").withColumnRenamed(name, "__cold")
    key = F.when(F.col("__hot").isNull(), x).otherwise(-F.pmod(F.xxhash64("row_idx") if "row_idx" in df.columns else F.monotonically_increasing_id(), F.lit(1 << 20)).cast("double") - 0.5)
    joined = marked.withColumn("__key", key).join(cold, (F.col("__key") == F.col("__x")) & F.col("__hot").isNull(), "left")
    return joined.withColumn(name, F.coalesce("__hot", "__cold")).drop("__h", "__hot", "__cold", "__x", "__key")


def head_and_tail(df: DataFrame, head: int = 20, tail: int = 5) -> DataFrame:
    """The first and last rows in row order, as shown on a console."""
    n = df.count()
    return df.where((F.col("row_idx") < head) | (F.col("row_idx") >= max(n - tail, head))).orderBy("row_idx")


def decimate(df: DataFrame, target: int) -> DataFrame:
    """Every k-th row so that about ``target`` remain, the last one included."""
    n = df.count()
    step = max(1, -(-n // max(target, 1)))
    return df.where((F.col("row_idx") % step == 0) | (F.col("row_idx") == n - 1))
