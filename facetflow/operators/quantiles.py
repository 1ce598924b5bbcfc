"""Exact quantiles and modes without a task that holds all values.

Up to BUILT_IN rows the built-in aggregates are used, whose buffers are then bounded. Beyond, each wanted rank is enclosed
between two approximate quantiles; one aggregate counts what lies below and between, and the bounds close in until few
distinct values are left, which are counted exactly. Both ways give the same values.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUILT_IN, FEW = 1_000_000, 20_000
#: Values of a column, and their bytes, that a task tells apart before it sends them on.
HELD, HELD_BYTES = 50_000, 8 << 20


def _ranks(n: int, p: float, lower: bool) -> list[tuple[int, float]]:
    """(rank from 1, share) of the values that make the quantile: one, or two neighbours for interpolation."""
    if lower:
        return [(max(1, math.ceil(round(p * n, 9))), 1.0)]
    at = p * (n - 1)
    low = math.floor(at)
    return [(low + 1, 1.0)] if at == low else [(low + 1, 1 - (at - low)), (low + 2, at - low)]


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float], lower: bool = False, built_in: int = BUILT_IN) -> list[list[float | None]]:
    """Quantiles of each column without its nulls: interpolated, or ``lower``, the first value that reaches the share."""
    if not columns:
        return []
    x = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    counts = x.agg(*[F.count(f"x{i}").alias(f"x{i}") for i in range(len(columns))]).first()
    if max(counts) <= built_in:
        one = lambda i, p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY x{i})") if lower else F.percentile(f"x{i}", p)
        found = x.agg(*[one(i, p).alias(f"q{i}_{j}") for i in range(len(columns)) for j, p in enumerate(probabilities)]).first()
        return [[found[f"q{i}_{j}"] for j in range(len(probabilities))] for i in range(len(columns))]
    ranks = sorted({(i, r) for i, n in enumerate(counts) if n for p in probabilities for r, _ in _ranks(n, p, lower)})
    values = _selected(x, ranks, counts)
    return [[sum(share * values[i, r] for r, share in _ranks(n, p, lower)) if n else None for p in probabilities] for i, n in enumerate(counts)]


def _selected(x: DataFrame, ranks: list[tuple[int, int]], counts: list[int]) -> dict[tuple[int, int], float]:
    """The value of each (column, rank from 1)."""
    low = {t: -math.inf for t in ranks}
    high = {t: math.inf for t in ranks}
    inside = {t: counts[t[0]] for t in ranks}
    below = dict.fromkeys(ranks, 0)
    found: dict[tuple[int, int], float] = {}
    while True:
        within = {t: F.col(f"x{t[0]}").between(low[t], high[t]) for t in ranks if t not in found}
        open_ = [t for t in within if inside[t] > FEW]
        if not open_:
            break
        marks = x.agg(*[F.percentile_approx(F.when(within[t], F.col(f"x{t[0]}")), F.array(*[F.lit(q) for q in _around(t[1] - below[t], inside[t])]), 10_000).alias(f"t{k}") for k, t in enumerate(open_)]).first()
        edges = {t: sorted(set(marks[f"t{k}"])) for k, t in enumerate(open_)}
        cells = x.agg(*[F.count(F.when(within[t] & (F.col(f"x{t[0]}") <= e), 1)).alias(f"t{k}_{j}") for k, t in enumerate(open_) for j, e in enumerate(edges[t])]).first()
        less = x.agg(*[F.count(F.when(within[t] & (F.col(f"x{t[0]}") < e), 1)).alias(f"t{k}_{j}") for k, t in enumerate(open_) for j, e in enumerate(edges[t])]).first()
        for k, t in enumerate(open_):
            want, base, a, b, n = t[1] - below[t], 0, low[t], high[t], inside[t]
            for j, e in enumerate(edges[t]):
                under, upto = less[f"t{k}_{j}"], cells[f"t{k}_{j}"]
                if under < want <= upto:
                    found[t] = e
                    break
                if upto < want:
                    a, base = math.nextafter(e, math.inf), upto
                else:
                    b, n = math.nextafter(e, -math.inf), under
                    break
            low[t], high[t], below[t], inside[t] = a, b, below[t] + base, n - base
    rest = [t for t in ranks if t not in found]
    if rest:
        tags = F.explode(F.filter(F.array(*[F.when(within[t], F.struct(F.lit(k).alias("k"), F.col(f"x{t[0]}").alias("v"))) for k, t in enumerate(rest)]), lambda v: v.isNotNull())).alias("t")
        held: dict[int, list] = {}
        for r in x.select(tags).groupBy("t.k", "t.v").agg(F.count(F.lit(1)).alias("n")).collect():  # at most FEW a rank
            held.setdefault(r["k"], []).append((r["v"], r["n"]))
        for k, t in enumerate(rest):
            upto = below[t]
            for v, n in sorted(held[k]):
                upto += n
                if upto >= t[1]:
                    found[t] = v
                    break
    return found


def _around(rank: int, n: int) -> list[float]:
    p = rank / n
    return [min(1.0, max(0.0, p + d)) for d in (-3e-3, -6e-4, 0.0, 6e-4, 3e-3)]


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value (text), n for each value that isn't null."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")
    return df.select(cells).where("x.value is not null").groupBy("x.column", "x.value").agg(F.count(F.lit(1)).alias("n"))


def exact_mode(df: DataFrame, column: str) -> object:
    """The most frequent value, the smallest of several."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    most = counts.agg(F.max("n")).first()[0]
    return None if most is None else counts.where(F.col("n") == most).agg(F.min("v")).first()[0]


def distinct_counts(df: DataFrame, columns: list[str], held: int = HELD) -> DataFrame:
    """column, n_distinct, without null values; columns of nulls alone have no row.

    Each task tells the values of each column apart in a set of at most ``held`` values, which goes to the shuffle when it
    is full; so what is moved is distinct values, not cells.
    """

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: list[pa.Array] = [pa.array([], pa.large_string())] * len(columns)

        def sent(i: int) -> pa.RecordBatch:
            values, sets[i] = sets[i], pa.array([], pa.large_string())
            return pa.RecordBatch.from_arrays([pa.array([columns[i]] * len(values), pa.string()), values.cast(pa.string())], names=["column", "value"])

        for batch in batches:
            for i in range(len(columns)):
                sets[i] = pc.unique(pa.concat_arrays([sets[i], pc.unique(batch.column(i).drop_null()).cast(pa.large_string())]))
                if len(sets[i]) > held or sets[i].nbytes > HELD_BYTES:
                    yield sent(i)
        for i in range(len(columns)):
            if len(sets[i]):
                yield sent(i)

    text = df.select(*[F.col(c).cast("string").alias(f"x{i}") for i, c in enumerate(columns)])
    found = text.mapInArrow(apart, "column string, value string").distinct()
    return found.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
