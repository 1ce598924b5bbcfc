"""Mean ranks of many columns at once, in a fixed number of shuffles.

Equal values of a column are counted first, all columns in one aggregate of (column, value). Of the columns with the fewest
distinct values, up to ``few`` of those in all, the sorted values and their ranks are sent to the tasks, and rows are ranked
where they are. Of the other columns the counted values are put in range order of (column, value) by one shuffle; a value's rank follows from the counts
before it in its range and the totals of the ranges before, which is a row a range and column; ranks go back to
the cells by a join on (column, value), in which values that many rows share are broadcast, and cells to their rows by key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from facetflow.sources.scratch import settled

FEW = 1_000_000
SHARED, HOT = 100_000, 10_000


def counted_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """c (number of the column), x, n of all values but nulls and NaNs."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"`{c}`").cast("double").alias("x")) for i, c in enumerate(columns)])).alias("v")
    return df.select(cells).select("v.*").where("x is not null and not isnan(x)").groupBy("c", "x").agg(F.count(F.lit(1)).alias("n"))


def mean_ranks(df: DataFrame, columns: list[str], few: int = FEW) -> DataFrame:
    """``df`` with each of the columns replaced by its rank among the column's values: ties share the mean of theirs,
    null and NaN have none."""
    if not columns:
        return df
    values = settled(counted_values(df, columns))
    sizes = {r["c"]: r["count"] for r in values.groupBy("c").count().collect()}  # a row a column
    low, held = [], 0
    for i in sorted(range(len(columns)), key=lambda i: sizes.get(i, 0)):
        held += sizes.get(i, 0)
        if held > few:
            break
        low.append(i)
    if low:
        df = _looked_up(df, columns, sorted(low), values.where(F.col("c").isin(low)))
    if len(low) == len(columns):
        return df
    high = {i: c for i, c in enumerate(columns) if i not in low}
    ranged = settled(values.where(F.col("c").isin(list(high))).repartitionByRange("c", "x").withColumn("range", F.spark_partition_id()))
    before = F.coalesce(F.sum("s").over(Window.partitionBy("c").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = ranged.groupBy("c", "range").agg(F.sum("n").alias("s")).select("c", "range", before.alias("base"))  # a row a range and column
    upto = F.sum("n").over(Window.partitionBy("c", "range").orderBy("x"))
    ranks = settled(ranged.withColumn("upto", upto).join(bases, ["c", "range"]).select("c", "x", "n", (F.col("base") + F.col("upto") - (F.col("n") - 1) / 2).alias("rank")))
    keyed = settled(df.withColumn("__key", F.monotonically_increasing_id()))
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"`{c}`").cast("double").alias("x")) for i, c in high.items()])).alias("v")
    cells = keyed.select("__key", cells).select("__key", "v.*").where("x is not null and not isnan(x)")
    # at most HOT values that more than SHARED cells hold
    hot = F.broadcast(ranks.where(f"n > {SHARED}").orderBy(F.desc("n")).limit(HOT).select(F.col("c").alias("hc"), F.col("x").alias("hx"), F.col("rank").alias("hot")))
    marked = cells.join(hot, (F.col("c") == F.col("hc")) & (F.col("x") == F.col("hx")), "left").drop("hc", "hx")
    found = marked.where("hot is not null").select("__key", "c", F.col("hot").alias("rank")).unionByName(
        marked.where("hot is null").select("__key", "c", "x").join(ranks.select("c", "x", "rank"), ["c", "x"]).select("__key", "c", "rank")
    )
    by_row = found.groupBy("__key").agg(F.map_from_entries(F.collect_list(F.struct("c", "rank"))).alias("__ranks"))  # a row's columns
    out = keyed.join(by_row, "__key", "left")
    return out.withColumns({c: F.element_at("__ranks", F.lit(i)) for i, c in high.items()}).select(*[F.col(f"`{c}`") for c in df.columns])


def _looked_up(df: DataFrame, columns: list[str], low: list[int], values: DataFrame) -> DataFrame:
    """``df`` with the ranks of the columns of those numbers."""
    cells = values.toArrow()  # at most ``few`` values
    c, x, n = (cells[k].to_numpy() for k in ("c", "x", "n"))
    order = np.lexsort((x, c))
    c, x, n = c[order], x[order], n[order]
    ends = np.searchsorted(c, np.arange(len(columns) + 1))
    tables = []
    for i in low:
        own = slice(int(ends[i]), int(ends[i + 1]))
        tables.append((x[own], np.cumsum(n[own]) - (n[own] - 1) / 2))
    sent = df.sparkSession.sparkContext.broadcast(tables)
    columns = [columns[i] for i in low]
    places = [df.columns.index(c) for c in columns]
    schema = StructType([StructField(f.name, DoubleType()) if f.name in columns else f for f in df.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = list(batch.columns)
            for at, (known, ranks) in zip(places, sent.value, strict=True):
                v = batch.column(at).to_numpy(zero_copy_only=False).astype(float)
                there = ~np.isnan(v)
                rank = np.full(len(v), np.nan)
                if len(known):
                    rank[there] = ranks[np.minimum(np.searchsorted(known, v[there]), len(known) - 1)]
                out[at] = pa.array(rank, mask=~there)
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return df.withColumns({c: F.col(f"`{c}`").cast("double") for c in columns}).mapInArrow(run, schema)
