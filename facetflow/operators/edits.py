"""Reversible edits of a table: each is a function from DataFrame to DataFrame, a history is a cursor over their results.

Rows are named by row_idx. Edits that remove or add rows renumber them, which takes counts by range and a projection.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetflow.operators.rows import range_width

Edit = Callable[[DataFrame], DataFrame]
MOST = 100


def renumber(df: DataFrame, *order: str) -> DataFrame:
    """row_idx from 0 without gaps, in the order of row_idx and then ``order``."""
    width = range_width(df)
    keyed = df.withColumn("__range", F.floor(F.col("row_idx") / F.lit(width)).cast("long"))
    counts = keyed.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__range", (F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__b"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy("row_idx", *order)) - 1 + F.col("__b")
    out = keyed.join(F.broadcast(before), "__range").withColumn("__row", place)  # a row a range
    return out.withColumn("row_idx", F.col("__row").cast("long")).drop("__range", "__b", "__row", *order)


def set_cell(row: int, column: str, value: object) -> Edit:
    return lambda df: df.withColumn(column, F.when(F.col("row_idx") == row, F.lit(value)).otherwise(F.col(column)))


def rename(column: str, new: str) -> Edit:
    def edit(df: DataFrame) -> DataFrame:
        if column not in df.columns or new in df.columns:
            raise ValueError(f"can't rename {column} to {new}")
        return df.withColumnRenamed(column, new)

    return edit


def delete_rows(rows: list[int]) -> Edit:
    return lambda df: renumber(df.where(~F.col("row_idx").isin(*rows)))


def delete_columns(columns: list[str]) -> Edit:
    return lambda df: df.drop(*columns)


def insert_row(at: int, **values: object) -> Edit:
    def edit(df: DataFrame) -> DataFrame:
        moved = df.withColumn("row_idx", F.when(F.col("row_idx") >= at, F.col("row_idx") + 1).otherwise(F.col("row_idx")).cast("long"))
        new = df.sparkSession.range(1).select(*[F.lit(at if c == "row_idx" else values.get(c)).cast(t).alias(c) for c, t in df.dtypes])
        return moved.unionByName(new)

    return edit


def insert_column(name: str, value: object = None) -> Edit:
    return lambda df: df.withColumn(name, F.lit(value).cast("string") if value is None else F.lit(value))


def duplicate_rows(rows: list[int], name_column: str | None = None) -> Edit:
    """Copies right after their rows; names get ``_copy``."""

    def edit(df: DataFrame) -> DataFrame:
        copy = F.when(F.col("row_idx").isin(*rows), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        out = df.withColumn("__copy", F.explode(copy))
        if name_column:
            out = out.withColumn(name_column, F.when(F.col("__copy") == 1, F.concat(F.col(name_column), F.lit("_copy"))).otherwise(F.col(name_column)))
        return renumber(out, "__copy")

    return edit


def toggle_target(column: str) -> Edit:
    """The suffix ``#target`` put on or taken off."""
    return lambda df: df.withColumnRenamed(column, column[: -len("#target")] if column.lower().endswith("#target") else f"{column}#target")


def fill_missing(columns: list[str], strategy: str, value: object = None) -> Edit:
    from facetflow.functions.transforms import impute

    return lambda df: impute(df, columns, strategy, value)


def transformed(kind: str, columns: list[str], **how: object) -> Edit:
    from facetflow.functions.transforms import apply

    return lambda df: apply(df, kind, columns, **how)[0]


def batch(edits: list[Edit]) -> Edit:
    """All edits or none: an edit that raises leaves the table as it was."""

    def edit(df: DataFrame) -> DataFrame:
        for e in edits:
            df = e(df)
        return df

    return edit


class History:
    """Tables after each edit, at most MOST of them, with undo and redo."""

    def __init__(self, df: DataFrame):
        self.states: list[tuple[str, DataFrame]] = [("", df)]
        self.at = 0

    @property
    def table(self) -> DataFrame:
        return self.states[self.at][1]

    def do(self, said: str, edit: Edit) -> DataFrame:
        self.states = [*self.states[: self.at + 1], (said, edit(self.table))][-MOST - 1 :]
        self.at = len(self.states) - 1
        return self.table

    def undo(self) -> DataFrame:
        self.at = max(0, self.at - 1)
        return self.table

    def redo(self) -> DataFrame:
        self.at = min(len(self.states) - 1, self.at + 1)
        return self.table
