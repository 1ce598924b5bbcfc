"""Proportional stratified interleaving.

Rows of each source are put in a seeded random order; a row's fractional rank is (rank - 1/2) / rows of its source.
Sorted by fractional rank, any stretch of the table holds the sources in the proportions of the whole, so cutting the
sorted table into equal stretches gives shards that all match the mixture, with row counts at most one apart.

Ranks are found without putting a source, or the whole table, into one task: rows fall into sub-buckets by the
leading digits of their seeded hash (and then of their fractional rank), only the counts of the sub-buckets are summed
up along the order, and a row's rank is that offset plus its place within its own sub-bucket.

Nulls: a null source is a source of its own; rows with a null id are ordered by the rest of their columns. Repeated
rows are rows like others (equal ones are interchangeable). An empty table gives an empty result. Columns of the input
whose names begin with ``__`` followed by one of the helper names would clash and are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HELPERS = ("__stratum", "__hash", "__bucket", "__before", "__of", "__fraction", "__slice", "__start", "__place")


def stratified_interleave(
    rows: DataFrame, id_column: str = "doc_id", source_column: str = "source", shards: int = 8, seed: int = 17,
    tie_columns: tuple[str, ...] = (), rows_per_slice: int = 50_000,
) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 within the shard).

    tie_columns: further columns that order rows of equal id. rows_per_slice: about how many rows are sorted in a task.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    clash = [c for c in rows.columns if c in (*HELPERS, "shard", "slot")]
    if clash:
        raise ValueError(f"columns {clash} are in the way; rename them")
    total = rows.count()
    slices = max(1, min(1 << 20, -(-total // rows_per_slice)))
    digits = 2 if slices <= 16 else 3 if slices <= 256 else 4
    stratum = F.coalesce(F.concat(F.lit("s"), F.col(source_column).cast("string")), F.lit("null"))
    ties = F.concat_ws(":", F.lit("null"), *[F.col(c).cast("string") for c in tie_columns])
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), ties)).cast("binary"))
    keyed = rows.withColumns({"__stratum": stratum, "__hash": hashed}).withColumn("__bucket", F.substring("__hash", 1, digits))
    order: list[Column] = [F.col("__hash"), F.col(id_column), *(F.col(c) for c in tie_columns)]

    counts = keyed.groupBy("__stratum", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    along = Window.partitionBy("__stratum").orderBy("__bucket")
    counts = counts.select(
        "__stratum", "__bucket",
        (F.sum("__n").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__before"),
        F.sum("__n").over(Window.partitionBy("__stratum")).alias("__of"),
    )
    ranked = keyed.join(counts, ["__stratum", "__bucket"])
    rank = F.row_number().over(Window.partitionBy("__stratum", "__bucket").orderBy(*order)) + F.col("__before")
    ranked = ranked.withColumn("__fraction", (2 * rank - 1).cast("double") / (2 * F.col("__of")).cast("double"))
    ranked = ranked.withColumn("__slice", F.least(F.floor(F.col("__fraction") * slices), F.lit(slices - 1)).cast("long")).drop("__bucket", "__before", "__of")

    sizes = ranked.groupBy("__slice").agg(F.count(F.lit(1)).alias("__n"))
    sizes = sizes.select("__slice", (F.sum("__n").over(Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__start"))
    place = F.row_number().over(Window.partitionBy("__slice").orderBy("__fraction", "__stratum", *order)) + F.col("__start") - 1
    placed = ranked.join(sizes, "__slice").withColumn("__place", place.cast("long"))
    shard = F.expr(f"(__place * {shards}L) div {max(total, 1)}L")
    placed = placed.withColumn("shard", shard.cast("int"))
    slot = F.col("__place") - F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return placed.withColumn("slot", slot.cast("long")).drop(*HELPERS)


def shard_digest(documents: DataFrame, shards: int = 8, seed: int = 17) -> DataFrame:
    """Sizes, checksums and places of documents; the texts themselves aren't shuffled."""
    text = F.col("text").cast("binary")
    narrow = documents.select(
        "doc_id", "source",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("").cast("binary"))).cast("long").alias("text_crc32"),
    )
    placed = stratified_interleave(narrow, shards=shards, seed=seed, tie_columns=("text_crc32", "size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
