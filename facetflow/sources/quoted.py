"""Records of delimited files whose quoted cells may hold newlines, cut in parallel from files of any size.

A newline ends a record unless the quotes before it in its file are odd in number. Each block of a file is read by a task
of its own, which doesn't know whether it begins inside of quotes. So a first pass maps either beginning of a block to its
end, and to the number of records that begin in it; those maps, a row a block, are composed along the files. A second pass
cuts the records. Only those that go on in another block are shuffled.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetflow.sources.scratch import settled

#: Blocks whose beginnings are broadcast, at most.
BLOCKS = 100_000
#: What a piece is: a whole record, the beginning of one, its end, or a block inside of one.
WHOLE, HEAD, END, INSIDE = range(4)
_MAPS = "file string, block long, odd int, outside long, inside long"
_PIECES = "file string, block long, kind int, at long, value string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and block, in order within blocks; odd: holds an odd number of quotes; blank: holds nothing."""
    value = F.col("value")
    quotes = F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))
    file, block = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    return spark.read.text(path, lineSep="\n").select(file, block, (quotes % 2 == 1).alias("odd"), value.isin("", "\r").alias("blank"), value)


def _runs(table: pd.DataFrame) -> Iterator[tuple[tuple[str, int], pd.DataFrame]]:
    """Neighbouring rows of one block."""
    change = (table["file"] != table["file"].shift()) | (table["block"] != table["block"].shift())
    starts = np.append(np.flatnonzero(change), len(table))
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        yield (table["file"].iloc[a], int(table["block"].iloc[a])), table.iloc[a:b]


def _maps(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each block: whether it turns the state, and records that begin in it, begun outside or inside of quotes."""
    own, state, begun = None, 0, [0, 0]
    for table in tables:
        done = []
        for key, rows in _runs(table):
            if key != own:
                done += [(*own, state, *begun)] if own else []
                own, state, begun = key, 0, [0, 0]
            odd, blank = rows["odd"].to_numpy(bool), rows["blank"].to_numpy(bool)
            before = (state + np.cumsum(odd) - odd) % 2
            for s in (0, 1):
                begun[s] += int(((before == s) & ~blank).sum())
            state = (state + int(odd.sum())) % 2
        yield pd.DataFrame(done, columns=["file", "block", "odd", "outside", "inside"])
    if own:
        yield pd.DataFrame([(*own, state, *begun)], columns=["file", "block", "odd", "outside", "inside"])


def _cut(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces of records; ``at`` counts the records that begin in the block, and is -1 for ends of earlier ones."""
    own, inside, at, open_ = None, 0, -1, []

    def left() -> list[tuple]:
        """What a block leaves open at its end."""
        return [(*own, INSIDE if at_open < 0 else HEAD, at_open, "\n".join(open_))] if own and inside else []

    at_open = -1
    for table in tables:
        out, plain = [], []
        for key, rows in _runs(table):
            if key != own:
                out += left()
                own, inside, at, open_, at_open = key, int(rows["inside"].iloc[0]), -1, [], -1
            odd, blank, value = rows["odd"].to_numpy(bool), rows["blank"].to_numpy(bool), rows["value"].to_numpy(object)
            before = (inside + np.cumsum(odd) - odd) % 2
            place = at + np.cumsum((before == 0) & ~blank)
            single = (before == 0) & ~odd & ~blank
            plain.append(pd.DataFrame({"file": key[0], "block": key[1], "kind": WHOLE, "at": place[single], "value": value[single]}))
            for i in np.flatnonzero(odd | (before == 1)):
                if before[i] == 0:
                    open_, at_open = [value[i]], int(place[i])
                    continue
                open_.append(value[i])
                if odd[i]:
                    out.append((*key, END if at_open < 0 else WHOLE, at_open, "\n".join(open_)))
            inside, at = (inside + int(odd.sum())) % 2, int(place[-1])
        yield pd.concat([*plain, pd.DataFrame(out, columns=["file", "block", "kind", "at", "value"])])
    last = left()
    if last:
        yield pd.DataFrame(last, columns=["file", "block", "kind", "at", "value"])


def records(spark: SparkSession, path: str, broadcast_blocks: int = BLOCKS) -> DataFrame:
    """file, place (from 0 within the file), row (from 0 over all files by name), files (with records, up to this one), value.

    Empty lines are no records; line ends within quotes are newlines. Quotes that are never closed raise. Null ``value``
    doesn't occur, and an empty folder has no records.
    """
    lines = _lines(spark, path)
    maps = lines.select("file", "block", "odd", "blank").mapInPandas(_maps, _MAPS)
    file = Window.partitionBy("file").orderBy("block")
    earlier = file.rowsBetween(Window.unboundedPreceding, -1)
    known = maps.withColumn("inside_at", (F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2).cast("int"))
    known = known.withColumn("n", F.when(F.col("inside_at") == 0, F.col("outside")).otherwise(F.col("inside")))
    known = known.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    along = Window.orderBy("file", "block")  # a row a block
    known = known.withColumns({
        "shift": F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "files": F.sum(((F.col("before") == 0) & (F.col("n") > 0)).cast("long")).over(along),
    })
    known = settled(known.select("file", "block", F.col("inside_at").alias("inside"), "before", "shift", "files", "odd"))  # a row a block
    s = known.agg(F.count(F.lit(1)).alias("n"), F.max("files").alias("files")).first()
    unclosed = known.groupBy("file").agg(F.sum("odd").alias("odd")).where("odd % 2 = 1").orderBy("file").first()
    if unclosed:
        raise ValueError(f"a quote is never closed in {unclosed['file']}")
    few = s["n"] <= broadcast_blocks
    beginnings = known.select("file", "block", "inside")
    if few:
        placed = lines.join(F.broadcast(beginnings), ["file", "block"])
    else:
        numbered = lines.withColumn("i", F.monotonically_increasing_id())
        placed = numbered.join(beginnings, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "i")
    pieces = placed.select("file", "block", "odd", "blank", "inside", "value").mapInPandas(_cut, _PIECES)
    whole = pieces.where(F.col("kind") == WHOLE).select("file", "block", "at", "value")
    rest = pieces.where(F.col("kind") != WHOLE)
    order = Window.partitionBy("file").orderBy("block", F.col("kind") == HEAD)  # an end comes before a beginning of its block
    head = F.when(F.col("kind") == HEAD, F.struct(F.col("block").alias("block"), F.col("at").alias("at")))
    rest = rest.withColumn("head", F.last(head, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("block", (F.col("kind") == HEAD).alias("last"), "value")))
    joined = rest.groupBy("file", "head").agg(parts.alias("parts"))
    # a record's first piece stands at the end of its block, its last one at the beginning of another, so blocks order them
    joined = joined.select("file", F.col("head.block").alias("block"), F.col("head.at").alias("at"), F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("value"))
    starts = known.select("file", "block", "before", "shift", "files")
    found = whole.unionByName(joined).join(F.broadcast(starts) if few else starts, ["file", "block"])
    text = F.regexp_replace(F.regexp_replace("value", "\r\n", "\n"), "\r$", "")
    return found.select("file", (F.col("before") + F.col("at")).alias("place"), (F.col("shift") + F.col("at")).alias("row"), "files", text.alias("value"))


def column_names(cells: list[str | None]) -> list[str]:
    """Names of columns: empty ones and repeats by their place."""
    seen: dict[str, int] = {}
    for c in cells:
        seen[(c or "").strip()] = seen.get((c or "").strip(), 0) + 1
    named = [(c or "").strip() for c in cells]
    return [f"_c{i}" if not c else f"{c}{i}" if seen[c] > 1 else c for i, c in enumerate(named)]


def cells(value: Column | str, names: list[str], delimiter: str, ragged: str | None = None) -> Column:
    """A record's cells as a struct of text, quotes doubled within quotes; ``ragged`` holds the record if its width differs."""
    quoted = ["`" + c.replace("`", "``") + "`" for c in names]
    how = {"sep": delimiter, "quote": '"', "escape": '"', "multiLine": "true", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    if ragged:
        how["columnNameOfCorruptRecord"] = ragged
        quoted.append(f"`{ragged}`")
    return F.from_csv(value, ", ".join(f"{c} string" for c in quoted), how)


def rows(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True, ragged: str | None = None, header_place: int = 0) -> DataFrame:
    """row_idx (from 0, without headers) and the cells as text, named by record ``header_place`` of the first file.

    Records before a file's header are left out. Files without a record there add no rows.
    """
    found = records(spark, path)
    first = found.where((F.col("row") == header_place) if header else (F.col("row") == 0)).select("value").first()
    if first is None:
        return spark.createDataFrame([], "row_idx long")
    mine = next(csv.reader(io.StringIO(first["value"], newline=""), delimiter=delimiter))
    names = column_names(mine) if header else [f"_c{i}" for i in range(len(mine))]
    skip = header_place + 1 if header else 0
    kept = found.where(F.col("place") >= skip).select((F.col("row") - skip * F.col("files")).alias("row_idx"), cells("value", names, delimiter, ragged).alias("c"))
    return kept.select("row_idx", "c.*")
