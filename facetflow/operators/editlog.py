"""Edits of a large table as an order index beside it, merged on read.

The rows of the base table are never moved. A state says, as pieces in the order of the edited table, which stretches
of the base's rows follow each other: ``Piece(start, length)`` for rows start, start + 1, ..., and pieces of length 1
with cells of their own for rows that were changed, copied or inserted. An edit cuts the pieces that it touches, at the
driver, without a job: rows before and after an inserted, copied or deleted one are not read, let alone renumbered.
A position is found by bisection on the pieces' running lengths.

``EditLog.table`` merges: pieces are dealt to blocks of the base's row numbers (at most BLOCKS of them, and one row more a
piece), broadcast up to LARGE of those, and joined by block. A row's new number is its piece's place plus its distance
from the piece's begin; deleted rows are in no piece, copied ones in several. So a table after any number of edits is one
join, one union with the inserted rows and one projection, whose depth doesn't grow with the edits. Without LARGE many
pieces nothing is shuffled.

Columns are an index of their own: renaming, deleting and inserting change names, not cells; cells stay with the column
that they were set in. Edits of whole columns by statistics (fills, transforms) settle the table in the shared folder
and go on from there; undo returns to the base before.

The base has ``row_idx`` from 0 without gaps or repeats, which is checked by one aggregate; a table where that isn't so
is numbered anew in the order of row_idx. Nulls are cells like others. Empty tables take rows at 0. Positions and columns
that aren't there raise, and leave the log as it was.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from itertools import accumulate
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType, LongType, StringType, StructField, StructType

from facetflow.operators.edits import MOST, Edit, renumber
from facetflow.sources.scratch import settled

#: Blocks of row numbers that pieces are dealt to, and the number of dealt pieces up to which they are broadcast.
BLOCKS, LARGE = 4096, 200_000
COPY = "_copy"
TARGET = "#target"


@dataclass(frozen=True)
class Suffix:
    """A cell that reads as the base's own with ``times`` times the suffix of copies."""

    times: int

    def of(self, value: str | None) -> str | None:
        return None if value is None else value + COPY * self.times


@dataclass(frozen=True)
class Piece:
    """Rows start to start + length - 1 of the base, or one inserted row (start None); cells: what columns hold instead."""

    start: int | None
    length: int
    cells: Mapping[int, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Field:
    """A column of the table: that of the base of this name, or (source None) one that was inserted with a value."""

    key: int
    name: str
    kind: DataType
    source: str | None
    value: Any = None


@dataclass(frozen=True)
class State:
    said: str
    base: DataFrame
    pieces: tuple[Piece, ...]
    columns: tuple[Field, ...]

    @property
    def rows(self) -> int:
        return sum(p.length for p in self.pieces)


def _numbered(df: DataFrame) -> tuple[DataFrame, int]:
    """(a table with row_idx from 0 without gaps or repeats, its number of rows)."""
    df = df.withColumn("row_idx", F.col("row_idx").cast("long"))
    facts = [F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("least"), F.max("row_idx").alias("most"), F.bit_xor(F.xxhash64("row_idx")).alias("x")]
    found = df.agg(*facts).first()
    n = found["n"]
    if not n:
        return df, 0
    right = found["least"] == 0 and found["most"] == n - 1
    if right and found["x"] == df.sparkSession.range(n).agg(F.bit_xor(F.xxhash64("id")).alias("x")).first()["x"]:
        return df, n
    return settled(renumber(df)), n


def _cut(pieces: Sequence[Piece], positions: Sequence[int]) -> list[Piece]:
    """The pieces, cut so that each of the positions (ascending) begins one or is the end."""
    out: list[Piece] = []
    at, i = 0, 0
    for p in pieces:
        begin, rest = at, p
        while i < len(positions) and positions[i] < at + p.length:
            if positions[i] > begin and rest.start is not None:
                n = positions[i] - begin
                out.append(replace(rest, length=n))
                rest = replace(rest, start=rest.start + n, length=rest.length - n)
                begin = positions[i]
            i += 1
        out.append(rest)
        at += p.length
    return out


def _joined(pieces: Sequence[Piece]) -> tuple[Piece, ...]:
    """Neighbours without cells of their own that follow each other in the base too are one piece."""
    out: list[Piece] = []
    for p in pieces:
        last = out[-1] if out else None
        if last and last.start is not None and last.start + last.length == p.start and not last.cells and not p.cells:
            out[-1] = Piece(last.start, last.length + p.length)
        else:
            out.append(p)
    return tuple(out)


class EditLog:
    """A table under edits, with undo and redo of the last ``most`` of them."""

    def __init__(self, df: DataFrame, most: int = MOST):
        self.most = most
        self.states = [self._on(df, "")]
        self.at = 0

    @staticmethod
    def _on(df: DataFrame, said: str) -> State:
        base, n = _numbered(df)
        columns = [Field(i, f.name, f.dataType, f.name) for i, f in enumerate(f for f in base.schema.fields if f.name != "row_idx")]
        return State(said, base, (Piece(0, n),) if n else (), tuple(columns))

    @property
    def state(self) -> State:
        return self.states[self.at]

    @property
    def history(self) -> list[str]:
        """What was done, in order, up to where undo has gone back."""
        return [s.said for s in self.states[1 : self.at + 1]]

    def _do(self, said: str, **changes: Any) -> EditLog:
        return self._go(replace(self.state, said=said, **changes))

    def _go(self, state: State) -> EditLog:
        self.states = [*self.states[: self.at + 1], state][-self.most - 1 :]
        self.at = len(self.states) - 1
        return self

    def undo(self) -> EditLog:
        self.at = max(0, self.at - 1)
        return self

    def redo(self) -> EditLog:
        self.at = min(len(self.states) - 1, self.at + 1)
        return self

    # --- positions and columns --------------------------------------------------------------------------------------

    def _column(self, name: str) -> int:
        for i, c in enumerate(self.state.columns):
            if c.name == name:
                return i
        raise ValueError(f"no column {name}")

    def _new_name(self, name: str) -> None:
        if name == "row_idx" or name in [c.name for c in self.state.columns]:
            raise ValueError(f"a column {name} is there already")

    def _single(self, positions: Sequence[int]) -> tuple[list[Piece], list[int]]:
        """(pieces with one of its own for each position, where those are)."""
        wanted = sorted(set(positions))
        if wanted and (wanted[0] < 0 or wanted[-1] >= self.state.rows):
            raise ValueError(f"rows are 0 to {self.state.rows - 1}")
        pieces = _cut(self.state.pieces, sorted({x for p in wanted for x in (p, p + 1)}))
        begins = list(accumulate((p.length for p in pieces), initial=0))[:-1]
        return pieces, [bisect_right(begins, p) - 1 for p in wanted]

    @staticmethod
    def _fitting(column: Field, value: object) -> object:
        return float(value) if isinstance(column.kind, (DoubleType, FloatType)) and isinstance(value, int) else value

    # --- edits ----------------------------------------------------------------------------------------------------------

    def set_cell(self, row: int, column: str, value: object) -> EditLog:
        of = self.state.columns[self._column(column)]
        pieces, (i,) = self._single([row])
        pieces[i] = replace(pieces[i], cells={**pieces[i].cells, of.key: self._fitting(of, value)})
        return self._do(f"set {column} of row {row}", pieces=tuple(pieces))

    def insert_row(self, at: int, **values: object) -> EditLog:
        """A row before the one at ``at``, or after the last one; columns without a value are null."""
        if not 0 <= at <= self.state.rows:
            raise ValueError(f"rows can be inserted at 0 to {self.state.rows}")
        given = [(self.state.columns[self._column(c)], v) for c, v in values.items()]
        cells = {c.key: None for c in self.state.columns} | {c.key: self._fitting(c, v) for c, v in given}
        pieces = _cut(self.state.pieces, [at])
        begins = list(accumulate((p.length for p in pieces), initial=0))
        return self._do(f"insert a row at {at}", pieces=(*pieces[: begins.index(at)], Piece(None, 1, cells), *pieces[begins.index(at) :]))

    def delete_rows(self, rows: Sequence[int]) -> EditLog:
        pieces, gone = self._single(rows)
        out = set(gone)
        return self._do(f"delete {len(out)} rows", pieces=_joined([p for i, p in enumerate(pieces) if i not in out]))

    def duplicate_rows(self, rows: Sequence[int], name_column: str | None = None) -> EditLog:
        """Copies right after their rows; texts of ``name_column`` get ``_copy``."""
        named = None if name_column is None else self.state.columns[self._column(name_column)]
        pieces, which = self._single(rows)
        twice, out = set(which), []
        for i, p in enumerate(pieces):
            out.append(p)
            if i in twice:
                out.append(p if named is None else replace(p, cells={**p.cells, named.key: self._copied(p, named)}))
        return self._do(f"duplicate {len(twice)} rows", pieces=tuple(out))

    @staticmethod
    def _copied(piece: Piece, column: Field) -> object:
        own = piece.cells.get(column.key, column.value if column.source is None else Suffix(0))
        return Suffix(own.times + 1) if isinstance(own, Suffix) else Suffix(1).of(own)

    def rename(self, column: str, new: str) -> EditLog:
        i = self._column(column)
        self._new_name(new)
        columns = list(self.state.columns)
        columns[i] = replace(columns[i], name=new)
        return self._do(f"rename {column} to {new}", columns=tuple(columns))

    def toggle_target(self, column: str) -> EditLog:
        """The suffix ``#target`` put on or taken off."""
        return self.rename(column, column[: -len(TARGET)] if column.lower().endswith(TARGET) else column + TARGET)

    def delete_columns(self, names: Sequence[str]) -> EditLog:
        gone = {self._column(c) for c in names}
        return self._do(f"delete {len(gone)} columns", columns=tuple(c for i, c in enumerate(self.state.columns) if i not in gone))

    def insert_column(self, name: str, value: object = None, at: int | None = None, kind: DataType | None = None) -> EditLog:
        """A column with one value in all rows, before the one at ``at`` or after the last; texts unless ``kind`` says else."""
        self._new_name(name)
        columns = list(self.state.columns)
        new = Field(1 + max((c.key for s in self.states for c in s.columns), default=0), name, kind or StringType(), None, value)
        columns.insert(len(columns) if at is None else at, new)
        return self._do(f"insert column {name}", columns=tuple(columns))

    def apply(self, said: str, edit: Edit) -> EditLog:
        """An edit of whole columns, as those of ``edits``, on the settled table: the log goes on from its result."""
        return self._go(self._on(settled(edit(self.table)), said))

    def batch(self, said: str, edits: Sequence[tuple[str, tuple]]) -> EditLog:
        """Edits (method, arguments) as one step of the history, all of them or none."""
        before, at = self.states, self.at
        try:
            for name, arguments in edits:
                getattr(self, name)(*arguments)
        except Exception:
            self.states, self.at = before, at
            raise
        last = self.state
        self.states, self.at = before, at
        return self._go(replace(last, said=said))

    # --- merging ----------------------------------------------------------------------------------------------------------

    @property
    def table(self) -> DataFrame:
        """The edited table, row_idx first, in no particular order of rows."""
        state = self.state
        spark, columns = state.base.sparkSession, state.columns
        changed = [c for c in columns if any(c.key in p.cells for p in state.pieces if p.start is not None)]
        schema = StructType([StructField("row_idx", LongType()), *[StructField(c.name, c.kind) for c in columns]])
        # numbers of the edit's own for column names: names may clash with anything
        kinds = [StructField(f"__{x}", LongType()) for x in ("start", "length", "to")]
        for c in changed:
            kinds += [StructField(f"__how{c.key}", LongType()), StructField(f"__new{c.key}", c.kind)]
        kept, inserted, to = [], [], 0
        for p in state.pieces:
            if p.start is None:
                inserted.append((to, *[p.cells.get(c.key, c.value) for c in columns]))
            else:
                row: list[Any] = [p.start, p.length, to]
                for c in changed:
                    cell = p.cells.get(c.key, Suffix(0))
                    row += [cell.times, None] if isinstance(cell, Suffix) else [-1, cell]
                kept.append(tuple(row))
            to += p.length
        width = max(1, -(-max((p[0] + p[1] for p in kept), default=1) // BLOCKS))
        blocks = F.sequence(F.floor(F.col("__start") / width), F.floor((F.col("__start") + F.col("__length") - 1) / width))
        index = spark.createDataFrame(kept, StructType(kinds)).withColumn("__block", F.explode(blocks))
        if BLOCKS + len(kept) <= LARGE:
            index = F.broadcast(index)
        needed = [F.col("row_idx").alias("__row"), F.floor(F.col("row_idx") / width).alias("__at")]
        sources = [c for c in columns if c.source is not None]
        base = state.base.select(*needed, *[F.col(f"`{c.source}`").alias(f"__own{c.key}") for c in sources])
        within = F.col("__row").between(F.col("__start"), F.col("__start") + F.col("__length") - 1)
        both = base.join(index, (F.col("__at") == F.col("__block")) & within)
        out = [(F.col("__to") + F.col("__row") - F.col("__start")).alias("row_idx")]
        for c in columns:
            own = F.col(f"__own{c.key}") if c.source is not None else F.lit(c.value).cast(c.kind)
            if c in changed:
                how = F.col(f"__how{c.key}")
                if isinstance(c.kind, StringType):
                    own = F.when(how > 0, F.concat(own, F.expr(f"repeat('{COPY}', cast(__how{c.key} as int))"))).otherwise(own)
                own = F.when(how < 0, F.col(f"__new{c.key}")).otherwise(own)
            out.append(own.alias(c.name))
        merged = both.select(*out)
        return merged.unionByName(spark.createDataFrame(inserted, schema)) if inserted else merged
