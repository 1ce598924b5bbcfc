"""Vector bin packing of tokenised documents into training sequences.

Each sequence has three limits at once: tokens, segments (pieces) and loss-bearing tokens. A document fills whole
sequences first; what remains is an item with a demand in the three dimensions. Items are placed by the dot-product
heuristic: the open sequence takes the fitting item whose demand has the largest dot product with what is still free,
so a sequence short of segments prefers long items and one short of loss-bearing tokens prefers prompts. When no item
fits, or one segment is left, an item is cut to fill the gap exactly. A partition's last, partly filled sequence is cut
at powers of two, which need no padding. So only a sequence that runs out of segments or loss is padded.

Each task packs the rows of its own partition in windows of ``window`` items: nothing is shuffled, memory is bounded
by an Arrow batch and the window, and a lost task is repeated with the same result.

Null texts are empty and hold only the end token; null ids are kept as null; repeated rows are packed each; an empty
table gives no rows. Columns besides ``doc_id``, ``text`` and ``loss_column`` are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetflow.llm._words import trimmed
from facetflow.llm.wordbpe import WordEncoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


class Packer:
    """Packs items in the order of windows. An item: (document, from, to, first loss-bearing position)."""

    def __init__(self, length: int, segments: int, loss: int, window: int, first_id: int):
        self.length, self.segments, self.loss, self.window = length, segments, loss, window
        self.next_id = first_id
        self.waiting: list[list[int]] = []
        self.placed: list[tuple[int, int, int, int, int]] = []  # document, from, to, sequence, offset

    def put(self, doc: int, a: int, b: int, sequence: int, offset: int) -> None:
        self.placed.append((doc, a, b, sequence, offset))

    def add(self, doc: int, tokens: int, loss_from: int) -> None:
        a = 0
        while tokens - a >= self.length and self._loss(a, a + self.length, loss_from) <= self.loss:
            self.put(doc, a, a + self.length, self.next_id, 0)
            self.next_id += 1
            a += self.length
        if a < tokens:
            self.waiting.append([doc, a, tokens, loss_from])

    def _loss(self, a: int, b: int, loss_from: int) -> int:
        return max(0, b - max(a, loss_from))

    def pack(self, final: bool = False) -> None:
        """Packs whole windows, or, if final, all that waits."""
        while self.waiting and (final or len(self.waiting) >= self.window):
            self._window([self.waiting.pop() for _ in range(min(self.window, len(self.waiting)))], final and not self.waiting)

    def _window(self, items: list[list[int]], final: bool) -> None:
        n = len(items)
        at = np.array(items, dtype=np.int64).reshape(n, 4)
        need = np.empty((n, 3))
        live = np.ones(n, bool)

        def measure(i: int | slice) -> None:
            a, b, c = at[i, 1], at[i, 2], at[i, 3]
            need[i, 0] = (b - a) / self.length
            need[i, 1] = 1 / self.segments
            need[i, 2] = np.maximum(0, b - np.maximum(a, c)) / self.loss

        measure(slice(None))
        left = n
        while left:
            free = np.ones(3)
            used, pieces, sequence = 0, 0, []
            while left and used < self.length and pieces < self.segments:
                fits = live & (need <= free + 1e-12).all(axis=1)
                i = -1
                if pieces < self.segments - 1 or left == 1:
                    score = np.where(fits, need @ free, -1.0)
                    i = int(score.argmax())
                    i = i if score[i] >= 0 else -1
                if i < 0:  # cut the largest item to the room that is left
                    i = int(np.where(live, need[:, 0], -1.0).argmax())
                    a, b, c = (int(x) for x in at[i, 1:])
                    cut = min(b, a + self.length - used)
                    room = round(free[2] * self.loss)
                    cut = min(cut, max(a, c) + room)
                    if cut <= a:
                        break
                    sequence.append((int(at[i, 0]), a, cut, used))
                    used += cut - a
                    pieces += 1
                    free -= ((cut - a) / self.length, 1 / self.segments, self._loss(a, cut, c) / self.loss)
                    at[i, 1] = cut
                    if cut == b:
                        live[i] = False
                        left -= 1
                    else:
                        measure(i)
                    continue
                a, b = int(at[i, 1]), int(at[i, 2])
                sequence.append((int(at[i, 0]), a, b, used))
                used += b - a
                pieces += 1
                free -= need[i]
                live[i] = False
                left -= 1
            if used < self.length and not left and not final:
                self.waiting += [[d, a, b, int(next(x[3] for x in items if x[0] == d))] for d, a, b, _ in sequence]
                return
            if used < self.length and not left:
                self._powers(sequence, used)
                continue
            for d, a, b, o in sequence:
                self.put(d, a, b, self.next_id, o)
            self.next_id += 1

    def _powers(self, sequence: list[tuple[int, int, int, int]], used: int) -> None:
        """Sequences of lengths that are powers of two and add up to ``used``."""
        k, room = 0, 0
        for d, a, b, _ in sequence:
            while a < b:
                if not room:
                    self.next_id += k > 0
                    k, room = k + 1, 1 << (used.bit_length() - 1)
                    size = room
                step = min(room, b - a)
                self.put(d, a, a + step, self.next_id, size - room)
                a, room, used = a + step, room - step, used - step
        self.next_id += 1


def pack(
    documents: DataFrame, tokenizer: str, length: int = 4096, max_segments: int = 128, max_loss_tokens: int | None = None,
    end_id: int = 2, loss_column: str | None = None, window: int = 512,
) -> DataFrame:
    """Pieces of all documents with their sequences (SCHEMA).

    tokenizer: path of a tokenizers file; end_id ends each document. loss_column: position of a document's first
    loss-bearing token (null: 0, the default for all), as in instruction data where the prompt bears no loss.
    """
    max_loss = max_loss_tokens or length
    if min(length, max_segments, max_loss) < 1:
        raise ValueError("limits must be at least 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer)
        packer = Packer(length, max_segments, max_loss, window, TaskContext.get().partitionId() << 40)
        ids_of: dict[int, tuple[int | None, np.ndarray, int]] = {}
        count = 0

        def out() -> Iterator[pa.RecordBatch]:
            if packer.placed:
                rows = []
                for d, a, b, s, o in packer.placed:
                    doc, ids, loss_from = ids_of[d]
                    rows.append((doc, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes()), len(ids), s, o, max(0, b - max(a, loss_from))))
                packer.placed = []
                keep = {x[0] for x in packer.waiting}
                for d in [d for d in ids_of if d not in keep]:
                    del ids_of[d]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            docs, loss = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            k = 0
            for ids, offsets in encoder.encode(batch.column(1)):
                for j in range(len(offsets) - 1):
                    own = np.append(ids[offsets[j] : offsets[j + 1]], np.uint32(end_id))
                    loss_from = min(max(loss[k] or 0, 0), len(own))
                    ids_of[count] = (docs[k], own, loss_from)
                    packer.add(count, len(own), loss_from)
                    count, k = count + 1, k + 1
                packer.pack()
                yield from out()
        packer.pack(final=True)
        yield from out()

    loss_from = F.col(loss_column).cast("long") if loss_column else F.lit(0).cast("long")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), loss_from.alias("loss_from")).mapInArrow(trimmed(run), SCHEMA)
